"""WARC archives with a two-level capture index.

``write_archives`` turns rows into WARC 1.1 records, a gzip member each, in
files of the shared folder; equal payloads are stored once, by the record of
least id, and the others are revisit records that refer to it. A task writes
files of its own name and reports them, so that a retried task leaves no row
twice: only reported files count.

``build_index`` sorts the captures by a reversed-host url key into shards of
compressed blocks; each shard has a sparse directory of its blocks' first keys.
``lookup`` finds keys by two binary searches (the shard among the shards' first
keys, the block in the shard's directory) and one range read of the block; then
the record itself is one range read of its archive. Queries are sorted by key,
and reads by place, so that a full sweep reads everything once and in order.

Null html is an empty payload. A row without an id is never referred to: it
revisits the row of least id whose payload is equal, and is a response if no row
with an id has its payload. Rows of equal id and payload are records alike, all
responses if the id is the least. Null urls have an empty key. Records are held
one at a time.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches, delete, fresh_path, scratch, stored
from rivulet.llm.urlfilter import host

#: An archive file is closed after so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Captures in a block of the index.
BLOCK_LINES = 3000
#: Bytes of archives, and keys looked up, for each task of the reading stages.
READ_BYTES, READ_KEYS = 32 << 20, 20_000
#: Shards an index may have: their first keys are sent to every task.
MAX_SHARDS = 100_000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "url_key string, page_id long, record_type string, file string, offset long, length long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, so that any shared store will do."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def url_key(url: Column) -> Column:
    """Host labels from the top domain down, then what follows the host; empty without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host(url), r"\.")), ","), F.lit(")"), rest)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, key).otherwise("")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC record, not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-none")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:x-page:{first}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The captures of all rows: url_key, page_id, record_type, file, offset, length."""
    bounded_batches(pages.sparkSession, rows=256)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumns({"sha": F.sha1("payload"), "url_key": url_key(F.col("url"))})
    # ids and digests only: combined before the shuffle, whatever the number of copies
    least = own.select("sha", "page_id", F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    told = own.join(least, "sha", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = opened(root)
        store.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, sha, key, first in zip(*(batch[c] for c in ("page_id", "url", "payload", "sha", "url_key", "first")), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                pid, lowest = (None if pd.isna(x) else int(x) for x in (page_id, first))
                revisit = lowest is not None and pid != lowest
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(pid, url, bytes(payload), base32(sha), lowest, revisit)) + packer.flush()
                out.write(member)
                rows.append((key, pid, "revisit" if revisit else "response", name, at, len(member)))
                at += len(member)
            frame = pd.DataFrame(rows, columns=["url_key", "page_id", "record_type", "file", "offset", "length"])
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return stored(told.select("page_id", "url", "payload", "sha", "url_key", "first").mapInPandas(write, _CAPTURE), "captures")


def _order(key: str, page_id: int | None) -> tuple:
    """As Spark sorts: bytes of the key, then the id, null first."""
    return key.encode("utf-8", "surrogatepass"), page_id is not None, page_id or 0


def build_index(captures: DataFrame, root: str) -> DataFrame:
    """Write the shards; return a row for each: shard, key, page_id (its first), blocks, captures."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = opened(root)
        store.create_dir(folder, recursive=True)
        name, directory, lines, at, total = uuid.uuid4().hex, [], [], 0, 0
        out = None

        def close_block() -> None:
            nonlocal lines, at
            raw = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 6)
            out.write(raw)
            directory.append([*lines[0][:2], at, len(raw)])
            at, lines = at + len(raw), []

        for batch in batches:
            for row in batch.itertuples(index=False):
                out = out or store.open_output_stream(f"{folder}/{name}.idx", compression=None)
                lines.append([row.url_key, None if pd.isna(row.page_id) else int(row.page_id), row.record_type, row.file, int(row.offset), int(row.length)])
                total += 1
                if len(lines) == BLOCK_LINES:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            out.close()
            with store.open_output_stream(f"{folder}/{name}.dir", compression=None) as f:
                f.write(json.dumps(directory).encode())
            first = directory[0]
            yield pd.DataFrame({"shard": [name], "url_key": [first[0]], "page_id": pd.array([first[1]], "Int64"), "blocks": [len(directory)], "captures": [total]})

    ordered = captures.repartitionByRange("url_key", "page_id", "file", "offset").sortWithinPartitions("url_key", "page_id", "file", "offset")
    return stored(ordered.mapInPandas(write, "shard string, url_key string, page_id long, blocks long, captures long"), "index_shards")


class Index:
    """Reading access to the shards, from within a task."""

    def __init__(self, root: str, shards: list[tuple]) -> None:
        self.store, self.folder = opened(root)
        self.names, self.firsts = [s[0] for s in shards], [_order(s[1], s[2]) for s in shards]
        self.shard, self.block = (-1, [], []), (-1, -1, [], [])

    def _directory(self, k: int) -> tuple[list, list]:
        if self.shard[0] != k:
            with self.store.open_input_file(f"{self.folder}/{self.names[k]}.dir") as f:
                entries = json.loads(f.read())
            self.shard = (k, entries, [_order(e[0], e[1]) for e in entries])
        return self.shard[1], self.shard[2]

    def _block(self, k: int, b: int) -> tuple[list, list]:
        if self.block[:2] != (k, b):
            entries, _ = self._directory(k)
            with self.store.open_input_file(f"{self.folder}/{self.names[k]}.idx") as f:
                f.seek(entries[b][2])
                lines = [json.loads(x) for x in zlib.decompress(f.read(entries[b][3])).split(b"\n")]
            self.block = (k, b, lines, [_order(x[0], x[1]) for x in lines])
        return self.block[2], self.block[3]

    def find(self, key: str, page_id: int | None) -> Iterator[list]:
        """Every capture of the key; equal keys may reach over blocks and shards."""
        want = _order(key, page_id)
        k = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while k < len(self.names) and self.firsts[k] <= want:
            entries, starts = self._directory(k)
            b = max(0, bisect.bisect_left(starts, want) - 1)
            while b < len(entries) and starts[b] <= want:
                lines, keys = self._block(k, b)
                for line in lines[bisect.bisect_left(keys, want) : bisect.bisect_right(keys, want)]:
                    yield line
                b += 1
            k += 1


def lookup(queries: DataFrame, shards: DataFrame, root: str) -> DataFrame:
    """The captures of each (url_key, page_id) of ``queries`` (distinct rows)."""
    known = [tuple(r) for r in shards.select("shard", "url_key", "page_id").limit(MAX_SHARDS + 1).collect()]
    if len(known) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards")
    known.sort(key=lambda s: _order(s[1], s[2]))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(root, known)
        for batch in batches:
            rows = [hit for key, pid in zip(batch["url_key"], batch["page_id"], strict=True) for hit in index.find(key, None if pd.isna(pid) else int(pid))]
            yield pd.DataFrame(rows, columns=["url_key", "page_id", "record_type", "file", "offset", "length"]).astype({"page_id": "Int64", "offset": "int64", "length": "int64"})

    keys = queries.select("url_key", F.col("page_id").cast("long").alias("page_id"))
    n = shards.agg(F.sum("captures")).first()[0] or 0  # as many tasks as there may be keys for
    return keys.repartitionByRange(n // READ_KEYS + 1, "url_key", "page_id").sortWithinPartitions("url_key", "page_id").mapInPandas(find, _CAPTURE)


def read_records(captures: DataFrame, root: str, n_bytes: int | None = None) -> DataFrame:
    """What the archives hold at the captures' places: page_id, record_type,
    payload (null for a revisit), payload_bytes, payload_digest (worked out
    from the payload, or as a revisit states it) and refers_to. ``n_bytes`` is
    what is to be read, if that is known: it sets the number of tasks, which the
    captures' own few bytes would not."""
    bounded_batches(captures.sparkSession, rows=256)
    schema = "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = opened(root)
        name, file = None, None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.file != name:
                    if file is not None:
                        file.close()
                    name, file = row.file, store.open_input_file(f"{folder}/{row.file}")
                file.seek(int(row.offset))
                fields, block = parsed(zlib.decompress(file.read(int(row.length)), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                number = lambda urn: int(urn[len("<urn:x-page:") : -1]) if urn and len(urn) > len("<urn:x-page:>") else None
                stated = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response":
                    found = base32(hashlib.sha1(payload).hexdigest())
                    if found != stated or len(payload) != size:
                        raise ValueError(f"{name} at {row.offset}: the payload is not what the record states")
                rows.append((number(fields["warc-record-id"]), kind, payload if kind == "response" else None, size, stated, number(fields.get("warc-refers-to"))))
            yield pd.DataFrame(rows, columns=["page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if file is not None:
            file.close()

    placed = captures.repartition("file") if n_bytes is None else captures.repartition(n_bytes // READ_BYTES + 1, "file", F.floor(F.col("offset") / READ_BYTES))
    return placed.sortWithinPartitions("file", "offset").mapInPandas(read, schema)


def digest(pages: DataFrame) -> DataFrame:
    """The query's rows: every page's record, found through the index and read
    back. Archives and index are deleted once read."""
    spark = pages.sparkSession
    archives, index = fresh_path(spark, "warc"), fresh_path(spark, "index")
    with scratch(spark):
        captures = write_archives(pages, archives)
        shards = build_index(captures, index)
        queries = pages.select(url_key(F.col("url")).alias("url_key"), "page_id").distinct()
        size = captures.agg(F.sum("length")).first()[0] or 0
        found = read_records(lookup(queries, shards, index), archives, size)
        rows = stored(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records", lasting=True)
    for folder in (archives, index):
        delete(spark, folder)
    return rows


#: DuckDB has hexadecimal SHA-1; base32 is spelled out of its bits, five at a time.
ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT DISTINCT h, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
          ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT)) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1), '' ORDER BY i)
          FROM range(32) t(i)) AS d FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m USING (h) JOIN b USING (h)
"""
