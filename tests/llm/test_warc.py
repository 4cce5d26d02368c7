import base64
import gzip
import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from rivulet.llm import warc
from rivulet.llm.common import fresh_path

PAGES = [(5, "http://b.example.com/x?q=1", "<p>ä</p>"), (2, "http://a.example.com/", "<p>ä</p>"), (9, None, None), (7, "no scheme", ""), (1, "http://a.example.com/", "own"), (3, "http://b.example.com/ \r\nX: y", "x" * 100_000), (8, "http://z.org/", "tail\r\n\r\nWARC/1.1\r\n")]


def want(pages):
    least = {}
    for p, _, h in pages:
        least[h or ""] = min(least.get(h or "", p), p)
    return {(p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if least[h or ""] == p else "revisit", None if least[h or ""] == p else least[h or ""]) for p, _, h in pages}


def table(spark, pages):
    return spark.createDataFrame([(*p, "more") for p in pages], "page_id long, url string, html string, payload string")


def test_query_rows(spark):
    rows = [tuple(r) for r in warc.digest(table(spark, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert len(rows) == len(PAGES) and set(rows) == want(PAGES)
    assert warc.digest(table(spark, PAGES[:1]).limit(0)).count() == 0


def test_repeated_rows_and_small_payloads(spark):
    rows = warc.digest(table(spark, [PAGES[0], PAGES[0], PAGES[1]])).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(2, "response"), (5, "revisit"), (5, "revisit")]
    root = fresh_path(spark, "warc")
    kinds = {r.page_id: r.record_type for r in warc.write_archives(table(spark, PAGES), root, min_bytes=3).collect()}
    assert kinds[9] == kinds[7] == "response" and kinds[5] == "revisit"


def test_files_are_warc(spark, monkeypatch):
    root = fresh_path(spark, "warc")
    captures = warc.write_archives(table(spark, PAGES), root).collect()
    folder = Path(root.removeprefix("file://"))
    for c in captures:
        raw = (folder / c.file).read_bytes()[c.offset : c.offset + c.length]
        fields, block = warc.parsed(gzip.decompress(raw))
        assert fields["warc-type"] == c.record_type and fields["warc-record-id"] == f"<urn:x-page:{c.page_id}>"
        assert int(fields["content-length"]) == len(block)
    whole = b"".join(gzip.decompress((folder / f).read_bytes()) for f in {c.file for c in captures})
    assert whole.count(b"WARC-Type: ") == len(PAGES)


def test_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = [(k, f"http://h{k % 5}.example.com/{k % 7}", f"page {k}") for k in range(60)] + [(3, "http://h3.example.com/3", "again")]
    archives, index = fresh_path(spark, "warc"), fresh_path(spark, "index")
    captures = warc.write_archives(table(spark, pages), archives)
    shards = warc.build_index(captures, index)
    assert shards.agg(F.sum("captures")).first()[0] == 61
    keys = captures.select("url_key", "page_id").distinct().where("page_id % 20 = 3").unionByName(spark.createDataFrame([("com,example,h0)/0", 999), ("", 1), ("zz", 3)], "url_key string, page_id long"))
    found = warc.lookup(keys, shards, index)
    assert sorted(r.page_id for r in found.collect()) == [3, 3, 23, 43]
    texts = {bytes(r.payload).decode() for r in warc.read_records(found, archives).collect()}
    assert texts == {"page 3", "again", "page 23", "page 43"}


def test_keys(spark):
    df = spark.createDataFrame([("http://WWW.Example.com/a?b",), (None,), ("x",), ("http://h:80",)], "u string")
    assert [r[0] for r in df.select(warc.url_key(F.col("u"))).collect()] == ["com,example,www)/a?b", "", "", "h:80)"]


def test_null_ids(spark):
    """Rows without an id are never referred to; without another row of their payload they are responses."""
    pages = [(None, "http://a.example.com/", "shared"), (None, "http://b.example.com/", "shared"), (5, "http://c.example.com/", "shared"), (None, None, "alone"), (None, "http://d.example.com/", "alone"), (6, None, None)]
    rows = warc.digest(table(spark, pages)).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in rows)
    assert got == [(0, 5, "response", 0), (0, 5, "response", 0), (0, 6, "revisit", 5), (0, 6, "revisit", 5), (5, 6, "response", 0), (6, 0, "response", 0)]
