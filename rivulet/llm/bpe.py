"""Byte-level BPE encoding and decoding by a given rank file.

Two-tier lookup. Tier one: a minimal perfect hash (hash and displace) resolves a
whole pre-token that the vocabulary holds; the slot's key is compared, so a
stranger is never taken for a member. Tier two: what misses is merged by a heap
of candidate pairs over a doubly linked list of its bytes, in O(n log n), lowest
rank first and leftmost among equals.

``encode`` adds ``ids`` (array<int>), ``decode`` adds ``decoded`` (binary);
columns of those names in the input are replaced, all others stay. A null text
has no ids, as an empty one; null ids decode to no bytes. Repeated rows are
encoded alike. A text is taken whole; one of millions of characters is matched
piece by piece, so that only its ids are held.
"""

from __future__ import annotations

import base64
import os
import re
import threading
import time
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches

#: Pre-tokens whose ids a worker remembers, newest; as many older ones are kept
#: beside. Some 170 bytes each.
REMEMBERED = 600_000
#: Seconds after which a worker that encodes nothing forgets its pre-tokens, so
#: that it does not hold their memory while other stages run.
IDLE_SECONDS = 5.0
#: Texts of more characters are matched piece by piece.
LONG_TEXT = 4_000_000
#: Ids decoded at once.
PART = 1 << 16
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, in the order of ranks, which must be 0, 1, 2 ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    if not all(out):
        raise ValueError(f"{path}: ranks are not 0 to {len(pairs) - 1}")
    return out


def _spread(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """The slot of hashes h under displacements d (multiply and shift)."""
    return ((((h ^ (d * _MIX1)) * _MIX2) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _spread1(h: int, d: int, n: int) -> int:
    return ((((h ^ (d * 0xBF58476D1CE4E5B9)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF) >> 32) * n) >> 32


class PerfectHash:
    """A minimal perfect hash from the keys to 0 .. n-1.

    A key's bucket has either a displacement d >= 0, so that the slot is a
    mixing of the key's hash and d, or, if it is alone in its bucket, -1 - slot.
    """

    def __init__(self, shift: np.ndarray, slot_key: np.ndarray) -> None:
        self.shift, self.slot_key = shift.tolist(), slot_key.tolist()
        self.n = len(self.slot_key)

    @staticmethod
    def build(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The displacement of each bucket and the key number in each slot."""
        n, buckets = len(keys), max(1, len(keys) // 4)
        low = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        bucket = (low % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sizes = np.diff(starts)
        shift, slot_key = np.zeros(buckets, np.int64), np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        tries = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own, base = order[starts[b] : starts[b + 1]], 0
            while True:
                d = tries + np.uint64(base)
                slots = _spread(low[own][:, None], d[None, :], n)
                good = free[slots].all(axis=0)
                ordered = np.sort(slots, axis=0)
                good &= (ordered[1:] != ordered[:-1]).all(axis=0)
                if good.any():
                    k = int(np.argmax(good))
                    shift[b] = base + k
                    slot_key[slots[:, k]] = own
                    free[slots[:, k]] = False
                    break
                base += 64
        left = iter(np.flatnonzero(free))
        for b in np.flatnonzero(sizes == 1):
            slot = int(next(left))
            shift[b] = -1 - slot
            slot_key[slot] = order[starts[b]]
        return shift, slot_key

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % len(self.shift)]
        return -1 - d if d < 0 else _spread1(h & 0xFFFFFFFFFFFFFFFF, d & 0xFFFFFFFF, self.n)


def merge(word: bytes, ranks: dict[bytes, int], longest: int) -> tuple[int, ...]:
    """The ids of a pre-token, by merging neighbours of least rank."""
    n = len(word)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = following[i]
        if j < 0 or j >= n or following[j] != end:
            continue  # one of the two has been merged meanwhile
        following[i], following[j] = end, -1
        if end < n:
            before[end] = i
            e = following[end]
            if e - i <= longest and (r := get(word[i:e])) is not None:
                heappush(heap, (r, i, e))
        p = before[i]
        if p >= 0 and end - p <= longest and (r := get(word[p:end])) is not None:
            heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        e = following[i]
        out.append(ranks[word[i:e]])
        i = e
    return tuple(out)


#: Equal matches by the standard library, faster, for texts of Latin letters
#: without fractions, superscripts and separators on which classes differ.
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_BEYOND_LATIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
_LATIN_FORM = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": re.compile(rf" ?[{_LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+"),
}


class Encoder(dict):
    """Ids of pre-tokens, as packed int32; a dict that works out what it does not hold."""

    def __init__(self, tokens: list[bytes], shift: np.ndarray, slot_key: np.ndarray, pattern: str) -> None:
        import regex

        self.tokens, self.hash = tokens, PerfectHash(shift, slot_key)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens), default=0)
        self.pattern, self.latin = regex.compile(pattern), _LATIN_FORM.get(pattern)
        self.older: dict[str, bytes] = {}
        self.busy, self.used = False, 0.0
        self.watcher: threading.Thread | None = None

    def rest(self) -> None:
        """Called after each batch: forget all if no other comes soon."""
        self.busy, self.used = False, time.monotonic()
        if self.watcher is None:
            self.watcher = threading.Thread(target=self._watch, daemon=True)
            self.watcher.start()

    def _watch(self) -> None:
        """Forget all once no batch has come for a while; one thread serves many batches."""
        while self.busy or time.monotonic() - self.used < IDLE_SECONDS:
            time.sleep(IDLE_SECONDS)
        self.watcher = None
        self.forget()

    def forget(self) -> None:
        self.older = {}
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode("utf-8")
            key = self.hash.slot_key[self.hash.slot(raw)]
            ids = array("i", (key,) if self.tokens[key] == raw else merge(raw, self.ranks, self.longest)).tobytes()
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        pattern = self.latin if self.latin and not _BEYOND_LATIN.search(text) else self.pattern
        if len(text) > LONG_TEXT:
            out = bytearray()
            for m in pattern.finditer(text):
                out += self[m[0]]
            return np.frombuffer(out, np.int32)
        return np.frombuffer(b"".join(map(self.__getitem__, pattern.findall(text))), np.int32)


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(tables, pattern: str) -> Encoder:
    """This worker's encoder, made once from the broadcast tables."""
    key = (tables, pattern)  # a worker has one object for each broadcast
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*tables.value, pattern)
    return _ENCODERS[key]


#: The last vocabulary broadcast, by application and file.
_TABLES: dict[tuple, object] = {}


def _tables(df: DataFrame, path: str):
    """Vocabulary and perfect hash, read and built on the driver once; their size is the file's."""
    context, file = df.sparkSession.sparkContext, os.stat(path)
    key = (context.applicationId, path, file.st_size, file.st_mtime_ns)
    if key not in _TABLES:
        tokens = load_ranks(path)
        _TABLES.clear()
        _TABLES[key] = context.broadcast((tokens, *PerfectHash.build(tokens)))
    return _TABLES[key]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text_col``; special tokens are ordinary text."""
    bounded_batches(df.sparkSession)
    tables = _tables(df, path)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encoder = _encoder(tables, pattern)
        encoder.busy = True
        parts = [encoder.encode(t.as_py()) for t in texts]
        encoder.rest()
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))

    # held apart from what is made of the ids, else they would be worked out for each use
    return df.withColumn(out_col, ids.asNondeterministic()(F.col(text_col)))


class Decoder:
    """The bytes of ids, all tokens lying one after another in one array."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(ids), PART):
            own = ids[at : at + PART]
            sizes = self.sizes[own]
            ends = np.cumsum(sizes)
            place = np.repeat(self.starts[own] - (ends - sizes), sizes)
            place += np.arange(len(place))
            parts.append(self.bytes[place])
        return np.concatenate(parts) if parts else np.empty(0, np.uint8)


_DECODERS: dict[object, Decoder] = {}


def _decoder(tables) -> Decoder:
    if tables not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[tables] = Decoder(tables.value[0])
    return _DECODERS[tables]


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids_col`` stands for."""
    bounded_batches(df.sparkSession)
    tables = _tables(df, path)

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        decoder = _decoder(tables)
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)  # null lists have none
        counts = np.asarray(ids.value_lengths().fill_null(0), np.int64)
        raw = decoder.decode(flat)
        ends = np.concatenate(([0], np.cumsum(decoder.sizes[flat])))[np.concatenate(([0], np.cumsum(counts)))]
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])

    return df.withColumn(out_col, decoded(F.col(ids_col)))


def digest(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """The query's rows: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = decode(encode(df.select("doc_id", "text"), path, pattern), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
