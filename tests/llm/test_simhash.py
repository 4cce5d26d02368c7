import random
import re

import xxhash
from pyspark.sql import functions as F

from rivulet.llm import simhash
from rivulet.llm.components import connected_components


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_fingerprints():
    r = random.Random(1)
    for text in ["", None, " \n ", "one", "one two", "É é A B\x1fC", *(" ".join(r.choice("abcdef") for _ in range(n)) for n in (3, 4, 50, 400))]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_blocks(monkeypatch):
    text = " ".join(str(k % 37) for k in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole


def test_ball_links_all_within_two_bits(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = {k: p for k, p in enumerate(base)}
    for p in base[:15]:
        for _ in range(4):
            q = prints[r.choice(list(prints))]
            prints[len(prints)] = q ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints.values()})
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))
    for a, b in edges.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    want = plain_components({p: p & (1 << 64) - 1 for p in signed})
    assert {p: roots.get(p, p) for p in signed} == want


def test_query_rows(spark):
    r = random.Random(3)
    doc = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    near = [*doc]
    near[7] = "other"
    texts = {5: " ".join(doc), 9: " ".join(near), 3: " ".join(doc).upper(), 4: "", 8: None, 1: "short text here now", 2: "  "}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(5, texts[5], 2)], "doc_id long, text string, fingerprint int")
    rows = simhash.digest(df).collect()
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = plain_components(prints)
    assert len(rows) == len(texts) + 1
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(k, f"{prints[k]:016x}", want[k]) for k in texts}
    assert want[9] == want[5] == 3 and want[8] == want[4] == 2
    assert simhash.digest(df.limit(0)).count() == 0


def test_components_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (7, 7), (None, 5)], "a long, b long"))
    assert {(r.node, r.root) for r in connected_components(edges).collect()} == {(k, 0) for k in range(61)} | {(100, 100), (101, 100)}
    assert connected_components(edges.limit(0)).count() == 0
