import hashlib
import random
import re

from pyspark.sql import functions as F

from rivulet.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(13, len(w))
        for a in range(len(w) - size + 1 if size else 0):
            for b in range(len(own) - size + 1):
                if own[b : b + size] == w[a : a + size]:
                    hit |= set(range(b, b + size))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def case(seed):
    r = random.Random(seed)
    v = [f"v{k}" for k in range(60)] + ["the"] * 30 + ["Étude", "été"]
    make = lambda n: [r.choice(v) for _ in range(n)]
    items = [(10 * k, " ".join(make(r.choice([1, 2, 5, 13, 14, 40])))) for k in range(12)] + [(7, None), (8, "!!"), (9, "the the the"), (11, "The, the. THE")]
    docs = {}
    for d in range(30):
        parts = []
        for _ in range(r.randrange(4)):
            parts += make(r.randrange(30))
            if r.random() < 0.7:
                w = (r.choice(items)[1] or "").split()
                at = r.randrange(len(w) + 1)
                parts += w[at : at + r.choice([5, 13, 20])]
        docs[d] = r.choice([" ", ", ", "\n"]).join(parts).upper() if r.random() < 0.3 else " ".join(parts)
    return docs | {30: None, 31: "", 32: "the", 33: "..."}, items


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        df = spark.createDataFrame([(d, t, 0) for d, t in docs.items()] + [(3, docs[3], 1)], "doc_id long, text string, n_hit int")
        bench = spark.createDataFrame(items, "item_id long, text string")
        rows = D.digest(df, bench).collect()
        assert len(rows) == len(docs) + 1
        for r in rows:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(docs[r.doc_id], items)
        left = {r.doc_id for r in D.remove_contaminated(df, bench).collect()}
        assert left == {d for d, t in docs.items() if not brute(t, items)[4]}


def test_without_broadcasts_and_empty(spark, monkeypatch):
    docs, items = case(3)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(D.digest(df, bench).collect())
    monkeypatch.setattr(D, "BROADCAST_TERMS", 0)
    assert sorted(D.digest(df, bench).collect()) == want
    assert D.digest(df.limit(0), bench).count() == 0
    assert {r.n_hit for r in D.digest(df, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "a b c d"), (3, "a c b e d"), (4, "a q q q q b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    found, _ = D.matches(D.keyed(docs), bench, slop=1)
    names = D.keyed(docs).select("doc_id", "k1", "k2")
    assert {(r.doc_id, r.exact) for r in found.join(names, ["k1", "k2"]).select("doc_id", "exact").distinct().collect()} == {(1, False), (2, True), (3, False)}
    exact, _ = D.matches(D.keyed(docs), bench)
    assert [r.doc_id for r in exact.join(names, ["k1", "k2"]).select("doc_id").collect()] == [2]
    assert exact.where(~F.col("exact")).count() == 0


def test_proximity_at_the_ends(spark):
    """The rarest word (c) before its place at the start of a text, or after it at the end."""
    docs = spark.createDataFrame([(1, "a c b d"), (2, "x a c b d"), (3, "a b d c"), (4, "a b d"), (5, "c a b d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.contamination(docs, bench, slop=2).collect()}
    assert rows == {1: (4, 3, ["1"]), 2: (5, 4, ["1"]), 3: (4, 3, ["1"]), 4: (3, 0, []), 5: (4, 0, [])}


def brute_near(text, items, slop, counts):
    """Positions in, and items with, windows whose rarest word stands at its place
    and all others at most ``slop`` words off theirs."""
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(13, len(w))
        for a in range(len(w) - size + 1 if size else 0):
            window = w[a : a + size]
            anchor = min(range(size), key=lambda k: (counts.get(window[k], 0), window[k], k))
            for p in range(len(own)):
                b = p - anchor
                near = lambda k: range(max(0, b + k - slop), b + k + slop + 1) if k != anchor else [p]  # noqa: B023, E731
                if all(window[k] in (own[x] for x in near(k) if x < len(own)) for k in range(size)):
                    hit |= set(range(max(0, b), min(b + size, len(own))))
                    found.add(str(item))
    return len(hit), sorted(found)


def test_proximity_equals_brute_force(spark):
    """The query's further columns; texts with words left out, put in and exchanged."""
    for seed in (4, 5):
        docs, items = case(seed)
        r = random.Random(seed)
        for d in range(100, 130):
            w = words(r.choice(items)[1])
            for _ in range(r.randrange(3)):
                if len(w) > 2:
                    k = r.randrange(len(w) - 1)
                    kind = r.randrange(3)
                    w[k : k + 2] = [w[k + 1], w[k]] if kind == 0 else [w[k], "new", w[k + 1]] if kind == 1 else [w[k]]
            docs[d] = " ".join(["before"] * r.randrange(3) + w)
        counts = {}
        for t in docs.values():
            for x in words(t):
                counts[x] = counts.get(x, 0) + 1
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
        bench = spark.createDataFrame(items, "item_id long, text string")
        more = 0
        for row in D.digest(df, bench).collect():
            exact = brute(docs[row.doc_id], items)
            n, found = brute_near(docs[row.doc_id], items, D.SLOP, counts)
            assert (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated) == exact
            assert (row.n_near, row.n_near_items) == (n, len(found)), row
            more += n > exact[1]
        assert more > 5


def test_any_window(spark):
    """One whole phrase in a long text, however long; short items by their share."""
    phrase = " ".join(f"p{k}" for k in range(15))
    filler = " ".join(f"f{k}" for k in range(30_000))
    rows = [(1, f"{filler} {phrase} {filler}"), (2, filler), (3, f"{filler} short item {filler}"), (4, "short item"), (None, f"{phrase} {filler}"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "key long, body string, k1 int, items string")
    bench = spark.createDataFrame([(1, phrase), (2, "short item"), (3, None)], "item_id long, text string")
    kept = D.remove_contaminated(docs, bench, "key", "body", any_window=True)
    assert kept.columns == docs.columns and sorted(r.key for r in kept.collect()) == [2, 3, 6, 7]
    assert sorted(r.key or 0 for r in D.remove_contaminated(docs, bench, "key", "body").collect()) == [0, 1, 2, 3, 6, 7]
