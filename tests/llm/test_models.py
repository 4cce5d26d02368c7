"""Language ID, quality rules, quality classifier and toxicity: contracts, edge
cases, and accuracy on rows that nothing was learned from."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rivulet.llm import langid, qualitymil, qualityrules, registry, toxicity

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (10**6 + 3, "123 !!"), (10**6 + 4, "ß😀" * 3000), (10**6 + 5, "a")]


def bucket(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    return docs.unionByName(odd).cache(), labels


@needs_tables
def test_language(spark, tables):
    docs, _ = tables
    rows = langid.digest(docs).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (bucket(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i, _ in ODD[:4]] == ["und"] * 4 and by[ODD[0][0]].score == 0
    assert by[ODD[4][0]].lang_pred != "und"


def test_language_blocks(monkeypatch):
    text = "Der schnelle Fuchs springt über den Hund " * 200
    whole = langid.frequent(text).tolist()
    monkeypatch.setattr(langid, "BLOCK", 100)
    assert langid.frequent(text).tolist() == whole
    assert langid.Profiles({}).predict("text") == ("und", 0.0)


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@needs_tables
def test_quality_rules(spark, tables):
    docs, labels = tables
    rows = qualityrules.digest(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = plain_counts(texts[r.doc_id])
        assert tuple(r[1:6]) == n
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        assert r.base_failed == failed and not (failed and r.kept)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.kept, quality[r.doc_id]) for r in rows if r.doc_id in quality and bucket(r.doc_id, 5) == 0 and not r.base_failed]
    assert sum(k for k, q in held if q) >= 0.97 * sum(q for _, q in held)
    assert sum(not k for k, q in held if not q) >= 0.6 * sum(not q for _, q in held)


def test_repeated_words():
    assert qualityrules.repeated_words([b"a"] * 4) == 0
    assert qualityrules.repeated_words([b"a"] * 6) == 6
    assert qualityrules.repeated_words(list(map(str.encode, "abcdeXabcdeY"))) == 10


def test_list_of_no_rows():
    empty = qualityrules.learn_list({r: np.zeros(0) for r in qualityrules.RATIOS}, np.zeros(0, bool), np.zeros(0, int))
    assert str(empty) == "keep"


def area(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


@needs_tables
@pytest.mark.parametrize(("op", "label", "n", "rest", "least", "cut"), [(qualitymil, "quality", 5, 0, 0.95, 0.3), (toxicity, "toxic", 3, 1, 0.75, 0.7)])
def test_classifiers(spark, tables, op, label, n, rest, least, cut):
    docs, labels = tables
    rows = op.digest(docs, labels).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (bucket(r.doc_id, n) == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    assert area([(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]) >= least


def test_mil_streams_over_blocks(monkeypatch):
    model, text = qualitymil.Model(), "one two, three FOUR! " * 3000
    whole = model.score(text)
    monkeypatch.setattr(qualitymil, "BLOCK", 3)
    assert abs(model.score(text) - whole) < 1e-6
    assert 0 <= model.score(None) == model.score("") <= 1


def test_mil_gradients():
    r = np.random.default_rng(0)
    model = qualitymil.Model()
    bags, y = [r.normal(size=(k, qualitymil.HASHED + qualitymil.SHAPE)) for k in (1, 3, 2)], np.array([1.0, 0, 1])

    def loss():
        out = 0
        for x, t in zip(bags, y, strict=True):
            h = model.hidden(x)
            e = np.exp(model.attention(h)[2])
            s = qualitymil._sigmoid((e / e.sum()) @ h @ model.p["w"] + model.p["c"])[0]
            out -= (t * np.log(s) + (1 - t) * np.log(1 - s)) / len(y)
        return out + qualitymil.DECAY / 2 * ((model.p["W"] ** 2).sum() + (model.p["w"] ** 2).sum())

    grads = model.gradients(bags, y)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        k = int(np.argmax(np.abs(grads[name].reshape(-1))))
        flat[k] += 1e-5
        up = loss()
        flat[k] -= 2e-5
        down = loss()
        flat[k] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name].reshape(-1)[k]) < 1e-5


def test_label_model_discounts_copies():
    r = np.random.default_rng(1)
    y = (r.random(3000) < 0.3).astype(int)
    vote = lambda p: np.where(r.random(3000) < 0.7, np.where(r.random(3000) < p, y, 1 - y), -1)
    a, b, c = vote(0.9), vote(0.8), vote(0.6)
    votes = np.stack([a, b, c, c, c], axis=1)
    labels = np.where(np.arange(3000) < 300, y, -1)
    model = toxicity.LabelModel(votes, labels)
    assert model.discount[2] < 0.5 < model.discount[0]
    q = model.posterior(votes)
    assert ((q > 0.5) == y).mean() > 0.85


def test_registry():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_mil_trains_on_all_passages(spark, monkeypatch):
    """Bags are whole; if they are too large together, there are fewer of them."""
    docs = spark.createDataFrame([(i, "word " * (qualitymil.PASSAGE * (100 + i))) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    want = [100 + i for i in range(12) if bucket(i, 5) != 0]
    seen = []
    monkeypatch.setattr(qualitymil.Model, "fit", lambda self, bags, y, seed=7: seen.append(sorted(map(len, bags))))
    qualitymil.learn(docs, labels)
    assert seen.pop() == want and len(want) > 3
    monkeypatch.setattr(qualitymil, "SAMPLE_PASSAGES", 350)
    qualitymil.learn(docs, labels)
    assert len(seen[0]) == 3 and set(seen[0]) <= set(want)


def test_mil_gradients_in_parts(monkeypatch):
    r = np.random.default_rng(2)
    model = qualitymil.Model()
    bags, y = [r.normal(size=(k, qualitymil.HASHED + qualitymil.SHAPE)) for k in (5, 1, 7)], np.array([1.0, 0, 1])
    whole = model.gradients(bags, y)
    monkeypatch.setattr(qualitymil, "PART", 3)
    parts = model.gradients(bags, y)
    assert all(np.allclose(whole[k], parts[k]) for k in whole)
