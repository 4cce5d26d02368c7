"""Plain versions of the learned operators, and tables with nulls, repeated rows,
clashing columns and nothing in them."""

import math
import random
import re

import numpy as np
import pytest

from rivulet.llm import qualitymil, qualityrules, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, counts string, kept string, d int, k int, n_lines int, fingerprint int, ids string"


def corpus(spark, n=60):
    """Documents with all columns that the operators use within, and labels."""
    r = random.Random(2)
    good, bad = [f"calm{k}" for k in range(60)], [f"spam{k}" for k in range(6)]
    rows, labels = [], []
    for i in range(n):
        low = i % 3 == 0
        text = " ".join(r.choice(bad if low else good) for _ in range(r.randint(12, 40)))
        rows.append((i, text.upper() + "!!!" if low else text))
        labels.append((i, int(not low), int(low)))
    rows += [(None, "no id at all"), (None, None), (7, None), (8, ""), (9, rows[9][1]), (9, rows[9][1]), (n, "long " * 50_000)]
    labels += [(None, 1, 0), (3, None, None), (10**9, 0, 1)]
    docs = spark.createDataFrame([(i, t, None, None, None, "mine", "mine", "mine", "mine", 1, 1, 1, 1, "mine") for i, t in rows], DOCS)
    return docs.repartition(3), spark.createDataFrame(labels, LABELS)


def test_query_rows_of_odd_tables(spark):
    docs, labels = corpus(spark)
    n = docs.count()
    for op, columns in ((qualityrules, {"doc_id", "kept", "base_failed"}), (qualitymil, {"doc_id", "score", "predicted"}), (toxicity, {"doc_id", "score", "predicted"})):
        rows = op.digest(docs, labels).collect()
        assert len(rows) == n and columns <= set(rows[0].asDict()), op.__name__
        same = {tuple(r.asDict().values()) for r in rows if r.doc_id == 9}
        assert len(same) == 1, "repeated rows get equal results"
        assert op.digest(docs.limit(0), labels).count() == 0
        none = op.digest(docs, labels.limit(0)).collect()
        assert len(none) == n
        assert all(0 <= r["score"] <= 1 for r in [*rows, *none] if "score" in columns)
    judged = qualityrules.judge(docs, qualityrules.DecisionList([]))
    assert set(judged.columns) == {*docs.columns, "base_failed"}  # counts and kept are replaced


def plain_features(words):
    """The features of one passage, counted one by one."""
    raw = " ".join(words).encode()
    out = np.zeros(qualitymil.HASHED + qualitymil.SHAPE)
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        code = ((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) & 0xFFFFFFFF
        out[(code * 0x27D4EB2F & 0xFFFFFFFF) >> 24] += 1
    hashed = np.sqrt(out[: qualitymil.HASHED])
    out[: qualitymil.HASHED] = hashed / max(1e-6, math.sqrt((hashed**2).sum()))
    kind = lambda c: 0 if c == 32 else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if chr(c) in "#*$%&|<>" else 6 if c > 127 else 5
    share = [sum(kind(c) == k for c in raw) / max(1, len(raw)) for k in range(7)]
    out[qualitymil.HASHED :] = [*share[1:], share[0], (hashed > 0).sum() / min(qualitymil.HASHED, max(1, len(raw)))]
    return out


def test_attention_equals_plain_version():
    """The score of one text, passage by passage, gate by gate."""
    model, r = qualitymil.Model(), random.Random(3)
    words = ["".join(r.choice("abcXYZ019#é,") for _ in range(r.randint(1, 8))) for _ in range(250)]
    passages = [words[k : k + qualitymil.PASSAGE] for k in range(0, len(words), qualitymil.PASSAGE)]
    features = [plain_features(p) for p in passages]
    found = np.concatenate(list(qualitymil.blocks(" ".join(words))))
    for x, y in zip(found, features, strict=True):  # a passage's last blank is its own
        assert np.allclose(x[: qualitymil.HASHED], y[: qualitymil.HASHED], atol=0.05)
    p, hidden, weights = model.p, [], []
    for x in found:
        h = np.tanh(x @ p["W"] + p["b"])
        gate = np.tanh(h @ p["V"]) * (1 / (1 + np.exp(-(h @ p["U"]))))
        hidden.append(h)
        weights.append(math.exp(gate @ p["a"]))
    z = sum(w / sum(weights) * h for w, h in zip(weights, hidden, strict=True))
    assert abs(model.score(" ".join(words)) - 1 / (1 + math.exp(-(z @ p["w"] + p["c"][0])))) < 1e-6


def test_votes_and_posterior_equal_plain_version():
    voters = toxicity.Voters(["vile", "grim*", "*ness", "nasty", "foul", "rude", "mean", "cruel", "awful"])
    texts = ["A VILE day", "grimace and sadness", "quiet", "!!!!!! STOP IT NOW " * 3, "nooooo foul rude", None, "nasty, vile"]
    codes = np.array([voters.code(t) for t in texts])
    votes = toxicity.Voters.votes(codes)
    assert votes.shape == (len(texts), sum(n + 1 for n in toxicity.VOTERS.values()) + len(toxicity.PATTERNS))
    n = toxicity.VOTERS["word"]
    lexicon = {f: k % n for k, f in enumerate(["vile", "nasty", "foul", "rude", "mean", "cruel", "awful"])}
    for t, row in zip(texts, votes, strict=True):
        found = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        want = [1 if any(lexicon[w] == j for w in found & set(lexicon)) else -1 for j in range(n)]
        assert row[:n].tolist() == want and row[n] == (-1 if 1 in want else 0)
    labels = np.array([1, 1, 0, -1, 1, 0, -1])
    model = toxicity.LabelModel(votes, labels, np.array([1, 1, 1, 5, 1, 1, 2.0]))
    for row, q in zip(votes, model.posterior(votes), strict=True):
        odds = math.log(model.prior / (1 - model.prior)) + sum(model.discount[j] * model.evidence[j][v + 1] for j, v in enumerate(row))
        assert abs(q - 1 / (1 + math.exp(-odds))) < 1e-9
    double = toxicity.LabelModel(np.concatenate([votes, votes[3:4]]), np.append(labels, -1), np.array([1, 1, 1, 2, 1, 1, 2, 3.0]))
    assert np.allclose(double.posterior(votes), model.posterior(votes))  # a weight is so many rows


def test_linear_scores_equal_plain_sum():
    known = {"vile": 0, "vil*": 1, "nice": 2, "*vile": 3}
    c = toxicity.Classifier(known, np.array([2.0, 0.5, -1.0, 0.0]), -1.0)
    for text, x in (("vile vile", 1.0), ("nice vilex", -2.0), ("", -1.0), (None, -1.0)):
        assert abs(c.score(text) - 1 / (1 + math.exp(-x))) < 1e-9


def test_list_equals_plain_rules(spark):
    """The emitted expression judges each row as the ordered rules do."""
    r = np.random.default_rng(4)
    n = 600
    x = {name: r.random(n) * (50 if name == "n_words" else 1) for name in qualityrules.RATIOS}
    bad = (x["upper"] > 0.7) | (x["bangs_per_word"] > 0.8) & (x["n_words"] < 20)
    rules = qualityrules.learn_list(x, bad, np.arange(n) % 3)
    assert 1 <= len(rules.rules) <= qualityrules.MOST_RULES and str(rules).endswith("keep")
    counts = [tuple(int(v) for v in row) for row in r.integers(0, 60, (200, len(qualityrules.COUNTS)))]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(counts)], f"id int, counts struct<{','.join(f'{c}:long' for c in qualityrules.COUNTS)}>")
    value = lambda row, name: row[qualityrules.COUNTS.index(name)]
    for got in df.select("id", rules.verdict().alias("stays")).collect():
        row, stays = counts[got.id], True
        for rule in rules.rules:
            ratio = lambda s: value(row, qualityrules.RATIOS[s][0]) / (max(1, value(row, qualityrules.RATIOS[s][1])) if qualityrules.RATIOS[s][1] else 1)  # noqa: B023, E731
            if all((ratio(k.statistic) > k.cut) == k.above for k in rule):
                stays = False
                break
        assert got.stays == stays


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls everywhere, repeated rows, columns with clashing names, empty tables;
    a benchmark passage goes, in a long text too."""
    passage = " ".join(f"benchmark{k}" for k in range(20))
    spark.createDataFrame([(1, passage), (2, None), (3, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, _ = corpus(spark, 30)
    filler = " ".join(f"filler{k % 977}x{k}" for k in range(3000))
    planted = spark.createDataFrame([(901, f"{filler} {passage} {filler}", *[None] * 12), (902, passage, *[None] * 12), (903, f"{filler} short words", *[None] * 12)], DOCS)
    docs = docs.unionByName(planted)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert rows or name == "language_id", name
        if name != "bpe":
            assert out.columns == docs.columns, name
    kept = {r.doc_id for r in corpus_pipeline.benchmark(spark, docs, str(tmp_path)).collect()}
    assert kept == {*range(31), None, 903}
    encoded = corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()
    assert len(encoded) == docs.count() and all(r.round_trip for r in encoded)
