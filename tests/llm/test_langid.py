import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rivulet.llm import langid as L


def spelled(text):
    """Letters in lower case, one space for what stands between them, none at the start."""
    out = ""
    for ch in text or "":
        ch = ch.lower() if ch.isalpha() else " "
        if not (ch == " " and out[-1:] in ("", " ")):
            out += ch
    return out


def grams(text):
    s = spelled(text)
    return Counter(g for k in (1, 2, 3) for at in range(len(s) - k + 1) if (g := s[at : at + k]) != " ")


def ranked(counts):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: L.DEPTH]


def brute(rows):
    """doc_id -> (language, score) by comparing rank with rank."""
    profiles = {}
    for doc, text, lang in rows:
        if lang is not None and text is not None and not (doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2):
            profiles.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in sorted(profiles.items())}
    out = {}
    for doc, text, _ in rows:
        own = ranked(grams(text))
        if not any(g.strip() for g in own) or not profiles:
            out[doc] = ("und", 0.0)
            continue
        far = {lang: sum(abs(k - p[g]) if g in p else L.DEPTH for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        out[doc] = (best, 1 - far[best] / (L.DEPTH * len(own)))
    return out


def case():
    r = random.Random(1)
    letters = {"aa": "aeioubcdf", "bb": "aeiouxyzw", "cc": "äöüßпри"}
    word = lambda s: "".join(r.choice(s) for _ in range(r.randint(1, 7)))
    rows = [(k, " ".join(word(letters[lang]) for _ in range(r.randint(1, 60))).title() + r.choice(["", "!", " 12 "]), lang) for k, lang in enumerate(r.choices(list(letters), k=60))]
    return [*rows, (100, None, "aa"), (101, "", "bb"), (102, "123 !?", "aa"), (103, "aei", None), (104, "\U00010400\U00010428 é", None)]


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_equals_brute_force(spark, monkeypatch, block):
    """Whole texts and blocks give the same; n-grams across the edges of blocks count."""
    monkeypatch.setattr(L, "BLOCK", block)
    rows = case()
    want = brute(rows)
    docs = spark.createDataFrame([(*x, "clash") for x in rows] + [(*rows[0], "again")], "doc_id long, text string, lang string, score string").repartition(3)
    got = L.digest(docs).collect()
    assert len(got) == len(rows) + 1
    known = {d: (t, lang) for d, t, lang in rows}
    profiles = L.learn(docs.where(~L.held_out(docs.doc_id)).dropDuplicates(["doc_id"]))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    for doc, (text, _) in known.items():
        lang, score = profiles.predict(text)
        assert (lang, round(score, 9)) == (want[doc][0], round(want[doc][1], 9)), doc
    assert L.identify(docs, profiles, out=("lang", "score")).columns == docs.columns


def test_ties_and_empty(spark):
    """Equal distances go to the first in alphabet; nothing learned is und."""
    docs = spark.createDataFrame([(1, "abc abc", "zz"), (3, "abc abc", "bb"), (4, "abc", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.digest(docs).collect()} == {"bb"}
    assert {(r.lang_pred, r.score) for r in L.digest(docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id = 4")).collect()} <= {("und", 0.0), ("", 0.0)}
    assert L.digest(docs.limit(0)).count() == 0


def test_sample_is_of_least_hash(spark, monkeypatch):
    """The ranked classes hold the ids of least hash; one language may hold nearly all rows."""
    monkeypatch.setattr(L, "PER_LANGUAGE", 7)
    rows = [(k, f"t{k}", "aa" if k % 50 else "bb") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = {(r.lang, r.text) for r in L._sample(docs, "lang", "text", "doc_id").collect()}
    from pyspark.sql import functions as F

    hashes = {r.doc_id: r.h & (1 << 63) - 1 for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    want = {(lang, f"t{k}") for lang in ("aa", "bb") for k in sorted((k for k, _, x in rows if x == lang), key=hashes.get)[:7]}
    assert got == want
    monkeypatch.setattr(L, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        L._sample(docs, "lang", "text", "doc_id")


def test_long_text_in_blocks():
    text = " ".join(f"w{k} õne {k % 7}" for k in range(3000))
    whole = L.frequent(text)
    old, L.BLOCK = L.BLOCK, 101
    try:
        assert np.array_equal(L.frequent(text), whole)
    finally:
        L.BLOCK = old


def test_all_rows_are_learned_from(spark, monkeypatch):
    """Without a sample every row counts, for the profiles and for the level, whose
    quantile is exact; a task that hands its counts on early changes nothing."""
    monkeypatch.setattr(L, "PER_LANGUAGE", 2)
    monkeypatch.setattr(L, "BLOCK", 50)
    rows = [r for r in case() if r[0] < 100]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = {lang: ranked(sum((grams(t) for _, t, x in rows if x == lang), Counter())) for lang in ("aa", "bb", "cc")}
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    want = L.Profiles({lang: [code(g) for g in found] for lang, found in whole.items()})
    for held in (L.GRAMS, 10):
        monkeypatch.setattr(L, "GRAMS", held)
        got = L.learn(docs, sample=False)
        assert np.array_equal(got.keys, want.keys) and np.array_equal(got.ranks, want.ranks)
    told = L.identify(docs, want)
    monkeypatch.setattr(L, "REJECT_CAP", 1.0)
    for quantile in (0.01, 0.3, 1.0):
        monkeypatch.setattr(L, "REJECT_QUANTILE", quantile)
        scores = [want.predict(t)[1] for _, t, _ in rows]
        assert abs(L.reject_level(told) - L.REJECT_SHARE * np.quantile(scores, quantile)) < 1e-12
    assert L.reject_level(told.limit(0)) == 0.0
    monkeypatch.setattr(L, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        L.learn(docs, sample=False)
