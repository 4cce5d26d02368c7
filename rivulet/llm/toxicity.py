"""Toxicity by weak supervision.

Features of a text are its distinct words (letters only, folded), their
prefixes and suffixes. From labelled rows the features are found that speak for
toxicity; they are dealt into lexicon voters (of words, of prefixes, of
suffixes), beside pattern voters (shouting, exclamations, elongation) and clean
voters (no lexicon of a kind fits). A voter says toxic, clean, or abstains.

A generative label model estimates each voter's behaviour given the class by
expectation maximisation, anchored by the labelled rows, and the correlations
of voters within a class; a voter that repeats others is discounted for it. It
sees the votes of every row outside the held-out part, labelled or not: votes
are counted by pattern (at most 2^18, as lexicon and pattern voters are yes or
no), and the rows without a label weigh ``UNLABELLED_WEIGHT`` of the labelled
ones together, however many they are. A linear classifier (logistic, L1) is then
trained on the posterior labels of the labelled sample, and is what scores.

Labels come only from rows whose crc32 of the id modulo 3 is not 1, at most
``LABELLED`` of them, those of least hash of the id: a documented, bounded
sample. The classifier knows every feature of the sample with ``LEAST_SUPPORT``
rows and an association of ``LEAST_KNOWN``. Label, language, source and id are
no inputs of a score. Null and empty texts have no features and get the
intercept's score. Whole texts count; repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches, id_bucket, scratch, stored

#: Labelled rows learned from, at most; weight of all rows without a label beside them.
LABELLED, UNLABELLED_WEIGHT = 12_000, 1.0
#: What a feature of the classifier needs: rows, likelihood ratio statistic.
LEAST_SUPPORT, LEAST_KNOWN = 2, 2.0
#: What a lexicon's feature needs: toxic rows, likelihood ratio statistic, precision.
LEAST_ROWS, LEAST_G2, LEAST_PRECISION = 3, 16.0, 0.8
AFFIXES = (4, 5, 6)
VOTERS = {"word": 6, "prefix": 6, "suffix": 3}
#: Rounds of expectation maximisation, and of the classifier's descent.
EM_ROUNDS, ROUNDS, RATE, L1 = 12, 250, 0.5, 2e-4
THRESHOLD = 0.7
#: Words whose features a worker remembers.
REMEMBERED = 150_000
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = {
    "shouting": lambda t: sum(map(str.isupper, t)) > 0.5 * max(20, len(t)),
    "exclaiming": lambda t: t.count("!") > 5 and 100 * t.count("!") > len(t),
    "elongated": lambda t: re.search(r"([^\W\d_])\1{3}", t) is not None,
}


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in AFFIXES if len(word) > k), *(f"*{word[-k:]}" for k in AFFIXES if len(word) > k)]


def kind(feature: str) -> str:
    return "prefix" if feature.endswith("*") else "suffix" if feature.startswith("*") else "word"


class Vocabulary(dict):
    """Numbers of the known features of a word; works out what it does not hold."""

    def __init__(self, known: dict[str, int]) -> None:
        self.known = known

    def __reduce__(self):
        return Vocabulary, (self.known,)

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(k for f in features(word) if (k := self.known.get(f)) is not None)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str | None) -> set[int]:
        return {k for w in words(text) for k in self[w]}


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(id_bucket(doc_id, 3) == 1, F.lit(False))


def _g2(t: Column, n: Column, toxic: float, clean: float) -> Column:
    """Likelihood ratio statistic of a feature in t of ``toxic`` and n of ``clean`` rows."""
    share = (toxic / (toxic + clean)) if toxic + clean else 0.5
    both = t + n
    part = lambda x, p: F.when(x > 0, x * F.log(x / (both * p))).otherwise(0.0)
    return 2 * (part(t, max(share, 1e-9)) + part(n, max(1 - share, 1e-9)))


class LabelModel:
    """Voters' behaviour given the class, and how far they repeat each other.

    Votes are 1 (toxic), 0 (clean) and -1 (abstains)."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> None:
        """``labels`` has 0 or 1 for the anchoring rows and -1 for the others;
        ``weights``, how many rows each stands for (1 without)."""
        known, w = labels >= 0, np.ones(len(labels)) if weights is None else weights
        self.prior = float(np.clip(np.average(labels[known], weights=w[known]) if known.any() else 0.1, 0.01, 0.99))
        onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
        q = np.where(known, labels, self.prior).astype(np.float64)
        # only the anchoring rows speak in the first round
        self._estimate(onehot[known], q[known], w[known])
        self._correlate(votes[known], q[known], w[known])
        for _ in range(EM_ROUNDS):
            q = np.where(known, labels, self.posterior(votes))
            self._estimate(onehot, q, w)
            self._correlate(votes, q, w)

    def _estimate(self, onehot: np.ndarray, q: np.ndarray, w: np.ndarray) -> None:
        on = ((w * q)[:, None, None] * onehot).sum(axis=0) + 0.1
        off = ((w * (1 - q))[:, None, None] * onehot).sum(axis=0) + 0.1
        self.evidence = np.log(on / on.sum(axis=1, keepdims=True)) - np.log(off / off.sum(axis=1, keepdims=True))
        if w.sum():
            self.prior = float(np.clip(np.average(q, weights=w), 0.005, 0.995))

    def _correlate(self, votes: np.ndarray, q: np.ndarray, weights: np.ndarray) -> None:
        """Correlations within the classes; the discount of each voter."""
        total = np.zeros((votes.shape[1],) * 2)
        for w in (weights * q, weights * (1 - q)):
            if w.sum() > 1:
                x = votes - (w[:, None] * votes).sum(axis=0) / w.sum()
                cov = (w[:, None] * x).T @ x
                sd = np.sqrt(np.diag(cov)) + 1e-9
                total = np.maximum(total, cov / sd[:, None] / sd[None, :])
        np.fill_diagonal(total, 0)
        self.correlation = total
        self.discount = 1 / (1 + np.where(total > 0.2, total, 0).sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + sum(self.discount[j] * self.evidence[j][votes[:, j] + 1] for j in range(votes.shape[1]))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Classifier:
    """A sparse linear scorer over presence of features."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: float) -> None:
        used = {f: k for f, k in vocabulary.items() if weights[k] != 0}
        self.vocabulary, self.weights, self.bias = Vocabulary(used), weights, bias

    def score(self, text: str | None) -> float:
        x = self.bias + sum(self.weights[k] for k in sorted(self.vocabulary.of(text)))
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic loss on soft targets by proximal, per-feature scaled descent."""
    sizes = np.array([len(r) for r in rows])
    flat, row = np.concatenate(rows) if len(rows) else np.empty(0, np.int64), np.repeat(np.arange(len(rows)), sizes)
    w, bias = np.zeros(n), float(np.log(target.mean() + 1e-6) - np.log(1 - target.mean() + 1e-6)) if len(target) else 0.0
    past, past_bias = np.full(n, 1e-8), 1e-8
    for _ in range(ROUNDS):
        d = (1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[flat], len(rows)), -40, 40))) - target) / max(1, len(target))
        g = np.bincount(flat, d[row], n)
        past, past_bias = past + g * g, past_bias + d.sum() ** 2
        rate = RATE / np.sqrt(past)
        w = w - rate * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * L1)
        bias -= RATE / np.sqrt(past_bias) * d.sum()
    return w, bias


class Voters:
    """Lexicon voters by their features, and the pattern voters; a text's votes
    are one number, a bit for each voter that says toxic."""

    def __init__(self, speaking: list[str]) -> None:
        """The features that speak for toxicity, strongest first; each kind's are
        dealt to its voters in turn."""
        self.deal: dict[str, int] = {}
        first = 0
        for what, n in VOTERS.items():
            for k, f in enumerate(f for f in speaking if kind(f) == what):
                self.deal[f] = first + k % n
            first += n
        self.lexicon, self.first_pattern = Vocabulary(self.deal), first

    def code(self, text: str | None) -> int:
        told = sum(1 << j for j in self.lexicon.of(text))
        return told | sum(1 << self.first_pattern + j for j, fits in enumerate(PATTERNS.values()) if fits(text or ""))

    @staticmethod
    def votes(codes: np.ndarray) -> np.ndarray:
        """Votes of each voter: the lexicons of a kind and, after them, its clean
        voter; then the patterns."""
        bit = lambda j: codes >> j & 1 == 1
        out, first = [], 0
        for n in VOTERS.values():
            fits = [bit(first + j) for j in range(n)]
            out += [np.where(f, 1, -1) for f in fits]
            out.append(np.where(np.any(fits, axis=0), -1, 0))
            first += n
        out += [np.where(bit(first + j), 1, -1) for j in range(len(PATTERNS))]
        return np.stack(out, axis=1)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """The bounded sample: text, y (0 or 1) and the hash of the id."""
    i = F.col(id_col)
    usable = labels.where(F.col(label_col).isNotNull() & i.isNotNull()).groupBy(i.alias("_rv_id")).agg(F.min(label_col).cast("int").alias("_rv_y"))
    chosen = usable.where(~held_out(F.col("_rv_id"))).withColumn("_rv_hash", F.xxhash64("_rv_id")).orderBy("_rv_hash", "_rv_id").limit(LABELLED)
    return docs.select(i.alias("_rv_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_rv_id").select("text", F.col("_rv_y").alias("y"), F.col("_rv_hash").alias("h"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    bounded_batches(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col, label_col)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                rows[y] += 1
                seen[y].update({f for w in words(text) for f in features(w)})
        out = [(f, c if y else 0, 0 if y else c) for y in (0, 1) for f, c in seen[y].items()]
        yield pd.DataFrame([*out, ("", rows[1], rows[0])], columns=["feature", "t", "n"])

    with scratch(docs.sparkSession):
        tallies = sample.select("text", "y").mapInPandas(count, "feature string, t long, n long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        tallies = stored(tallies.where((F.col("feature") == "") | (F.col("t") + F.col("n") >= LEAST_SUPPORT)), "tallies")
        whole = tallies.where("feature = ''").first()
        toxic, clean = (float(whole["t"]), float(whole["n"])) if whole else (0.0, 0.0)
        strong = tallies.where("feature != ''").withColumn("g", F.round(_g2(F.col("t"), F.col("n"), toxic, clean), 6)).where(F.col("g") >= LEAST_KNOWN).collect()  # features of the sample
    strong.sort(key=lambda r: (-r["g"], r["feature"]))
    vocabulary = {r["feature"]: k for k, r in enumerate(strong)}
    voters = Voters([r["feature"] for r in strong if r["t"] >= LEAST_ROWS and r["g"] >= LEAST_G2 and r["t"] >= LEAST_PRECISION * (r["t"] + r["n"])])
    shared = docs.sparkSession.sparkContext.broadcast((Vocabulary(vocabulary), voters))

    @F.pandas_udf("found array<int>, code long")
    def found(texts: pd.Series) -> pd.DataFrame:
        known, voters = shared.value
        return pd.DataFrame({"found": [sorted(known.of(t)) for t in texts], "code": [voters.code(t) for t in texts]})

    @F.pandas_udf("long")
    def code(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value[1].code)

    rows = sample.select("h", "y", found("text").alias("x")).select("h", "y", "x.found", "x.code").toPandas()
    rows["key"] = rows["found"].map(lambda x: tuple(x[:8]))
    rows = rows.sort_values(["h", "y", "code", "key"], kind="stable")
    present = [np.asarray(x, np.int64) for x in rows["found"]]
    if not present:
        return Classifier({}, np.zeros(0), -5.0)
    patterns = docs.where(~held_out(F.col(id_col))).select(code(F.col(text_col)).alias("code")).groupBy("code").agg(F.count("*").alias("c")).collect()
    every = sorted((r["code"], r["c"]) for r in patterns)
    own, size = Voters.votes(rows["code"].to_numpy(np.int64)), len(rows)
    weights = np.array([c for _, c in every], np.float64)
    weights *= UNLABELLED_WEIGHT * size / max(1.0, weights.sum())
    votes = np.concatenate([own, Voters.votes(np.array([c for c, _ in every], np.int64))]) if every else own
    model = LabelModel(votes, np.concatenate([rows["y"].to_numpy(np.int64), np.full(len(every), -1)]), np.concatenate([np.ones(size), weights]))
    return Classifier(vocabulary, *fit_linear(present, model.posterior(own), len(vocabulary)))


def classify(docs: DataFrame, classifier: Classifier, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of those names are replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted."""
    out = classify(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
