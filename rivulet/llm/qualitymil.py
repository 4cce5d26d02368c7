"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded:
hashed character trigrams and shape statistics, then one learned hidden layer.
Gated attention weighs the passages (tanh gate times sigmoid gate), the weights
being learned from document labels alone, and the weighted sum of the encoded
passages is scored by a logistic output. Trained with Adam on all passages of at
most ``SAMPLE`` labelled rows, those of least hash of the id, whose crc32 of the
id modulo 5 is not 0; rows that would take the passages beyond
``SAMPLE_PASSAGES`` are left out whole.

Scoring streams over a document's passages with a running, rescaled sum, so a
very long text is taken whole in bounded memory. A null or empty text is one
empty passage. Label, language, source and id are no inputs. Repeated rows get
equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches, id_bucket, scratch, stored

#: Labelled rows trained on, at most, and passages of all of them.
SAMPLE, SAMPLE_PASSAGES = 4000, 100_000
PASSAGE = 96
#: Hashed trigram features, shape features, hidden units, attention units.
HASHED, SHAPE, HIDDEN, GATE = 256, 8, 24, 12
EPOCHS, RATE, BATCH, DECAY = 30, 0.01, 64, 1e-4
THRESHOLD = 0.3
#: Passages encoded at once, and passages multiplied at once in training.
BLOCK, PART = 512, 8192
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CLASS = np.zeros(256, np.int64)  # 1 lower, 2 upper, 3 digit, 4 symbol, 5 other punctuation, 6 above ASCII, 0 space
_CLASS[33:127] = 5
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[128:] = 6


def passages(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes and the passage that each belongs to."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    space = _SPACES[raw]
    begins = ~space & np.concatenate(([True], space[:-1])) if len(raw) else np.zeros(0, bool)
    return raw, np.maximum(np.cumsum(begins) - 1, 0) // PASSAGE


def encode(raw: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """(n, HASHED + SHAPE) features of passages numbered 0 to n-1."""
    out = np.zeros((n, HASHED + SHAPE), np.float32)
    if not len(raw):
        return out
    if len(raw) >= 3:
        b = raw.astype(np.uint32)
        code = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
        within = passage[:-2] == passage[2:]  # else blocks of passages would matter
        slot = (passage[:-2] * HASHED + (code >> np.uint32(24)).astype(np.int64) % HASHED)[within]
        hashed = np.sqrt(np.bincount(slot, minlength=n * HASHED).reshape(n, HASHED))
        out[:, :HASHED] = hashed / np.maximum(1e-6, np.sqrt((hashed**2).sum(axis=1, keepdims=True)))
    kinds = np.bincount(passage * 7 + _CLASS[raw], minlength=n * 7).reshape(n, 7).astype(np.float64)
    size = np.maximum(1, kinds.sum(axis=1))
    shape = out[:, HASHED:]
    shape[:, :6] = kinds[:, 1:] / size[:, None]
    shape[:, 6] = kinds[:, 0] / size
    # how many distinct trigram slots there are for the passage's length: few if words repeat
    shape[:, 7] = (out[:, :HASHED] > 0).sum(axis=1) / np.minimum(HASHED, size)
    return out


def blocks(text: str | None) -> Iterator[np.ndarray]:
    """Features of all the text's passages, ``BLOCK`` passages at a time."""
    raw, passage = passages(text)
    n = int(passage[-1]) + 1 if len(passage) else 1
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        lo, hi = np.searchsorted(passage, [at, at + m])
        yield encode(raw[lo:hi], passage[lo:hi] - at, m)


def encoded(text: str | None) -> bytes | None:
    """All the text's passages in 16 bits; nothing if they are more than a model is trained on."""
    n, parts = 0, []
    for x in blocks(text):
        n += len(x)
        if n > SAMPLE_PASSAGES:
            return None
        parts.append(x.astype(np.float16).tobytes())
    return b"".join(parts)


def _parts(bags: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The passages of all bags in order, at most ``PART`` at a time."""
    if sum(map(len, bags)) <= PART:
        yield np.concatenate(bags)
    else:
        yield from (bag[at : at + PART] for bag in bags for at in range(0, len(bag), PART))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Parameters, their gradients and the score."""

    def __init__(self, seed: int = 7) -> None:
        g = np.random.default_rng(seed)
        d = HASHED + SHAPE
        self.p = {
            "W": g.normal(0, 1 / np.sqrt(d) * 2, (d, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": g.normal(0, 0.3, (HIDDEN, GATE)), "U": g.normal(0, 0.3, (HIDDEN, GATE)), "a": g.normal(0, 0.3, GATE),
            "w": g.normal(0, 0.3, HIDDEN), "c": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(d), np.ones(d)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.p["W"] + self.p["b"])

    def attention(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, s = np.tanh(h @ self.p["V"]), _sigmoid(h @ self.p["U"])
        return t, s, (t * s) @ self.p["a"]

    def gradients(self, bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        sizes = np.array([len(b) for b in bags])
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        h = np.concatenate([self.hidden(x) for x in _parts(bags)])
        t, s, e = self.attention(h)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
        weight = e / np.repeat(np.add.reduceat(e, at), sizes)
        z = np.add.reduceat(weight[:, None] * h, at)
        d_out = (_sigmoid(z @ p["w"] + p["c"]) - y) / len(y)
        d_z = np.repeat(d_out[:, None] * p["w"], sizes, axis=0)
        d_weight = (d_z * h).sum(axis=1)
        d_e = weight * (d_weight - np.repeat(np.add.reduceat(weight * d_weight, at), sizes))
        d_t, d_s = d_e[:, None] * p["a"] * s * (1 - t**2), d_e[:, None] * p["a"] * t * s * (1 - s)
        d_h = (weight[:, None] * d_z + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h**2)
        d_W, done = DECAY * p["W"], 0
        for x in _parts(bags):
            d_W = d_W + ((x - self.mean) / self.scale).T @ d_h[done : done + len(x)]
            done += len(x)
        return {"W": d_W, "b": d_h.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_s, "a": ((t * s) * d_e[:, None]).sum(axis=0), "w": z.T @ d_out + DECAY * p["w"], "c": np.array([d_out.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> None:
        n = sum(map(len, bags))
        self.mean = sum(x.sum(axis=0, dtype=np.float64) for x in _parts(bags)) / n
        self.scale = np.sqrt(sum(((x - self.mean) ** 2).sum(axis=0) for x in _parts(bags)) / n) + 0.02
        g = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = g.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                step += 1
                for name, d in self.gradients([bags[i] for i in pick], y[pick]).items():
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.999 * v[name] + 0.001 * d**2
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)

    def score(self, text: str | None) -> float:
        """The probability of label 1; passages in blocks, the softmax rescaled as it goes."""
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in blocks(text):
            h = self.hidden(x)
            e = self.attention(h)[2]
            peak = max(top, float(e.max()))
            keep = np.exp(top - peak) if np.isfinite(top) else 0.0
            w = np.exp(e - peak)
            top, total, z = peak, total * keep + float(w.sum()), z * keep + w @ h
        return float(_sigmoid(z / total @ self.p["w"] + self.p["c"])[0])


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(id_bucket(doc_id, 5) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    i = F.col(id_col)
    bounded_batches(docs.sparkSession)
    usable = labels.where(F.col(label_col).isNotNull() & i.isNotNull() & ~held_out(i)).groupBy(id_col).agg(F.min(label_col).alias("_rv_y"))
    chosen = usable.select(i.alias("_rv_id"), "_rv_y", F.xxhash64(i).alias("_rv_hash")).orderBy("_rv_hash", "_rv_id").limit(SAMPLE)
    own = docs.select(i.alias("_rv_id"), F.col(text_col).alias("_rv_text")).join(F.broadcast(chosen), "_rv_id")

    @F.pandas_udf("binary")
    def bag(texts: pd.Series) -> pd.Series:
        return texts.map(encoded)

    key = ["_rv_hash", "_rv_y", "_rv_x"]
    with scratch(docs.sparkSession):
        bags = stored(own.select("_rv_hash", "_rv_y", bag("_rv_text").alias("x")).where("x is not null").withColumn("_rv_x", F.xxhash64("x")), "bags")
        sizes = bags.groupBy(*key).agg(F.count("*").alias("c"), F.first(F.octet_length("x")).alias("size")).orderBy(*key).limit(SAMPLE).collect()
        fit, n_rows, n_passages = [], 0, 0
        for r in sizes:
            more = r["c"] * (r["size"] // (2 * (HASHED + SHAPE)))
            if n_rows + r["c"] <= SAMPLE and n_passages + more <= SAMPLE_PASSAGES:
                fit.append(tuple(r[k] for k in key))
                n_rows, n_passages = n_rows + r["c"], n_passages + more
        model = Model()
        if fit:
            taken = docs.sparkSession.createDataFrame(fit, bags.select(*key).schema)
            rows = bags.join(F.broadcast(taken), key, "left_semi").toPandas().sort_values(key, kind="stable")
            model.fit([np.frombuffer(x, np.float16).reshape(-1, HASHED + SHAPE) for x in rows["x"]], rows["_rv_y"].to_numpy(np.float64))
    return model


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of those names are replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted."""
    out = classify(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
