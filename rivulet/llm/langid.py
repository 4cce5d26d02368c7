"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams (1 to ``ORDER`` characters, of
letters folded to lower case, with one space between words) in order. A text's
own most frequent n-grams are compared with each profile by the out-of-place
distance: for each, how far its rank is from its rank in the profile, or
``DEPTH`` if the profile lacks it. The nearest profile wins; equal distances go
to the language first in alphabet.

Profiles are learned from all rows whose language is known, or, where asked for
(``digest`` does), from at most ``PER_LANGUAGE`` ids of each language, those of
least hash of the id: a documented, bounded sample. Their hashes are first
counted in classes of a logarithmic scale, so that only the few ids in the
classes that can matter are ranked, however many rows a language has. A text
without any letter, and null, is ``und`` with score 0. The score is how much
nearer the best profile is than no match at all, 0 to 1. Texts are taken whole,
in blocks whose counts are added up; an n-gram belongs to the block it starts
in. Repeated rows get equal results; without any labelled row all is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches, id_bucket, scratch, stored

ORDER, DEPTH, PER_LANGUAGE = 3, 400, 1500
#: Classes of hashes to a doubling.
CLASSES = 64
#: Languages a model may have at most; their profiles are broadcast.
LANGUAGES = 1000
BLOCK = 1 << 19
UNKNOWN = "und"
#: In the pipeline: a text is rejected if its score is under this share of what
#: all but a hundredth of the learning rows reach, or under the cap if that is
#: less (few learning rows fit their own profiles too well).
REJECT_QUANTILE, REJECT_SHARE, REJECT_CAP = 0.01, 0.6, 1 / 3
#: Bins of scores. A score is a whole number over DEPTH times at most DEPTH, so
#: that one bin has fewer than 1,000 different ones.
SCORE_BINS = 1 << 16
#: n-grams that a learning task counts before it hands the counts on.
GRAMS = 1 << 20
_SPACE = 0x20
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """For each code point of the basic plane: its lower case if it is a letter, else a space."""
    if not _FOLD:
        table = np.full(0x10000, _SPACE, np.int64)
        for cp in range(0x10000):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _FOLD.append(table)
    return _FOLD[0]


def _letters(text: str) -> np.ndarray:
    """Code points of the letters in lower case, one space for what stands between."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    wide = cps > 0xFFFF
    out = _fold_table()[np.where(wide, _SPACE, cps)]
    for k in np.flatnonzero(wide):
        ch = chr(cps[k])
        if ch.isalpha():
            out[k] = ord(ch.lower()[0])
    space = out == _SPACE
    return out[~(space & np.concatenate(([True], space[:-1])))]


def _counted(codes: np.ndarray, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes (21 bits a character) and how often each occurs; only those
    that start at one of the first ``starts`` characters."""
    grams, power = [codes[:starts]], codes
    for k in range(1, ORDER):
        power = (power[:-1] << 21) | codes[k:]
        grams.append(power[:starts])
    return np.unique(np.concatenate(grams), return_counts=True)


def _blocks(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The counts of each block of a long text."""
    for at in range(0, len(codes), BLOCK):
        yield _counted(codes[at : at + BLOCK + ORDER - 1], BLOCK)


def frequent(text: str | None, depth: int = DEPTH) -> np.ndarray:
    """The codes of the text's most frequent n-grams, in order; empty if it has no letter."""
    codes = _letters(text) if text else np.empty(0, np.int64)
    if not (codes != _SPACE).any():
        return np.empty(0, np.int64)
    if len(codes) <= BLOCK:
        keys, counts = _counted(codes)
    else:
        total: Counter = Counter()
        for keys, counts in _blocks(codes):
            total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        keys, counts = np.array(list(total), np.int64), np.array(list(total.values()), np.int64)
    real = keys != _SPACE
    keys, counts = keys[real], counts[real]
    if len(keys) > 4 * depth:
        least = np.partition(counts, len(counts) - depth)[len(counts) - depth]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:depth]


class Profiles:
    """Ranks of each known n-gram in each language."""

    def __init__(self, ranked: dict[str, list[int]], depth: int = DEPTH) -> None:
        self.names, self.depth = sorted(ranked), depth
        self.keys = np.array(sorted({k for v in ranked.values() for k in v}), np.int64)
        self.ranks = np.full((len(self.keys), len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            at = np.searchsorted(self.keys, np.array(ranked[name], np.int64))
            self.ranks[at, j] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = frequent(text, self.depth)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = np.where((self.keys[at] == own)[:, None], self.ranks[at], -1)
        far = np.where(ranks < 0, self.depth, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (self.depth * len(own)))


def _sample(docs: DataFrame, lang_col: str, text_col: str, id_col: str) -> DataFrame:
    """lang and text of the rows that profiles are learned from."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    hashed = F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 63) - 1))
    ids = labelled.select(F.col(lang_col).alias("_rv_lang"), F.col(id_col).alias("_rv_id"), hashed.alias("_rv_h")).withColumn("_rv_class", F.floor(F.log2(F.col("_rv_h") + F.lit(1.0)) * CLASSES).cast("int"))
    # at most 63 * CLASSES rows a language, whatever its size
    classes = ids.groupBy("_rv_lang", "_rv_class").agg(F.count("*").alias("n"))
    below = F.sum("n").over(W.partitionBy("_rv_lang").orderBy("_rv_class")) - F.col("n")
    upto = stored(classes.withColumn("below", below).where(F.col("below") < PER_LANGUAGE).groupBy("_rv_lang").agg(F.max("_rv_class").alias("_rv_last")), "classes")
    if (n := upto.count()) > LANGUAGES:
        raise ValueError(f"{n} languages; at most {LANGUAGES} can be learned")
    few = ids.join(F.broadcast(upto), "_rv_lang").where("_rv_class <= _rv_last")
    rank = F.row_number().over(W.partitionBy("_rv_lang").orderBy("_rv_h", "_rv_id"))
    chosen = few.withColumn("_rv_r", rank).where(F.col("_rv_r") <= PER_LANGUAGE).select("_rv_id").distinct()
    # ids alone, PER_LANGUAGE for each of at most LANGUAGES: few enough to send to all
    return labelled.select(F.col(id_col).alias("_rv_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_rv_id", "left_semi").select("lang", "text")


def _all_known(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang and text of all rows whose language is known."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    if (n := known.select("lang").distinct().count()) > LANGUAGES:
        raise ValueError(f"{n} languages; at most {LANGUAGES} can be learned")
    return known


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-grams added up."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: bool = True) -> Profiles:
    """Profiles from the rows of ``docs`` whose language is known, from a bounded
    ``sample`` of them or from all."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def counted() -> pd.DataFrame:
            rows = [(lang, k, c) for lang, (keys, counts) in total.items() for k, c in zip(keys.tolist(), counts.tolist(), strict=True) if k != _SPACE]
            total.clear()
            return pd.DataFrame(rows, columns=["lang", "gram", "n"])

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                parts, held = [total[lang]] if lang in total else [], 0
                for text in texts:
                    for keys, counts in _blocks(_letters(text)):
                        parts.append((keys, counts))
                        held += len(keys)
                        if held > GRAMS:
                            parts, held = [_added(parts)], 0
                if parts:
                    total[lang] = _added(parts)
                if sum(len(k) for k, _ in total.values()) > GRAMS:
                    yield counted()
        yield counted()

    with scratch(docs.sparkSession):
        rows = _sample(docs, lang_col, text_col, id_col) if sample else _all_known(docs, lang_col, text_col)
        grams = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        top = grams.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= DEPTH)
        rows = top.select("lang", "gram", "r").collect()  # DEPTH for each of at most LANGUAGES
    ranked: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(rows, key=lambda x: (x[0], x[2])):
        ranked.setdefault(lang, []).append(gram)
    return Profiles(ranked)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score; columns of the names
    in ``out`` are replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    tmp = "_rv_language"
    return docs.withColumn(tmp, predict(F.col(text_col))).withColumns({out[0]: F.col(f"{tmp}.lang"), out[1]: F.col(f"{tmp}.score")}).drop(tmp)


def reject_level(told: DataFrame, lang_col: str = "lang", text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> float:
    """The score under which a text is like no language of the profiles, from
    the scores in ``told`` (as ``identify`` returns it) of all rows that the
    profiles are learned from.

    The quantile is exact, between two scores in proportion: all scores are
    counted in bins, and then those of the two bins that it falls in one by one."""
    known = told.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(out[0]) != UNKNOWN)).select(F.col(out[1]).alias("s"), F.floor(F.col(out[1]) * SCORE_BINS).alias("b"))
    bins = sorted(known.groupBy("b").agg(F.count("*").alias("n")).collect())
    if not bins:
        return 0.0
    place = REJECT_QUANTILE * (sum(n for _, n in bins) - 1)

    def at(k: int) -> float:
        below = 0
        for b, n in bins:
            if k < below + n:
                break
            below += n
        for s, n in sorted(known.where(F.col("b") == b).groupBy("s").agg(F.count("*").alias("n")).collect()):
            below += n
            if k < below:
                return s
        raise AssertionError("the scores changed between two readings")

    low = at(int(place))
    part = place - int(place)
    level = low + part * (at(int(place) + 1) - low) if part else low
    return min(REJECT_CAP, REJECT_SHARE * level)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(id_bucket(doc_id, 4) == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, lang_pred, score."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
