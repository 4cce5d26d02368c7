"""Quality rules: statistics of a text, and a learned decision list over them.

The list is learned by sequential covering. Each rule is a conjunction of
thresholds on statistics; it is grown on two thirds of the labelled rows, one
condition at a time by FOIL's information gain, pruned from its end on the last
third, and accepted if it is precise enough there. What it covers is taken out
and the next rule is grown. The result is an ordered list that reads as text
and is emitted as one conditional Spark expression; nothing of it is a UDF.

Rules say what to drop; a text that no rule fits is kept. Learning uses at most
``SAMPLE`` labelled rows, those of least hash of the id, and only rows whose
crc32 of the id modulo 5 is not 0 (the others measure it). A null text has no
words, hence fails the base rule. Whole texts count; repeated rows get equal
results; labels of unknown ids and null labels are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches, id_bucket

#: Labelled rows that a list is learned from, at most.
SAMPLE = 20_000
#: Precision a rule must have on the pruning rows, rows it must cover there, rules of a list.
PRECISION, SUPPORT, MOST_RULES, MOST_CONDITIONS = 0.95, 5, 16, 4
#: Thresholds tried for each statistic.
CUTS = 48
WINDOW = 5
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_distinct", "n_lines"]
#: Statistics that rules speak of, as ratios of the counts.
RATIOS = {
    "n_words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
}
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that are found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words)) + np.uint64(1)
    mixed = ids[:, None] * _MULTIPLIERS[None, :]
    mixed ^= mixed >> np.uint64(29)
    codes = sum(mixed[k : k + n, k] * _MULTIPLIERS[(k + 1) % WINDOW] for k in range(WINDOW))
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    exact = Counter(tuple(words[s : s + WINDOW]) for s in starts.tolist())
    marks = np.zeros(len(words) + 1, np.int64)
    for s in starts.tolist():
        if exact[tuple(words[s : s + WINDOW])] > 1:
            marks[s] += 1
            marks[s + WINDOW] -= 1
    return int((np.cumsum(marks) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS``."""
    if not text:
        return (0,) * (len(COUNTS) - 1) + (0 if text is None else 1,)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = text.split("\n")
    with_word = [x for x in lines if len(x) > len(_BLANK.findall(x))] if "\n" in text else []
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    blanks = sum(map(text.count, " \t\n\r\x0b\x0c"))
    return (
        len(words),
        len(text) - blanks,
        sum(map(text.count, SYMBOLS)),
        len(with_word) - len(set(with_word)),
        repeated_words(words),
        upper,
        text.count("!"),
        len(set(words)),
        len(lines),
    )


def with_counts(df: DataFrame, text_col: str = "text", out_col: str = "counts") -> DataFrame:
    """``df`` with a struct of the counts (longs) of ``text_col``; a column of the
    name ``out_col`` is replaced."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=COUNTS)

    return df.withColumn(out_col, counted(F.col(text_col)))


def base_failed(c: str = "counts") -> Column:
    return (F.col(f"{c}.n_words") < 10) | (100 * F.col(f"{c}.n_repeat_words") > 20 * F.col(f"{c}.n_words"))


def ratio(name: str, c: str = "counts") -> Column:
    over, under = RATIOS[name]
    value = F.col(f"{c}.{over}").cast("double")
    return value / F.greatest(F.col(f"{c}.{under}"), F.lit(1)) if under else value


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    cut: float

    def fits(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] > self.cut if self.above else x[self.statistic] <= self.cut

    def column(self, c: str) -> Column:
        return ratio(self.statistic, c) > self.cut if self.above else ratio(self.statistic, c) <= self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that fits drops the text."""

    rules: list[list[Condition]]

    def verdict(self, c: str = "counts") -> Column:
        """True for a text to keep, as CASE WHEN rule THEN false ... ELSE true."""
        out: Column | None = None
        for rule in self.rules:
            fits = reduce(lambda a, b: a & b, (k.column(c) for k in rule))
            out = F.when(fits, F.lit(False)) if out is None else out.when(fits, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([f"drop if {' and '.join(map(str, r))}" for r in self.rules] + ["keep"])


def _covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for k in rule:
        out &= k.fits(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and (~bad & inside).any():
        p0, n0 = int((bad & inside).sum()), int(inside.sum())
        best, gain = None, 1e-9
        for name, values in x.items():
            own = values[inside]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 1)))
            for cut in (cuts[:-1] + cuts[1:]) / 2:
                over = own > cut
                for above, part in ((True, over), (False, ~over)):
                    p, n = int((bad[inside] & part).sum()), int(part.sum())
                    if p and n < n0:
                        g = p * (math.log2(p / n) - math.log2(p0 / n0))
                        if g > gain:
                            best, gain = Condition(name, above, float(cut)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.fits(x)
    return rule


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> DecisionList:
    """Sequential covering; ``part`` (0, 1 or 2) says which third a row is in, 2 prunes."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES:
        g, p = left & (part != 2), left & (part == 2)
        if not (bad & g).any() or not p.any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g])
        px, pb = {k: v[p] for k, v in x.items()}, bad[p]

        def worth(r: list[Condition], px=px, pb=pb) -> float:
            c = _covered(r, px, len(pb))
            return ((pb & c).sum() - (~pb & c).sum()) / max(1, c.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covered(rule, px, len(pb))
        if not rule or c.sum() < SUPPORT or (pb & c).sum() < PRECISION * c.sum():
            break
        rules.append(rule)
        left &= ~_covered(rule, x, len(bad))
    return DecisionList(rules)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DecisionList:
    """A list from the labelled rows of ``docs``; label 0 is what to drop."""
    i = F.col(id_col)
    usable = labels.where(F.col(label_col).isNotNull() & (id_bucket(i, 5) != 0)).groupBy(id_col).agg(F.min(label_col).alias("_rv_label"))
    chosen = usable.select(i.alias("_rv_id"), "_rv_label", F.xxhash64(i).alias("_rv_hash")).orderBy("_rv_hash", "_rv_id").limit(SAMPLE)
    own = docs.select(i.alias("_rv_id"), F.col(text_col).alias("_rv_text")).join(F.broadcast(chosen), "_rv_id")
    counted = with_counts(own, "_rv_text")
    rows = counted.where(~base_failed()).select("_rv_label", "_rv_hash", *(ratio(r).alias(r) for r in RATIOS)).toPandas()
    rows = rows.sort_values(["_rv_hash", *RATIOS], kind="stable")
    return learn_list({r: rows[r].to_numpy() for r in RATIOS}, (rows["_rv_label"] == 0).to_numpy(), (rows["_rv_hash"].to_numpy() >> 7) % 3)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """``docs`` with ``counts`` (a struct), ``base_failed`` and ``kept``; columns of
    those names are replaced."""
    return with_counts(docs, text_col).withColumns({"base_failed": base_failed(), "kept": ~base_failed() & rules.verdict()})


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows."""
    out = judge(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", *(f"counts.{c}" for c in COUNTS[:5]), "base_failed", "kept")
