"""The corpus pipeline: five stages, each over all that the one before kept.

Counted as part of ``rivulet.llm``. Each stage's function takes (spark, docs,
sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared
folder and reads again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, decontaminate, langid, linededup, registry, simhash
from rivulet.llm.common import discard, read, scratch, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or like no language of the profiles, go. Profiles
    and level are of all rows outside the held-out part; texts are scored once."""
    known = ~langid.held_out(F.col("doc_id"))
    profiles = langid.learn(docs.where(known), sample=False)
    out = ("_rv_lang", "_rv_score")
    told = stored(langid.identify(docs, profiles, out=out), "told")
    level = langid.reject_level(told.where(known), out=out)
    return told.where((F.col("_rv_lang") != langid.UNKNOWN) & (F.col("_rv_score") >= level)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; n_chars follows the text. A document
    without a line left goes too."""
    done = linededup.dedup_lines(docs, threshold=linededup.THRESHOLD)
    # past a generator no filter is pushed down, which would make the text again for each time it is named
    done = done.select(F.inline_outer(F.array(F.struct(*done.columns))))
    kept = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: that of least id (null as greatest),
    then of least hash of the text."""
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a whole window of a benchmark item go, however long they
    are, and so do those of which a twentieth or more is in shorter items."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"), any_window=True).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    path = public_tokenizers.path(registry.VOCABULARY)
    done = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN), path)
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("bpe", tokens),
]

#: Learned profiles and fingerprints are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            kept = stored(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
        if k:
            discard(docs)
        docs = kept
    return docs
