"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import bpe, decontaminate, langid, linededup, qualitymil, qualityrules, simhash, toxicity, urlfilter, warc
from rivulet.llm.common import read

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(read(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(read(spark, sf_dir, "pages"))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(read(spark, sf_dir, "documents"))


def op6_qualityrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualityrules.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_qualitymil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualitymil.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_urlfilter": op1_urlfilter, "op2_warc": op2_warc, "op3_linededup": op3_linededup, "op4_simhash": op4_simhash, "op5_langid": op5_langid, "op6_qualityrules": op6_qualityrules, "op7_bpe": op7_bpe, "op8_qualitymil": op8_qualitymil, "op9_toxicity": op9_toxicity, "op10_decontaminate": op10_decontaminate}


def oracle_sql() -> dict[str, str]:
    return {"op1_urlfilter": urlfilter.ORACLE, "op2_warc": warc.ORACLE, "op3_linededup": linededup.ORACLE, "op10_decontaminate": decontaminate.ORACLE}
