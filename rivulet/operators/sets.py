"""Unions, distinct rows and the set operations of batch mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.errors import PlanError


def union_all(*branches: DataFrame) -> DataFrame:
    """Rows of all branches, by position; the first one's names hold."""
    widths = {len(b.columns) for b in branches}
    if len(widths) != 1:
        raise PlanError("the branches of a union have different numbers of columns")
    return reduce(DataFrame.union, branches)


def union(*branches: DataFrame) -> DataFrame:
    return union_all(*branches).distinct()


def distinct(df: DataFrame, keys: list[str] | None = None, within_watermark: bool = False) -> DataFrame:
    """Distinct rows; on a stream, if asked, only as far as the watermark's delay."""
    if within_watermark:
        return df.dropDuplicatesWithinWatermark(keys) if keys else df.dropDuplicatesWithinWatermark()
    return df.dropDuplicates(keys) if keys else df.distinct()


def _batch(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise PlanError(f"{what} is for bounded tables")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    _batch(a, "INTERSECT")
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    _batch(a, "EXCEPT")
    return a.subtract(b)


def semi(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], anti: bool = False) -> DataFrame:
    """Rows of a with (or, anti, without) a partner in b."""
    _batch(a, "a semi join")
    return a.join(b, [F.col(x) == F.col(y) for x, y in on], "left_anti" if anti else "left_semi")


def keyed(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows of equal keys side by side in one partition."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
