"""Window functions over windowed rows, and top-k within a window.

Spark has no OVER on streams. As append mode emits all rows of a window in one
batch, ``on_stream`` computes it batch by batch on the finished windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rivulet.errors import PlanError


def spec(partition: list[str], order: list[Column | str], window: str = "window") -> WindowSpec:
    """Partitioned by the window column and others, ordered, nulls last."""
    return Window.partitionBy(window, *partition).orderBy(*(F.asc_nulls_last(c) if isinstance(c, str) else c for c in order))


def with_over(df: DataFrame, columns: dict[str, Column], window: str = "window") -> DataFrame:
    """``df`` with window-function columns; the rows must be windowed."""
    if window not in df.columns:
        raise PlanError("window functions need a windowed input")
    return df.withColumns(columns)


def top_k(df: DataFrame, k: int, order: list[Column | str], partition: list[str] | None = None, rank: str = "rank", window: str = "window") -> DataFrame:
    """The first k rows of each window and partition, by ``order``. Spark limits
    each task's rows before the shuffle."""
    return with_over(df, {rank: F.row_number().over(spec(partition or [], order, window))}, window).where(F.col(rank) <= k)


def groups_frame_sum(df: DataFrame, value: str, partition: list[str], order: str, preceding: int, following: int, out: str) -> DataFrame:
    """A sum over a GROUPS frame (peers of equal order count as one): ranks of
    peers stand in for the groups, and RANGE over them for the frame."""
    by = Window.partitionBy(*partition)
    ranked = df.withColumn("_rv_group", F.dense_rank().over(by.orderBy(order)))
    return ranked.withColumn(out, F.sum(value).over(by.orderBy("_rv_group").rangeBetween(-preceding, following))).drop("_rv_group")


def on_stream(df: DataFrame, apply: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None]):
    """A stream writer that applies OVER to each batch of finished windows and
    hands the result to ``write`` with the batch's number."""
    return df.writeStream.outputMode("append").foreachBatch(lambda rows, number: write(apply(rows), number))
