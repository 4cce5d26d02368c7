"""Time-windowed aggregation, on bounded tables and on streams alike.

A window column is ``struct<start, end>``. ``size``, ``slide`` and ``gap`` are
Spark interval strings such as ``"10 minutes"``; windows are aligned to the
epoch. On a stream the time column needs a watermark; results leave once it has
passed the window's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.errors import PlanError


def _micros(interval: str) -> int:
    """The length of an interval of fixed units."""
    units = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}
    total, parts = 0, interval.lower().removeprefix("interval ").replace("'", "").split()
    if len(parts) % 2:
        raise PlanError(f"not an interval: {interval}")
    for number, unit in zip(parts[::2], parts[1::2], strict=True):
        if unit.rstrip("s") not in units:
            raise PlanError(f"a window takes intervals of fixed length, not {interval}")
        total += int(float(number) * units[unit.rstrip("s")])
    if total <= 0:
        raise PlanError(f"a window needs a positive length, not {interval}")
    return total


def tumble(time: str, size: str) -> Column:
    """Windows of one size, side by side."""
    return F.window(time, f"{_micros(size)} microseconds")


def hop(time: str, slide: str, size: str) -> Column:
    """Windows of ``size``, one every ``slide``; the size is a multiple of the slide."""
    s, w = _micros(slide), _micros(size)
    if w % s:
        raise PlanError(f"hop: the width {size} is no multiple of the slide {slide}")
    return F.window(time, f"{w} microseconds", f"{s} microseconds")


def session(time: str, gap: str) -> Column:
    """Runs of rows that lie no further apart than ``gap``."""
    return F.session_window(time, f"{_micros(gap)} microseconds")


def windowed(df: DataFrame, window: Column, keys: list[str | Column], aggs: list[Column], name: str = "window") -> DataFrame:
    """One row for each window and key: ``name``, the keys, the aggregates."""
    return df.groupBy(window.alias(name), *keys).agg(*aggs)


def hop_by_panes(df: DataFrame, time: str, slide: str, size: str, keys: list[str], sums: dict[str, Column], name: str = "window") -> DataFrame:
    """A hop of sums that folds rows into panes of one slide first.

    ``sums`` maps an output to what is summed up (``F.lit(1)`` counts). The
    plain hop copies each row size/slide times; this copies each pane's row.
    """
    panes = df.groupBy(F.window(time, f"{_micros(slide)} microseconds").alias("_rv_pane"), *keys).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    again = panes.withColumn("_rv_time", F.col("_rv_pane.start"))
    return again.groupBy(hop("_rv_time", slide, size).alias(name), *keys).agg(*(F.sum(k).alias(k) for k in sums))


def hop_distinct_by_panes(df: DataFrame, time: str, slide: str, size: str, keys: list[str], value: str, out: str, name: str = "window") -> DataFrame:
    """A hop that counts distinct values, of bounded tables: each value counts once
    for a pane of one slide, and only those are copied for the windows."""
    panes = df.groupBy(F.window(time, f"{_micros(slide)} microseconds").alias("_rv_pane"), *keys, value).agg(F.lit(1).alias("_rv_one"))
    again = panes.withColumn("_rv_time", F.col("_rv_pane.start"))
    return again.groupBy(hop("_rv_time", slide, size).alias(name), *keys).agg(F.count_distinct(value).alias(out))


def reaggregate(df: DataFrame, keys: list[str | Column], aggs: list[Column], name: str = "window") -> DataFrame:
    """Aggregate rows that carry a window already, within that window."""
    if name not in df.columns:
        raise PlanError(f"re-aggregation needs the window column {name}")
    return df.groupBy(name, *keys).agg(*aggs)


def distinct_within(df: DataFrame, window: Column, keys: list[str], value: str, out: str, name: str = "window") -> DataFrame:
    """Exact count of distinct values in each window; two steps, as streams need it."""
    once = df.where(F.col(value).isNotNull()).groupBy(window.alias(name), *keys, value).agg(F.lit(1).alias("_rv_one"))
    return once.groupBy(name, *keys).agg(F.count("*").alias(out))


def flat(df: DataFrame, name: str = "window") -> DataFrame:
    """``window_start`` and ``window_end`` in the place of the window column."""
    rest = [c for c in df.columns if c != name]
    return df.select(F.col(f"{name}.start").alias("window_start"), F.col(f"{name}.end").alias("window_end"), *rest)


def event_time(name: str = "window") -> Column:
    """The time of a windowed row: just before the window's end."""
    return F.col(f"{name}.end") - F.expr("INTERVAL 1 MICROSECOND")
