"""Joins: within equal windows, of updating rows with a time to live, and with
reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.errors import PlanError

KINDS = {"inner", "left", "right", "full"}
#: A reference table of at most so many bytes, as its plan states them, is broadcast.
BROADCAST_BYTES = 64 << 20


def window_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", window: str = "window", condition: Column | None = None) -> DataFrame:
    """Join rows of the same window and equal keys. Columns of the right side
    other than the window and keys must have names of their own; null keys match
    nothing. On streams both sides are windowed aggregates, in append mode."""
    if how not in KINDS:
        raise PlanError(f"a window join is one of {sorted(KINDS)}, not {how}")
    for side in (left, right):
        if window not in side.columns:
            raise PlanError("joining windowed and un-windowed inputs is not supported")
    a, b = left.alias("l"), right.alias("r")
    on = F.col(f"l.{window}") == F.col(f"r.{window}")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    if condition is not None:
        on = on & condition
    joined = a.join(b, on, how)
    shared = [F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in (window, *keys)]
    rest = [F.col(f"l.{c}").alias(c) for c in left.columns if c not in (window, *keys)]
    clash = set(left.columns) & set(right.columns) - {window, *keys}
    if clash:
        raise PlanError(f"both sides have {sorted(clash)}")
    return joined.select(*shared, *rest, *(F.col(f"r.{c}").alias(c) for c in right.columns if c not in (window, *keys)))


def expiring_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_time: str, right_time: str, ttl: str = "1 day") -> DataFrame:
    """Inner equi-join of un-windowed rows no further apart in time than ``ttl``,
    which bounds the state on streams with watermarks. All columns of both sides
    stay; their names are distinct."""
    if not on:
        raise PlanError("an updating join needs an equality of keys")
    span = F.expr(f"INTERVAL {ttl}") if not ttl.lower().startswith("interval") else F.expr(ttl)
    a, b = F.col(left_time), F.col(right_time)
    match = (b >= a - span) & (b <= a + span)
    for x, y in on:
        match = match & (F.col(x) == F.col(y))
    return left.join(right, match, "inner")


def lookup_join(facts: DataFrame, reference: DataFrame, on: list[tuple[str, str]], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows with what a reference table has for their key (inner or left). The
    reference side is broadcast if its plan's size is within ``limit``, and
    shuffled beyond."""
    if how not in ("inner", "left"):
        raise PlanError(f"a lookup join is inner or left, not {how}")
    size = int(str(reference._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    match = F.lit(True)
    for x, y in on:
        match = match & (F.col(x) == F.col(y))
    return facts.join(F.broadcast(reference) if size <= limit else reference, match, how)


def interval_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_time: str, right_time: str, before: str, after: str, how: str = "inner") -> DataFrame:
    """Rows of equal keys whose right time lies within ``before`` and ``after`` of the left."""
    a, b = F.col(left_time), F.col(right_time)
    match = (b >= a - F.expr(f"INTERVAL {before}")) & (b <= a + F.expr(f"INTERVAL {after}"))
    for x, y in on:
        match = match & (F.col(x) == F.col(y))
    return left.join(right, match, how)
