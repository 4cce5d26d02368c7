"""Change data capture: Debezium envelopes to changelog rows and back, and the
retract/append changelog of an aggregate.

A changelog row has ``_updating_meta`` = struct<is_retract, id>: whether it takes
a row back, and 16 bytes that name the row's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.errors import PlanError

META = "_updating_meta"


def multi_hash(*cols: Column | str) -> Column:
    """128 bits of a row of values; nulls and types tell apart."""
    return F.unhex(F.md5(F.to_json(F.struct(*(F.col(c) if isinstance(c, str) else c for c in cols)), {"ignoreNullFields": "false"}).cast("binary")))


def _meta(retract: bool, key: Column) -> Column:
    return F.struct(F.lit(retract).alias("is_retract"), key.alias("id")).alias(META)


def unroll(envelopes: DataFrame, keys: list[str], before: str = "before", after: str = "after", op: str = "op") -> DataFrame:
    """Rows of envelopes: c and r append ``after``, d retracts ``before``, u does
    both in this order; another op is an error. Columns beside the envelope go."""
    if not keys:
        raise PlanError("a change stream needs a PRIMARY KEY")
    old, new, kind = F.col(before), F.col(after), F.col(op)
    row = lambda x, retract: F.struct(x.alias("row"), F.lit(retract).alias("gone"))
    changes = F.when(kind.isin("c", "r"), F.array(row(new, False))).when(kind == "d", F.array(row(old, True))).when(kind == "u", F.array(row(old, True), row(new, False))).otherwise(F.raise_error(F.concat(F.lit("unknown change operation "), F.coalesce(kind, F.lit("null")))))
    flat = envelopes.select(F.explode(changes).alias("x")).select("x.row.*", F.col("x.gone").alias("_rv_gone"))
    return flat.withColumn(META, F.struct(F.col("_rv_gone").alias("is_retract"), multi_hash(*keys).alias("id"))).drop("_rv_gone")


def pack(changelog: DataFrame, order: str, time: str | None = None) -> DataFrame:
    """One envelope for each id of a batch of changelog rows, told by its first
    and last row in ``order``: (+,+) c with the last, (-,-) d with the first,
    (-,+) u from first to last, (+,-) nothing. Rows without ``_updating_meta``
    are all appended."""
    rows = [c for c in changelog.columns if c not in (META, order)]
    value = F.struct(*rows)
    stamp = [F.col(time).alias("ts")] if time else []
    if META not in changelog.columns:
        empty = F.lit(None).cast(changelog.select(value.alias("v")).schema["v"].dataType)
        return changelog.select(empty.alias("before"), value.alias("after"), F.lit("c").alias("op"), *stamp)
    ends = changelog.groupBy(F.col(f"{META}.id").alias("id")).agg(
        F.min_by(value, order).alias("first"),
        F.max_by(value, order).alias("last"),
        F.min_by(F.col(f"{META}.is_retract"), order).alias("first_gone"),
        F.max_by(F.col(f"{META}.is_retract"), order).alias("last_gone"),
        *([F.max(time).alias("ts")] if time else []),
    )
    op = F.when(~F.col("first_gone") & ~F.col("last_gone"), "c").when(F.col("first_gone") & F.col("last_gone"), "d").when(F.col("first_gone"), "u")
    told = ends.withColumn("op", op).where("op is not null")
    return told.select(F.when(F.col("op") != "c", F.col("first")).alias("before"), F.when(F.col("op") != "d", F.col("last")).alias("after"), "op", *(["ts"] if time else []))


def changelog(df: DataFrame, keys: list[str], aggs: dict[str, Column], order: str) -> DataFrame:
    """What an updating aggregate emits if every row of a bounded table arrives
    alone, in ``order``: for each change of a key's result the old result is
    retracted and the new one appended; an unchanged result emits nothing.

    ``aggs`` maps an output to an aggregate column. ``_rv_seq`` numbers the rows
    of a key."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys).orderBy(order)
    now = df.select(*keys, order, F.struct(*(c.over(upto).alias(k) for k, c in aggs.items())).alias("_rv_new"))
    both = now.withColumn("_rv_old", F.lag("_rv_new").over(whole)).where(F.col("_rv_old").isNull() | (F.col("_rv_old") != F.col("_rv_new")))
    row = lambda c, gone: F.struct(F.col(c).alias("v"), F.lit(gone).alias("gone"))
    each = both.select(*keys, order, F.explode(F.when(F.col("_rv_old").isNull(), F.array(row("_rv_new", False))).otherwise(F.array(row("_rv_old", True), row("_rv_new", False)))).alias("x"))
    return each.select(*keys, order, "x.v.*", F.struct(F.col("x.gone").alias("is_retract"), multi_hash(*keys).alias("id")).alias(META))


def applied(changelog_rows: DataFrame, keys: list[str], sums: dict[str, str] | None = None, count: str = "n") -> DataFrame:
    """The aggregate of a stream of appends and retracts: rows and sums count
    with the sign of each change; a group without rows left is gone."""
    sign = F.when(F.col(f"{META}.is_retract"), -1).otherwise(1)
    out = changelog_rows.groupBy(*keys).agg(F.sum(sign).alias(count), *(F.sum(sign * F.col(c)).alias(k) for k, c in (sums or {}).items()))
    return out.where(F.col(count) > 0)
