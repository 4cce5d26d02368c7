"""The updating aggregate on streams: a retract/append changelog with state.

For each key that a batch touches, the old result is retracted if there was one
and it differs, and the new one appended if rows are left; an unchanged result
emits nothing. Rows that retract (``_updating_meta.is_retract``) are taken out
again. Sums and counts are kept as such, decimals as whole numbers of their last
digit; minimum, maximum and distinct counts keep how often each value occurs. A
key idle for the time to live is retracted
and forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rivulet.errors import PlanError
from rivulet.operators.cdc import META, multi_hash

FUNCTIONS = ("count", "sum", "avg", "min", "max", "count_distinct")
DAY_MS = 24 * 3600 * 1000


def _kept(state: dict, name: str, fn: str, values: pd.Series, known: np.ndarray, signs: np.ndarray, plain: Callable) -> None:
    """Take a batch's known values in (sign 1) or out (-1), equal ones at once."""
    values, signs = values[known], signs[known]
    if not len(values):
        return
    if fn in ("min", "max", "count_distinct"):
        seen = state.setdefault(name, {})
        try:
            counted = pd.Series(signs).groupby(values.to_numpy(), sort=False).sum()
        except TypeError:  # lists and the like
            counted = pd.Series(signs).groupby(values.map(str).to_numpy(), sort=False).sum()
        for value, n in counted.items():
            key = json.dumps(plain(value))
            seen[key] = seen.get(key, 0) + int(n)
            if seen[key] == 0:
                del seen[key]
        return
    n, s = state.setdefault(name, [0, 0])
    if fn != "count":
        if pd.api.types.is_float_dtype(values.dtype):
            s += float((values.to_numpy(np.float64) * signs).sum())
        else:  # exact, however large
            s += sum(sign * plain(v) for v, sign in zip(values, signs.tolist(), strict=True))
    state[name] = [n + int(signs.sum()), s]


def _result(state: dict, name: str, fn: str, scale: int | None = None):
    """The value of one aggregate; ``scale``, the digits of a decimal argument."""
    value = _plain(state, name, fn)
    if scale is None or value is None or fn in ("count", "count_distinct"):
        return value
    if fn == "avg":
        total, n = state[name][1], state[name][0]
        digits = 10**4  # an average has four digits more
        return Decimal((abs(total) * digits * 2 + n) // (2 * n) * (1 if total >= 0 else -1)).scaleb(-scale - 4)
    return Decimal(value).scaleb(-scale)


def _plain(state: dict, name: str, fn: str):
    held = state.get(name)
    if fn == "count":
        return held[0] if held else 0
    if fn == "count_distinct":
        return len(held or {})
    if fn in ("sum", "avg"):
        return None if not held or held[0] == 0 else held[1] / held[0] if fn == "avg" else held[1]
    return (min if fn == "min" else max)(map(json.loads, held)) if held else None


def updating_aggregate(df: DataFrame, keys: list[str], aggs: list[tuple[str, str, str]], ttl_ms: int | None = DAY_MS) -> DataFrame:
    """A changelog stream of ``aggs`` = (output, function, SQL argument) by ``keys``.

    Without a time to live (None) keys are kept for good; a query that is to end
    with its input needs that, as Spark waits for time-outs otherwise."""
    for _, fn, _ in aggs:
        if fn not in FUNCTIONS:
            raise PlanError(f"an updating aggregate cannot retract {fn}")
    gone = F.col(f"{META}.is_retract") if META in df.columns else F.lit(False)
    rows = df.select(*keys, *(F.expr(arg).alias(f"_rv_{out}") for out, _, arg in aggs), gone.alias("_rv_gone"))
    kinds: dict[str, T.DataType] = {"count": T.LongType(), "count_distinct": T.LongType(), "avg": T.DoubleType()}
    fields, scales, whole = [rows.schema[k] for k in keys], {}, []
    for out, fn, _ in aggs:
        given = rows.schema[f"_rv_{out}"].dataType
        if isinstance(given, T.DecimalType) and fn not in ("count", "count_distinct"):
            scales[out] = given.scale
            if fn == "avg":
                kinds[out] = T.DecimalType(min(38, given.precision + 4), given.scale + 4)
            elif fn == "sum":
                given = T.DecimalType(min(38, given.precision + 10), given.scale)
        wide = T.LongType() if isinstance(given, T.IntegralType) else T.DoubleType() if isinstance(given, (T.FloatType, T.DoubleType)) else given
        if isinstance(given, T.IntegralType):  # whole numbers with nulls among them would become floats in Python
            whole.append(out)
            rows = rows.withColumn(f"_rv_null_{out}", F.col(f"_rv_{out}").isNull()).withColumn(f"_rv_{out}", F.coalesce(f"_rv_{out}", F.lit(0).cast(given)))
        if fn in ("min", "max") and not isinstance(given, (T.NumericType, T.StringType, T.BooleanType)):
            raise PlanError(f"{fn} of {given.simpleString()} is not kept in updating aggregates")
        fields.append(T.StructField(out, kinds.get(out, wide) if out in scales else kinds.get(fn, wide)))
    schema = T.StructType([*fields, T.StructField("_rv_gone", T.BooleanType()), T.StructField("_rv_seq", T.LongType())])
    names = [out for out, _, _ in aggs]

    def plain(out: str, value):
        if isinstance(value, Decimal):
            return int(value.scaleb(scales[out])) if out in scales else str(value)
        value = value.item() if hasattr(value, "item") else value
        return value if isinstance(value, (str, int, float, bool)) else str(value)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"rows": 0, "state": {}}
        before = [_result(held["state"], out, fn, scales.get(out)) for out, fn, _ in aggs] if held["rows"] else None
        if state.hasTimedOut:
            state.remove()
            after = None
        else:
            for batch in batches:
                signs = np.where(batch["_rv_gone"].to_numpy(bool), -1, 1)
                held["rows"] += int(signs.sum())
                for out, fn, _ in aggs:
                    values = batch[f"_rv_{out}"]
                    known = ~batch[f"_rv_null_{out}"].to_numpy(bool) if out in whole else values.notna().to_numpy()
                    _kept(held["state"], out, fn, values, known, signs, partial(plain, out))
            after = [_result(held["state"], out, fn, scales.get(out)) for out, fn, _ in aggs] if held["rows"] > 0 else None
            if after is None:
                if state.exists:
                    state.remove()
            else:
                state.update((json.dumps(held),))
                if ttl_ms is not None:
                    state.setTimeoutDuration(ttl_ms)
        out = []
        if before != after:
            if before is not None:
                out.append((*key, *before, True, 0))
            if after is not None:
                out.append((*key, *after, False, 1))
        if out:
            yield pd.DataFrame(out, columns=[*keys, *names, "_rv_gone", "_rv_seq"])

    grouped = rows.groupBy(*keys) if keys else rows.withColumn("_rv_all", F.lit(0)).groupBy("_rv_all")
    if not keys:
        inner = step

        def step(key, batches, state):  # the constant key stays out of the rows
            return inner((), batches, state)

    changes = grouped.applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    identity = multi_hash(*keys) if keys else F.unhex(F.lit("0" * 32))
    return changes.withColumn(META, F.struct(F.col("_rv_gone").alias("is_retract"), identity.alias("id"))).drop("_rv_gone")
