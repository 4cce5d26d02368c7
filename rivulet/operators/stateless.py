"""Projection, filter, unnesting, and calls to the outside."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from rivulet.errors import PlanError


def project(df: DataFrame, *exprs: Column | str) -> DataFrame:
    return df.select(*exprs)


def keep(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true; null drops a row."""
    return df.where(condition)


def unnest(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """A row for each element of a list; a null or empty list has none."""
    if not isinstance(df.schema[column].dataType, ArrayType):
        raise PlanError(f"unnest needs a list, {column} is {df.schema[column].dataType.simpleString()}")
    return df.withColumn(out or column, F.explode(column))


def async_map(df: DataFrame, fn: Callable[..., Awaitable[Any]], inputs: list[str], out: str, kind: DataType | str, concurrency: int = 100, timeout: float = 10.0, ordered: bool = True) -> DataFrame:
    """``df`` with what an asynchronous function makes of some columns.

    At most ``concurrency`` calls of a task are under way; one that takes longer
    than ``timeout`` seconds fails the task. Unordered, rows leave as calls end.
    """
    dtype = kind if isinstance(kind, DataType) else StructType.fromDDL(f"x {kind}")["x"].dataType
    schema = StructType([*df.schema.fields, StructField(out, dtype)])
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        async def all_of(batch: pd.DataFrame) -> pd.DataFrame:
            gate, ended, results = asyncio.Semaphore(concurrency), [], [None] * len(batch)

            async def one(k: int, values: tuple) -> None:
                async with gate:
                    results[k] = await asyncio.wait_for(fn(*values), timeout)
                    ended.append(k)

            await asyncio.gather(*(one(k, v) for k, v in enumerate(zip(*(batch[c] for c in inputs), strict=True))))
            full = batch.assign(**{out: pd.Series(results, index=batch.index, dtype=object)})
            return full if ordered else full.iloc[ended]

        for batch in batches:
            yield asyncio.run(all_of(batch))[[*names, out]]

    return df.mapInPandas(run, schema)
