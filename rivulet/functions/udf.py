"""User-defined functions: scalar, aggregate and table functions for SQL.

Scalar and aggregate functions get Arrow batches as pandas Series; a table
function is a class whose ``eval`` yields rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rivulet.errors import PlanError

LANGUAGES = ("python",)


def register_scalar(spark: SparkSession, name: str, fn: Callable[..., pd.Series], returns: str, language: str = "python"):
    """A function of columns, a Series for each, that gives a Series."""
    if language.lower() not in LANGUAGES:
        raise PlanError(f"functions in {language} are not supported")

    def call(*columns: pd.Series) -> pd.Series:
        return fn(*columns)

    return spark.udf.register(name, F.pandas_udf(call, returns, F.PandasUDFType.SCALAR))


def register_aggregate(spark: SparkSession, name: str, fn: Callable[..., object], returns: str):
    """A function of all a group's values that gives one value. A group is held
    in one task; prefer built-in aggregates for large groups."""

    def call(column: pd.Series) -> object:
        return fn(column)

    return spark.udf.register(name, F.pandas_udf(call, returns, F.PandasUDFType.GROUPED_AGG))


def register_table(spark: SparkSession, name: str, kind: type, returns: str):
    """A table function, called in FROM, LATERAL joins included."""
    return spark.udtf.register(name, F.udtf(kind, returnType=returns))
