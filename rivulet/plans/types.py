"""Types of the dialect's column definitions as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from rivulet.errors import PlanError

#: The dialect's names of simple types.
SIMPLE: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "bool": T.BooleanType(),
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "int2": T.ShortType(),
    "int": T.IntegerType(), "integer": T.IntegerType(), "int4": T.IntegerType(),
    "bigint": T.LongType(), "int8": T.LongType(),
    "tinyint unsigned": T.ShortType(), "smallint unsigned": T.IntegerType(), "int2 unsigned": T.IntegerType(),
    "int unsigned": T.LongType(), "integer unsigned": T.LongType(), "int4 unsigned": T.LongType(),
    "bigint unsigned": T.DecimalType(20, 0), "int8 unsigned": T.DecimalType(20, 0),
    "float": T.FloatType(), "real": T.FloatType(), "float4": T.FloatType(),
    "double": T.DoubleType(), "double precision": T.DoubleType(), "float8": T.DoubleType(),
    "char": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "string": T.StringType(),
    "timestamp": T.TimestampType(), "datetime": T.TimestampType(), "timestamp without time zone": T.TimestampType(),
    "date": T.DateType(), "time": T.StringType(), "bytea": T.BinaryType(),
    "interval": T.DayTimeIntervalType(), "json": T.StringType(),
}
#: Largest values of unsigned types, checked as rows are read.
UNSIGNED = {"tinyint unsigned": 2**8 - 1, "smallint unsigned": 2**16 - 1, "int2 unsigned": 2**16 - 1, "int unsigned": 2**32 - 1, "integer unsigned": 2**32 - 1, "int4 unsigned": 2**32 - 1, "bigint unsigned": 2**64 - 1, "int8 unsigned": 2**64 - 1}


def _split(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(text[at:k].strip())
            at = k + 1
    return [*out, text[at:].strip()]


def spark_type(text: str) -> T.DataType:
    """The Spark type of a type's text; an error if the dialect has none."""
    t = re.sub(r"\s+", " ", text.strip().lower())
    t = re.sub(r"\s*([<>(),\[\]])\s*", r"\1", t)
    if t in SIMPLE:
        return SIMPLE[t]
    if t.endswith("[]"):
        return T.ArrayType(_element(t[:-2]))
    if m := re.fullmatch(r"array<(.+)>", t):
        return T.ArrayType(_element(m[1]))
    if m := re.fullmatch(r"(?:char|varchar|char varying)\(\d+\)", t):
        return T.StringType()
    if m := re.fullmatch(r"(?:timestamp|datetime)\((\d+)\)", t):
        if int(m[1]) not in (0, 3, 6, 9):
            raise PlanError(f"unsupported precision of {text}: 0, 3, 6 or 9")
        return T.TimestampType()
    if m := re.fullmatch(r"(?:numeric|decimal)(?:\((\d+)(?:,(-?\d+))?\))?", t):
        p, s = int(m[1] or 38), int(m[2] or (10 if m[1] is None else 0))
        if not 1 <= p <= 38 or not 0 <= s <= p:
            raise PlanError(f"invalid precision or scale of {text}")
        return T.DecimalType(p, s)
    if m := re.fullmatch(r"struct<(.+)>", t):
        fields = []
        for part in _split(text.strip()[7:-1]):
            name, _, kind = part.partition(" ")
            if not kind:
                raise PlanError(f"fields of a struct need names: {text}")
            fields.append(T.StructField(name.strip('"`'), spark_type(kind)))
        return T.StructType(fields)
    raise PlanError(f"Unsupported SQL type: {text}")


def _element(text: str) -> T.DataType:
    if text not in SIMPLE and not re.match(r"(numeric|decimal|varchar|char|timestamp|datetime)\(", text):
        raise PlanError(f"unsupported element type of a list: {text}")
    return spark_type(text)
