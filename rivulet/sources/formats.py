"""Records to columns and back: JSON, raw values, newline framing, Debezium."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import PlanError
from rivulet.plans.ddl import Column as ColumnDef
from rivulet.plans.types import UNSIGNED


_BAD = "_rv_bad_record"


def decode_json(records: DataFrame, schema: T.StructType, bad_data: str = "fail", value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """A row for each JSON record; fields not in the schema are ignored. Bad
    records fail the query or are dropped; empty records (tombstones) go. The
    columns of ``keep`` stay beside the fields."""
    text = records.where(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("_rv_text"), *keep)
    if bad_data == "drop":  # no JSON, or a field of another type
        marked = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
        read = text.select(F.from_json("_rv_text", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"), *keep)
        return read.where(F.col("r").isNotNull() & F.col(f"r.{_BAD}").isNull()).select("r.*", *keep).drop(_BAD)
    return text.select(F.from_json("_rv_text", schema, {"mode": "FAILFAST"}).alias("r"), *keep).select("r.*", *keep)


def unframe(records: DataFrame, value: str = "value", max_length: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One record for each line of a record; longer lines than allowed are cut."""
    line = F.explode(F.split(F.col(value).cast("string"), "\n")).alias(value)
    out = records.select(line, *keep).where(F.col(value) != "")
    return out.select(F.substring(value, 1, max_length).alias(value), *keep) if max_length else out


def decode(records: DataFrame, fmt: str, schema: T.StructType, bad_data: str = "fail", keep: Sequence[str] = ()) -> DataFrame:
    """The rows of records; the columns of ``keep`` (a record's metadata) stay."""
    if fmt == "json":
        return decode_json(records, schema, bad_data, keep=keep)
    if fmt == "debezium_json":
        row = T.StructType([T.StructField("before", schema), T.StructField("after", schema), T.StructField("op", T.StringType())])
        return decode_json(records, row, bad_data, keep=keep)
    if fmt == "raw_string":
        return records.select(F.col("value").cast("string").alias("value"), *keep)
    if fmt == "raw_bytes":
        return records.select(F.col("value").cast("binary").alias("value"), *keep)
    raise PlanError(f"format '{fmt}' cannot be decoded from records")


def in_range(df: DataFrame, columns: list[ColumnDef]) -> DataFrame:
    """An error for values outside an unsigned type."""
    checked = {}
    for c in columns:
        if (top := UNSIGNED.get(" ".join(c.type.lower().split()))) is not None and c.expr is None:
            x = F.col(c.name)
            checked[c.name] = F.when(x.isNull() | x.between(0, F.lit(top).cast("decimal(20,0)")), x).otherwise(F.raise_error(F.lit(f"{c.name} is out of the range of {c.type}")).cast(df.schema[c.name].dataType))
    return df.withColumns(checked) if checked else df


def _encoded(name: str, kind: T.DataType, timestamps: str, decimals: str) -> Column:
    x = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        t = x.cast("timestamp")
        return F.unix_millis(t) if timestamps == "unix_millis" else F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if isinstance(kind, T.DecimalType):
        if decimals == "string":
            return x.cast("string")
        if decimals == "bytes":
            return F.base64(F.unhex(F.lpad(_twos_complement(x, kind), 32, "0")))
        return x
    if isinstance(kind, T.BinaryType):
        return F.base64(x)
    return x


def _twos_complement(x: Column, kind: T.DecimalType) -> Column:
    """32 hexadecimal digits of the unscaled value in 128 bits, big endian.

    Spark's hex takes 64 bits, so the value goes in two halves: n = high * 2^60 + low."""
    whole = F.round(x * F.lit(10**kind.scale).cast(T.DecimalType(38, 0)), 0).cast(T.DecimalType(38, 0)) if kind.precision + kind.scale <= 37 else F.regexp_replace(x.cast("string"), r"\.", "").cast(T.DecimalType(38, 0))
    step = F.lit(1 << 60).cast(T.DecimalType(38, 0))
    low = F.pmod(whole, step)
    high = ((whole - low) / step).cast(T.DecimalType(38, 0))
    top = F.hex(high.cast("bigint"))
    top = F.when(whole < 0, F.lpad(top, 17, "F")).otherwise(F.lpad(top, 17, "0"))
    return F.concat(top, F.lpad(F.hex(low.cast("bigint")), 15, "0"))


def encode_json(df: DataFrame, timestamps: str = "rfc3339", decimals: str = "number", hidden: str = "_timestamp") -> DataFrame:
    """``value``: each row as JSON, nulls stated, the hidden time left out."""
    if timestamps not in ("rfc3339", "unix_millis"):
        raise PlanError("json.timestamp_format is rfc3339 or unix_millis")
    if decimals not in ("number", "string", "bytes"):
        raise PlanError("json.decimal_encoding is number, string or bytes")
    fields = [_encoded(f.name, f.dataType, timestamps, decimals).alias(f.name) for f in df.schema.fields if f.name != hidden]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
