"""Writers of continuous queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from rivulet.errors import PlanError
from rivulet.operators.cdc import META, pack
from rivulet.plans.catalog import ADAPTERS, FORMATS
from rivulet.plans.options import Options
from rivulet.sources.formats import encode_json

TIME = "_timestamp"


def check(options: dict[str, str], updating: bool) -> None:
    o = Options(options)
    adapter, fmt = (options.get("connector") or "").lower(), options.get("format", "json").lower()
    if not adapter:
        raise PlanError("missing option 'connector'")
    if adapter not in ADAPTERS:
        raise PlanError(f"Unknown adapter '{adapter}'")
    if fmt not in FORMATS:
        raise PlanError(f"unknown format '{fmt}'")
    if updating and fmt != "debezium_json" and adapter not in ("memory", "blackhole"):
        raise PlanError("the query updates its rows; the sink needs format 'debezium_json'")
    if adapter == "filesystem" and not o.get("path"):
        raise PlanError("missing option 'path'")
    if adapter == "kafka" and not o.get("topic"):
        raise PlanError("missing option 'topic'")
    if o.get("sink.commit.mode", "at_least_once").replace("-", "_") not in ("at_least_once", "exactly_once"):
        raise PlanError("sink.commit.mode is at_least_once or exactly_once")


def shaped(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """Rows as the sink's format has them."""
    o = Options(options)
    fmt = options.get("format", "json").lower()
    if fmt == "debezium_json":
        order = "_rv_seq"
        rows = df.drop(TIME)
        rows = pack(rows if order in rows.columns else rows.withColumn(order, F.lit(0)), order)
        return encode_json(rows, o.get("json.timestamp_format", "rfc3339"), o.get("json.decimal_encoding", "number"))
    plain = df.drop(TIME, "_rv_seq")
    if options["connector"].lower() in ("memory", "blackhole") or fmt in ("parquet", "csv"):
        return plain
    if fmt == "raw_string":
        return plain.select(F.col("value").cast("string").alias("value"))
    if fmt == "raw_bytes":
        return plain.select(F.col("value").cast("binary").alias("value"))
    out = encode_json(plain, o.get("json.timestamp_format", "rfc3339"), o.get("json.decimal_encoding", "number"))
    if options["connector"].lower() == "kafka" and (key := o.get("sink.key.field", o.get("key.field"))):
        out = encode_json(plain).withColumn("key", F.get_json_object("value", f"$.{key}"))
    return out


def batch_writer(options: dict[str, str], name: str, memory: dict[str, list[DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A function that writes one batch so that writing it again does no harm:
    files of a batch go to a folder of its number, which is replaced."""
    adapter, fmt = options["connector"].lower(), options.get("format", "json").lower()

    def write(rows: DataFrame, number: int) -> None:
        out = shaped(rows, options)
        if adapter == "memory":
            rows_now = out.collect()  # a sink for trying things out
            memory.setdefault(name, []).append(out.sparkSession.createDataFrame(rows_now, out.schema))
        elif adapter == "filesystem":
            keys = [c.strip() for c in options.get("partition_by", "").split(",") if c.strip()]
            writer = out.write.mode("overwrite")
            if keys and fmt in ("parquet", "csv"):
                writer = writer.partitionBy(*keys)
            kind = fmt if fmt in ("parquet", "csv") else "text"
            writer.format(kind).save(f"{options['path']}/batch={number}")
        elif adapter == "kafka":
            out.write.format("kafka").option("kafka.bootstrap.servers", options.get("bootstrap.servers", "")).option("topic", options["topic"]).save()
        else:
            out.write.format("noop").mode("overwrite").save()

    return write


def writer(df: DataFrame, options: dict[str, str], name: str) -> DataStreamWriter:
    """A native writer for rows in append mode."""
    adapter, fmt = options["connector"].lower(), options.get("format", "json").lower()
    out = shaped(df, options)
    keys = [c.strip() for c in options.get("partition_by", "").split(",") if c.strip()]
    stream = out.writeStream.outputMode("append")
    if adapter == "memory":
        return stream.format("memory")
    if adapter == "filesystem":
        stream = stream.format(fmt if fmt in ("parquet", "csv") else "text").option("path", options["path"])
        return stream.partitionBy(*keys) if keys and fmt in ("parquet", "csv") else stream
    if adapter == "kafka":
        return stream.format("kafka").option("kafka.bootstrap.servers", options.get("bootstrap.servers", "")).option("topic", options["topic"])
    return stream.format("noop")
