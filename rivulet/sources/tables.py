"""Table definitions to DataFrames, bounded or streaming."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import PlanError
from rivulet.operators.cdc import META, unroll
from rivulet.plans.catalog import TableDef
from rivulet.plans.options import Options
from rivulet.plans.types import spark_type
from rivulet.sources.formats import decode, in_range, unframe

TIME = "_timestamp"
STARTS = {"latest": "latest", "earliest": "earliest", "group-offsets": "latest"}


def delay(table: TableDef) -> tuple[str, str | None]:
    """What a watermark stays behind by, as an interval, and the expression of
    an event time to keep instead if it is not simply the column less an interval."""
    if not table.watermark or table.watermark[1] is None:
        return "0 seconds", None
    column, expr = table.watermark
    if expr.strip().lower() == column:
        return "0 seconds", None
    m = re.fullmatch(rf"\s*{column}\s*-\s*interval\s+'?([\d.]+)'?\s*([a-z]+)?'?\s*(?:'\s*)?", expr.strip().lower()) or re.fullmatch(rf"\s*{column}\s*-\s*interval\s+'([\d.]+)\s+([a-z]+)'\s*", expr.strip().lower())
    return (f"{m[1]} {m[2] or 'seconds'}", None) if m else ("0 seconds", expr)


def _kafka(spark: SparkSession, table: TableDef, streaming: bool) -> DataFrame:
    o = Options(table.options)
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", o.get("bootstrap.servers", o.get("bootstrap_servers"))).option("subscribe", o.get("topic"))
    start = STARTS[o.get("scan.startup.mode", "latest")] if streaming else "earliest"
    reader = reader.option("startingOffsets", start).option("kafka.isolation.level", o.get("isolation.level", "read_committed"))
    if group := o.get("group.id", o.get("group_id")):
        reader = reader.option("kafka.group.id", group)
    if rate := o.integer("rate_limit.messages_per_second", None):
        reader = reader.option("maxOffsetsPerTrigger", str(rate))  # a trigger a second
    known = ("connector", "format", "type", "topic", "bootstrap", "scan", "isolation", "group", "rate_limit", "json", "bad_data", "framing", "idle", "lookup", "sink", "partition_by", "event_time_field", "watermark_field")
    for k, v in table.options.items():
        if not k.startswith(known):
            reader = reader.option(f"kafka.{k}", v)
    try:
        return reader.load()
    except Exception as e:
        raise PlanError(f"the kafka connector is not on the class path: {str(e)[:120]}") from None


def _files(spark: SparkSession, table: TableDef, streaming: bool) -> DataFrame:
    o = Options(table.options)
    path = o.get("path")
    if not path:
        raise PlanError("missing option 'path'")
    reader = spark.readStream if streaming else spark.read
    if table.format in ("parquet", "csv"):
        if streaming and (n := o.integer("max_files_per_trigger", None)):
            reader = reader.option("maxFilesPerTrigger", n)
        reader = reader.format(table.format).schema(table.schema())
        return (reader.option("header", o.get("csv.header", "true")) if table.format == "csv" else reader).load(path)
    if streaming and (n := o.integer("max_files_per_trigger", None)):
        reader = reader.option("maxFilesPerTrigger", n)
    return reader.format("text").load(path)


#: What a record carries beside its value, by the names that tables use.
METADATA = {"key": "key", "offset": "offset", "offset_id": "offset", "partition": "partition", "topic": "topic", "timestamp": "timestamp"}


def _decoded(rows: DataFrame, table: TableDef, o: Options) -> DataFrame:
    """The columns of a table's records, metadata columns among them."""
    wanted = {c.name: c.expr.removeprefix("metadata:").lower() for c in table.columns if (c.expr or "").startswith("metadata:")}
    for name, what in wanted.items():
        if METADATA.get(what) not in rows.columns:
            raise PlanError(f"column {name}: the {table.adapter} connector has no metadata {what!r}")
    kept = {name: f"_rv_meta_{name}" for name in wanted}
    rows = rows.withColumns({kept[name]: F.col(METADATA[what]) for name, what in wanted.items()}) if kept else rows
    if o.get("framing.method") == "newline":
        rows = unframe(rows, max_length=o.integer("framing.max_line_length", None), keep=list(kept.values()))
    out = decode(rows, table.format, table.schema(), o.get("bad_data", "fail"), list(kept.values()))
    types = {c.name: spark_type(c.type) for c in table.columns}
    return out.withColumns({name: F.col(k).cast(types[name]) for name, k in kept.items()}).drop(*kept.values()) if kept else out


def load(spark: SparkSession, table: TableDef, streaming: bool, memory: dict[str, DataFrame] | None = None) -> DataFrame:
    """The table's rows with their hidden time, watermarked on a stream."""
    o = Options(table.options)
    if table.adapter == "memory":
        if table.name not in (memory or {}):
            raise PlanError(f"no rows are bound to the memory table {table.name}")
        rows = memory[table.name]
        if streaming and not rows.isStreaming:
            raise PlanError(f"the rows bound to {table.name} are no stream")
        decoded = rows if "value" not in rows.columns or table.schema().fieldNames() == rows.columns else _decoded(rows, table, o)
    elif table.adapter == "rate":
        decoded = spark.readStream.format("rate").option("rowsPerSecond", o.get("rate_limit.messages_per_second", "1")).load() if streaming else spark.range(0).select(F.current_timestamp().alias("timestamp"), F.col("id").alias("value"))
    elif table.adapter == "blackhole":
        raise PlanError("blackhole is a sink")
    else:
        rows = _kafka(spark, table, streaming) if table.adapter == "kafka" else _files(spark, table, streaming)
        if table.format in ("parquet", "csv"):
            decoded = rows
        else:
            decoded = _decoded(rows, table, o)
    if table.updating:
        decoded = unroll(decoded, table.primary_key)
    decoded = in_range(decoded, table.columns)
    for c in table.columns:
        if c.expr and not c.expr.startswith("metadata:"):
            decoded = decoded.withColumn(c.name, F.expr(c.expr))
    if not table.watermark and TIME not in decoded.columns:
        if table.adapter == "kafka" and streaming:
            raise PlanError(f"table {table.name} needs a WATERMARK")
        return decoded
    interval, shifted = delay(table)
    time = F.expr(shifted) if shifted else F.col(table.watermark[0])
    decoded = decoded.where(F.col(table.watermark[0]).isNotNull()).withColumn(TIME, time.cast("timestamp"))
    return decoded.withWatermark(TIME, interval) if streaming else decoded


def hidden(columns: list[str]) -> list[str]:
    """The columns that a user sees."""
    return [c for c in columns if c not in (TIME, META)]
