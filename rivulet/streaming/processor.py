"""User processors: callbacks over byte records, with key/value state.

A processor runs as a stateful streaming query. Its inputs are streams of
``value`` (binary), told apart by ``source_id``; what it emits are rows of
``target`` and ``value``. Rows of one key (by default one key for all, so that
running totals are global; a task's ``key-by`` names a field of JSON records instead, and
spreads the work) go to one instance in order of arrival within a batch; state
lives in Spark's state store and survives restarts.

Around each batch of a key the other callbacks are made: ``check_heartbeat``
first (False fails the query); after the rows ``process_watermark`` for each
source whose latest record time has moved on, in milliseconds, where inputs have
times; then ``take_checkpoint`` with the number of the key's batch, since Spark
commits the state when the batch ends. What callbacks emit counts.
"""

from __future__ import annotations

import importlib.util
import inspect
import re
import time
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rivulet.errors import NotFound, PlanError
from rivulet.streaming.state import Backend, DictBackend, KvStore

#: The states of a deployed function.
STATES = ("Uninitialized", "Initialized", "Starting", "Running", "Checkpointing", "Stopping", "Stopped", "Closing", "Closed", "Error")


class Context:
    """What a processor sees of its surroundings."""

    def __init__(self, config: dict[str, Any], backend_of) -> None:
        self.config, self._backend_of = config, backend_of
        self.emitted: list[tuple[int, bytes]] = []
        self.watermarks: dict[int, int] = {}
        self._stores: dict[str, KvStore] = {}

    def emit(self, data: bytes, target: int = 0) -> None:
        self.emitted.append((target, bytes(data)))

    def emit_watermark(self, watermark: int, target: int = 0) -> None:
        """The latest watermark of a target; Spark carries time beside the rows, so
        it is kept for those that read the context and not sent on."""
        self.watermarks[target] = max(int(watermark), self.watermarks.get(target, int(watermark)))

    def get_or_create_kv_store(self, name: str) -> KvStore:
        if name not in self._stores:
            self._stores[name] = KvStore(self._backend_of(name))
        return self._stores[name]

    getOrCreateKVStore = get_or_create_kv_store


class Processor:
    """Base class; ``process`` is what must be there."""

    def init(self, ctx: Context, config: dict[str, Any]) -> None: ...

    def process(self, ctx: Context, source_id: int, data: bytes) -> None:
        raise NotImplementedError

    def process_watermark(self, ctx: Context, source_id: int, watermark: int) -> None: ...

    def take_checkpoint(self, ctx: Context, checkpoint_id: int) -> None: ...

    def check_heartbeat(self, ctx: Context) -> bool:
        return True

    def close(self, ctx: Context) -> None: ...

    def custom(self, payload: bytes) -> bytes:
        return b""


class _MapBackend(Backend):
    """One named store within Spark's map state."""

    def __init__(self, state, name: str) -> None:
        self.state, self.name = state, name

    def get(self, key: bytes) -> bytes | None:
        found = self.state.getValue((self.name, key)) if self.state.containsKey((self.name, key)) else None
        return None if found is None else bytes(found[0])

    def put(self, key: bytes, value: bytes) -> None:
        self.state.updateValue((self.name, key), (value,))

    def delete(self, key: bytes) -> None:
        self.state.removeKey((self.name, key))

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        return iter([(bytes(k[1]), bytes(v[0])) for k, v in self.state.iterator() if k[0] == self.name])


class _Bridge(StatefulProcessor):
    """A user's processor as Spark drives it."""

    def __init__(self, kind: type, config: dict[str, Any]) -> None:
        self.kind, self.config = kind, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("kv", "store string, k binary", "v binary")
        self.clock = handle.getMapState("clock", "what string", "at long")
        self.ctx = Context(self.config, lambda name: _MapBackend(self.state, name))
        self.processor, self.ready = self.kind(), False

    def _at(self, what: str) -> int | None:
        return int(self.clock.getValue((what,))[0]) if self.clock.containsKey((what,)) else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.ready:
            self.processor.init(self.ctx, self.config)
            self.ready = True
        if self.processor.check_heartbeat(self.ctx) is False:
            raise RuntimeError("the processor's heartbeat failed")
        latest: dict[int, int] = {}
        for batch in rows:
            for source, value, at in zip(batch["source_id"], batch["value"], batch["at"], strict=True):
                self.processor.process(self.ctx, int(source), bytes(value))
                if not pd.isna(at):
                    latest[int(source)] = max(int(at), latest.get(int(source), int(at)))
        for source, at in sorted(latest.items()):
            before = self._at(f"source {source}")
            if before is None or at > before:
                self.clock.updateValue((f"source {source}",), (at,))
                self.processor.process_watermark(self.ctx, source, at)
        number = (self._at("batch") or 0) + 1
        self.clock.updateValue(("batch",), (number,))
        self.processor.take_checkpoint(self.ctx, number)
        out, self.ctx.emitted = self.ctx.emitted, []
        yield pd.DataFrame({"target": pd.Series([t for t, _ in out], dtype="int32"), "value": pd.Series([v for _, v in out], dtype=object)})

    def close(self) -> None:
        if getattr(self, "ready", False):
            self.processor.close(self.ctx)


def run_bounded(kind: type, config: dict[str, Any], records: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The processor over a short list of records, without Spark: for tests."""
    held: dict[str, DictBackend] = {}
    ctx = Context(config, lambda name: held.setdefault(name, DictBackend()))
    p = kind()
    p.init(ctx, config)
    for source, data in records:
        p.process(ctx, source, data)
    p.close(ctx)
    return ctx.emitted


def processed(inputs: list[DataFrame], kind: type, config: dict[str, Any] | None = None, key: Column | None = None) -> DataFrame:
    """(target, value) rows that a processor emits over some input streams, which
    may have a ``timestamp`` beside the ``value``."""
    at = lambda df: F.unix_millis(F.col("timestamp").cast("timestamp")) if "timestamp" in df.columns else F.lit(None).cast("long")
    sources = [df.select(F.lit(k).alias("source_id"), F.col("value").cast("binary").alias("value"), at(df).alias("at")) for k, df in enumerate(inputs)]
    rows = reduce(DataFrame.unionByName, sources).where(F.col("value").isNotNull()).withColumn("_rv_key", key if key is not None else F.lit(0))
    return rows.groupBy("_rv_key").transformWithStateInPandas(_Bridge(kind, config or {}), "target int, value binary", "append", "none")


def read_config(text: str) -> dict[str, Any]:
    """A task's configuration from YAML: the library's reading if it is there,
    else of the plain subset of nested maps, lists and scalars."""
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text)


def _plain_yaml(text: str) -> dict[str, Any]:
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", y).rstrip() for y in text.split("\n")) if x.strip()]

    def scalar(s: str) -> Any:
        s = s.strip()
        if re.fullmatch(r"-?\d+", s):
            return int(s)
        if s in ("true", "false"):
            return s == "true"
        return s.strip("\"'") if s else None

    def block(k: int, depth: int) -> tuple[Any, int]:
        if lines[k][1].startswith("- "):
            out: list[Any] = []
            while k < len(lines) and lines[k][0] == depth and lines[k][1].startswith("- "):
                rest = lines[k][1][2:]
                if ":" in rest:
                    lines[k] = (depth + 2, rest)
                    item, k = block(k, depth + 2)
                else:
                    item, k = scalar(rest), k + 1
                out.append(item)
            return out, k
        found: dict[str, Any] = {}
        while k < len(lines) and lines[k][0] == depth and not lines[k][1].startswith("- "):
            name, _, rest = lines[k][1].partition(":")
            k += 1
            if rest.strip():
                found[name] = scalar(rest)
            elif k < len(lines) and (lines[k][0] > depth or lines[k][0] == depth and lines[k][1].startswith("- ")):
                found[name], k = block(k, lines[k][0])
            else:
                found[name] = None
        return found, k

    return block(0, lines[0][0])[0] if lines else {}


class Deployment:
    """A registered function and its query."""

    kind = "python"

    def __init__(self, spark: SparkSession, processor: type, config: dict[str, Any], checkpoints: str, inputs: list[DataFrame] | None = None) -> None:
        if not config.get("name"):
            raise PlanError("a function needs a name")
        self.spark, self.processor, self.config, self.checkpoints = spark, processor, config, checkpoints
        self.name, self.inputs, self.query, self.state = str(config["name"]).lower(), inputs, None, "Initialized"
        self.sink = None

    def _inputs(self) -> list[DataFrame]:
        if self.inputs is not None:
            return self.inputs
        found = []
        for group in self.config.get("input-groups") or []:
            for i in group.get("inputs") or []:
                if i.get("input-type") == "kafka":
                    found.append(self.spark.readStream.format("kafka").option("kafka.bootstrap.servers", i["bootstrap_servers"]).option("subscribe", i["topic"]).load())
                elif i.get("input-type") == "file":
                    found.append(self.spark.readStream.format("text").load(i["path"]))
                else:
                    raise PlanError(f"unknown input-type {i.get('input-type')!r}")
        if not found:
            raise PlanError("a function needs inputs")
        return found

    def _write(self, rows: DataFrame, number: int) -> None:
        """Each output takes its target's rows; a file's batch is replaced if written again."""
        for k, o in enumerate(self.config.get("outputs") or []):
            own = rows.where(F.col("target") == k).select("value")
            if o.get("output-type") == "kafka":
                own.write.format("kafka").option("kafka.bootstrap.servers", o["bootstrap_servers"]).option("topic", o["topic"]).save()
            elif o.get("output-type") == "file":
                own.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").text(f"{o['path']}/batch={number}")
            else:
                raise PlanError(f"unknown output-type {o.get('output-type')!r}")

    def start(self, available_now: bool = False) -> None:
        if self.state == "Running" and self.query is not None and self.query.isActive:
            raise PlanError(f"function {self.name} is running")
        self.state = "Starting"
        init = self.config.get("init-config") or {}
        field = self.config.get("key-by")
        key = F.coalesce(F.get_json_object(F.col("value").cast("string"), f"$.{field}"), F.lit("")) if field else None
        out = processed(self._inputs(), self.processor, init, key)
        writer = out.writeStream.outputMode("append").queryName(f"function_{self.name}").option("checkpointLocation", f"{self.checkpoints}/function-{self.name}")
        writer = writer.foreachBatch(self.sink or self._write)
        if available_now:
            writer = writer.trigger(availableNow=True)
        self.query = writer.start()
        self.state = "Running"

    def stop(self) -> None:
        if self.query is None:
            raise PlanError(f"function {self.name} is not running")
        self.query.stop()
        self.state = "Stopped"

    def close(self) -> None:
        if self.query is not None:
            self.query.stop()
        self.state = "Closed"

    def status(self) -> str:
        if self.query is not None and self.query.exception() is not None:
            return "Error"
        if self.state == "Running" and not self.query.isActive:
            return "Stopped"
        return self.state

    def wait(self, seconds: float = 120) -> None:
        until = time.time() + seconds
        while self.query.isActive and time.time() < until:
            self.query.awaitTermination(1)


def deploy(spark: SparkSession, options: dict[str, str], checkpoints: str) -> Deployment:
    """A function from the options of CREATE FUNCTION: a Python module whose one
    processor class runs, and the YAML file with the task's configuration."""
    path = options["function_path"]
    if not path.endswith(".py"):
        raise PlanError("function_path names a Python module")
    spec = importlib.util.spec_from_file_location(re.sub(r"\W", "_", path), path)
    module = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(module)
    except FileNotFoundError:
        raise NotFound(f"{path} not found") from None
    kinds = [c for _, c in inspect.getmembers(module, inspect.isclass) if issubclass(c, Processor) and c is not Processor]
    if len(kinds) != 1:
        raise PlanError(f"{path} has {len(kinds)} processor classes, not one")
    kinds[0].__module__ = "__main__"  # so that it travels with the query
    with open(options["config_path"]) as f:
        return Deployment(spark, kinds[0], read_config(f.read()), checkpoints)
