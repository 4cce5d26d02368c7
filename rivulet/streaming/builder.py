"""Tasks of functions, put together in Python instead of YAML, and engines from
a configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from rivulet.errors import PlanError
from rivulet.streaming.session import Session


@dataclass
class KafkaInput:
    bootstrap_servers: str
    topic: str
    group_id: str | None = None
    partition: int | None = None

    def config(self) -> dict[str, Any]:
        stated = {"group_id": self.group_id, "partition": self.partition}
        return {"input-type": "kafka", "bootstrap_servers": self.bootstrap_servers, "topic": self.topic, **{k: v for k, v in stated.items() if v is not None}}


@dataclass
class FileInput:
    path: str

    def config(self) -> dict[str, Any]:
        return {"input-type": "file", "path": self.path}


@dataclass
class KafkaOutput:
    bootstrap_servers: str
    topic: str
    partition: int | None = None

    def config(self) -> dict[str, Any]:
        return {"output-type": "kafka", "bootstrap_servers": self.bootstrap_servers, "topic": self.topic, **({} if self.partition is None else {"partition": self.partition})}


@dataclass
class FileOutput:
    path: str

    def config(self) -> dict[str, Any]:
        return {"output-type": "file", "path": self.path}


@dataclass
class TaskBuilder:
    """A task's configuration, piece by piece; ``build`` checks it."""

    name: str
    groups: list[list] = field(default_factory=list)
    outputs: list = field(default_factory=list)
    settings: dict[str, Any] = field(default_factory=dict)
    key: str | None = None

    def reads(self, *inputs: KafkaInput | FileInput) -> TaskBuilder:
        """One group of inputs."""
        self.groups.append(list(inputs))
        return self

    def writes(self, *outputs: KafkaOutput | FileOutput) -> TaskBuilder:
        """Outputs in the order of their targets."""
        self.outputs += outputs
        return self

    def configured(self, **settings: Any) -> TaskBuilder:
        """What the processor's init gets."""
        self.settings |= settings
        return self

    def keyed_by(self, name: str) -> TaskBuilder:
        """The field of JSON records by which work and state are spread."""
        self.key = name
        return self

    def build(self) -> dict[str, Any]:
        if not re.fullmatch(r"[A-Za-z_][\w-]*", self.name or ""):
            raise PlanError(f"{self.name!r} is no name of a task")
        if any(not g for g in self.groups):
            raise PlanError("a group needs an input")
        made = {"name": self.name, "type": "python", "input-groups": [{"inputs": [i.config() for i in g]} for g in self.groups], "outputs": [o.config() for o in self.outputs], "init-config": dict(self.settings)}
        return made | ({"key-by": self.key} if self.key else {})


#: Spark's state stores by the names that a configuration uses.
STATE_STORES = {
    "memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session_from(spark: SparkSession, config: dict[str, Any]) -> Session:
    """A session set up by a configuration: ``state_storage`` (storage_type memory
    or rocksdb), ``stream_catalog`` (path), ``task_storage`` (path of checkpoints)
    and ``logging`` (level). What is left out keeps its default."""
    kind = (config.get("state_storage") or {}).get("storage_type")
    if kind is not None:
        if kind not in STATE_STORES:
            raise PlanError(f"state_storage is memory or rocksdb, not {kind}")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORES[kind])
    if level := (config.get("logging") or {}).get("level"):
        spark.sparkContext.setLogLevel(str(level).upper())
    return Session(spark, (config.get("stream_catalog") or {}).get("path"), (config.get("task_storage") or {}).get("path"))
