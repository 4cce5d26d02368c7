"""The catalog: definitions of tables and jobs, kept as the text that made them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

from rivulet.errors import AlreadyExists, NotFound, PlanError
from rivulet.plans.ddl import Column, CreateTable, parse_one
from rivulet.plans.options import Options
from rivulet.plans.types import spark_type

#: Adapters a table may name, and formats of its records.
ADAPTERS = ("kafka", "filesystem", "rate", "memory", "blackhole")
FORMATS = ("json", "raw_string", "raw_bytes", "debezium_json", "parquet", "csv", "avro", "protobuf")


@dataclass
class TableDef:
    """A registered source or sink."""

    name: str
    columns: list[Column]
    options: dict[str, str]
    primary_key: list[str] = field(default_factory=list)
    watermark: tuple[str, str | None] | None = None
    text: str = ""

    @property
    def adapter(self) -> str:
        return self.options["connector"].lower()

    @property
    def format(self) -> str:
        return self.options.get("format", "json").lower()

    @property
    def role(self) -> str:
        kind = self.options.get("type", "source").lower()
        return {"source": "ingestion", "sink": "egress", "lookup": "reference"}.get(kind, kind)

    @property
    def updating(self) -> bool:
        return self.format == "debezium_json" or Options(self.options).boolean("json.debezium", False) or Options(self.options).boolean("format.debezium", False)

    def schema(self) -> T.StructType:
        """The physical columns."""
        return T.StructType([T.StructField(c.name, spark_type(c.type), True) for c in self.columns if c.expr is None])

    def check(self) -> None:
        """The rules of a definition, in order: adapter, format, framing, columns,
        role, watermark, idle time, lookup cache, change data."""
        options = Options(self.options)
        if self.adapter not in ADAPTERS:
            raise PlanError(f"Unknown adapter '{self.adapter}'")
        if self.format not in FORMATS:
            raise PlanError(f"unknown format '{self.format}'")
        if self.format in ("avro", "protobuf") or self.format == "parquet" and self.adapter == "kafka":
            raise PlanError(f"format '{self.format}' is not supported yet by the {self.adapter} connector")
        if options.get("json.compression") and self.adapter != "filesystem":
            raise PlanError("json.compression is only for the filesystem connector")
        if (framing := options.get("framing.method")) and framing != "newline":
            raise PlanError(f"unknown framing '{framing}'")
        if options.get("bad_data", "fail") not in ("fail", "drop"):
            raise PlanError("bad_data is 'fail' or 'drop'")
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise PlanError("two columns have one name")
        types = {c.name: spark_type(c.type) for c in self.columns}
        if self.format.startswith("raw_") and names != ["value"]:
            raise PlanError(f"{self.format} needs a single column named value")
        if self.role not in ("ingestion", "egress", "reference"):
            raise PlanError(f"unknown table type '{self.role}'")
        if self.watermark:
            name = self.watermark[0]
            if name not in types:
                raise PlanError(f"the watermark's column {name} is not in the table")
            if not isinstance(types[name], T.TimestampType):
                raise PlanError(f"the watermark's column {name} must be a TIMESTAMP")
        options.duration("idle_time", None)
        options.duration("lookup.cache.ttl", None)
        options.integer("lookup.cache.max_bytes", None)
        for key in self.primary_key:
            if key not in types:
                raise PlanError(f"the primary key's column {key} is not in the table")
        if self.updating:
            if not self.primary_key:
                raise PlanError("a debezium source needs at least one PRIMARY KEY")
            if any(c.expr for c in self.columns):
                raise PlanError("computed columns are not allowed in change streams")
            if options.get("event_time_field"):
                raise PlanError("event_time_field is not allowed in update mode")
        if self.adapter == "kafka":
            for key in ("topic", "bootstrap.servers"):
                if not options.get(key, options.get(key.replace(".", "_"))):
                    raise PlanError(f"missing option '{key}'")
            if options.get("scan.startup.mode", "latest").split("-")[0] not in ("latest", "earliest", "group"):
                raise PlanError("scan.startup.mode is latest, earliest or group-offsets")


def table_of(s: CreateTable) -> TableDef:
    if "connector" not in s.options:
        raise PlanError("only tables with a connector can be created")
    out = TableDef(s.name, s.columns, s.options, s.primary_key, s.watermark, s.text)
    out.check()
    return out


class Catalog:
    """Tables by lower-case name; with a path, kept there as JSON."""

    def __init__(self, path: str | None = None) -> None:
        self.path = Path(path) if path else None
        self.tables: dict[str, TableDef] = {}
        self.jobs: dict[str, str] = {}
        self.functions: dict[str, str] = {}
        if self.path and self.path.exists():
            kept = json.loads(self.path.read_text())
            self.tables = {k: table_of(parse_one(text)) for k, text in kept["tables"].items()}  # type: ignore[arg-type]
            self.jobs, self.functions = kept["jobs"], kept.get("functions", {})

    def _keep(self) -> None:
        if self.path:
            self.path.write_text(json.dumps({"tables": {k: t.text for k, t in self.tables.items()}, "jobs": self.jobs, "functions": self.functions}))

    def add(self, table: TableDef, if_not_exists: bool = False) -> bool:
        if table.name in self.tables or table.name in self.jobs:
            if if_not_exists:
                return False
            raise AlreadyExists(f"table {table.name} already exists")
        self.tables[table.name] = table
        self._keep()
        return True

    def get(self, name: str) -> TableDef:
        if name.lower() not in self.tables:
            raise NotFound(f"table {name} not found")
        return self.tables[name.lower()]

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if name.lower() not in self.tables:
            if if_exists:
                return False
            raise NotFound(f"table {name} not found")
        del self.tables[name.lower()]
        self._keep()
        return True

    def add_job(self, name: str, text: str) -> None:
        self.jobs[name] = text
        self._keep()

    def drop_job(self, name: str) -> None:
        self.jobs.pop(name, None)
        self._keep()

    def add_function(self, name: str, text: str) -> None:
        self.functions[name] = text
        self._keep()

    def drop_function(self, name: str) -> None:
        self.functions.pop(name, None)
        self._keep()
