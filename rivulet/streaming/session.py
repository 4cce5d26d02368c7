"""The entry point: statements in, results out, jobs over Spark's streams."""

from __future__ import annotations

import json
import shutil
import tempfile
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from rivulet.errors import AlreadyExists, NotFound, PlanError, RivuletError
from rivulet.functions import dialect, scalar
from rivulet.plans import ddl
from rivulet.plans.catalog import Catalog, table_of
from rivulet.plans.options import Options
from rivulet.plans.query import Compiled, Compiler
from rivulet.sources.tables import TIME, load
from rivulet.streaming import sinks
from rivulet.streaming.processor import Deployment, deploy
from rivulet.streaming.updating import DAY_MS, updating_aggregate


@dataclass
class Result:
    """What a statement gives back; ``df`` holds rows where it has any."""

    ok: bool
    code: int
    message: str
    df: DataFrame | None = None


@dataclass
class Job:
    name: str
    text: str
    query: object = None
    started: float = field(default_factory=time.time)
    failed: str | None = None

    def status(self) -> str:
        """Degraded after a failure, running, or finished."""
        if self.failed or self.query is not None and self.query.exception() is not None:
            return "Degraded"
        if self.query is None:
            return "Initializing"
        return "Running" if self.query.isActive else "Finished"

    def uptime(self) -> str:
        s = int(time.time() - self.started)
        parts = [(s // 3600, "h"), (s % 3600 // 60, "m"), (s % 60, "s")]
        while len(parts) > 1 and parts[0][0] == 0:
            parts = parts[1:]
        return " ".join(f"{n}{u}" for n, u in parts)


class Session:
    """Tables, continuous queries and functions over one Spark session.

    ``catalog_path`` keeps the definitions; ``checkpoints`` is where queries
    keep their progress (a folder that driver and executors share). With
    ``available_now`` queries end when their input does.
    """

    def __init__(self, spark: SparkSession, catalog_path: str | None = None, checkpoints: str | None = None, available_now: bool = False) -> None:
        self.spark, self.catalog, self.available_now = spark, Catalog(catalog_path), available_now
        self._checkpoints = checkpoints
        self.jobs: dict[str, Job] = {}
        self.functions: dict[str, Deployment] = {}
        self.bound: dict[str, DataFrame] = {}
        self.collected: dict[str, list[DataFrame]] = {}
        scalar.register(spark)
        dialect.register(spark)

    @property
    def checkpoints(self) -> str:
        """Where queries keep their progress. Unless it is given, a folder in
        ``spark.checkpoint.dir``; without that a temporary one, on one machine only."""
        if self._checkpoints is None:
            shared = self.spark.conf.get("spark.checkpoint.dir", None)
            if shared:
                self._checkpoints = f"{shared.rstrip('/')}/streams-{int(time.time() * 1e6)}"
            elif self.spark.sparkContext.master.split("[")[0] == "local":
                self._checkpoints = tempfile.mkdtemp(prefix="rivulet-")
            else:
                raise PlanError("name a shared folder for checkpoints, or set spark.checkpoint.dir")
        return self._checkpoints

    # --- statements

    def sql(self, text: str) -> Result:
        """Run a script; stop at the first failure, return the last result."""
        try:
            result = Result(True, 200, "")
            for statement in ddl.parse(text):
                result = self._run(statement)
            return result
        except RivuletError as e:
            return Result(False, e.code, str(e))
        except PySparkException as e:  # what Spark finds wrong with a query
            missing = "NOT_FOUND" in (e.getCondition() or "")
            return Result(False, 404 if missing else 400 if isinstance(e, AnalysisException) else 500, str(e).split("\n")[0])

    def query(self, text: str) -> DataFrame:
        """A bounded query over the registered tables, with all that batch mode allows."""
        compiled = self._compile(text, streaming=False)
        return self._select(compiled, streaming=False)

    def bind(self, name: str, rows: DataFrame) -> None:
        """What a memory table reads: bounded rows or a stream."""
        self.bound[name.lower()] = rows

    def rows(self, name: str) -> DataFrame:
        """What a memory sink has received."""
        name = name.lower()
        if name in self.collected:
            return reduce(DataFrame.unionByName, self.collected[name])
        return self.spark.table(name)

    def _run(self, s: ddl.Statement) -> Result:
        if isinstance(s, ddl.CreateTable):
            made = self.catalog.add(table_of(s), s.if_not_exists)
            return Result(True, 200, f"table {s.name} " + ("created" if made else "exists already"))
        if isinstance(s, ddl.CreateStreamingTable):
            return self._create_job(s)
        if isinstance(s, ddl.Drop):
            return {"table": self._drop_table, "streaming table": self._drop_job, "function": self._drop_function}[s.what](s)
        if isinstance(s, ddl.Show):
            return self._show(s)
        if isinstance(s, ddl.CreateFunction):
            d = deploy(self.spark, s.options, self.checkpoints)
            if d.name in self.functions:
                raise AlreadyExists(f"function {d.name} already exists")
            self.functions[d.name] = d
            self.catalog.add_function(d.name, json.dumps(s.options))
            return Result(True, 200, f"function {d.name} created")
        d = self._function(s.name)
        d.start(self.available_now) if s.action == "start" else d.stop()
        return Result(True, 200, f"function {s.name} {d.status()}")

    # --- tables

    def _drop_table(self, s: ddl.Drop) -> Result:
        dropped = self.catalog.drop(s.name, s.if_exists)
        return Result(True, 200, f"table {s.name} " + ("dropped" if dropped else "not found, skipped"))

    def _frame(self, rows: list[tuple], columns: str) -> DataFrame:
        return self.spark.createDataFrame(rows, columns)

    def _show(self, s: ddl.Show) -> Result:
        if s.what == "functions":
            df = self._frame([(d.name, d.kind, d.status()) for d in sorted(self.functions.values(), key=lambda d: d.name)], "name string, task_type string, status string")
        elif s.what == "tables" and s.name:
            df = self._frame([(s.name, self.catalog.get(s.name).text)], "table_name string, ddl string")
        elif s.what == "tables":
            rows = [(t.name, "source" if t.role == "ingestion" else t.role, len(t.columns), ", ".join(f"{c.name} {c.type}" for c in t.columns), f"connector={t.adapter}, format={t.format}") for t in sorted(self.catalog.tables.values(), key=lambda t: t.name)]
            df = self._frame(rows, "table_name string, kind string, column_count int, schema_columns string, details string")
        elif s.name:
            job = self._job(s.name)
            plan = job.query._jsq.explainInternal(False) if job.query is not None and hasattr(job.query, "_jsq") else ""
            df = self._frame([(s.name, job.status(), 1, job.text, plan)], "job_id string, status string, pipeline_count int, ddl string, topology string")
        else:
            df = self._frame([(j.name, j.status(), 1, j.uptime()) for j in sorted(self.jobs.values(), key=lambda j: j.name)], "job_id string, status string, pipeline_count int, uptime string")
        return Result(True, 200, "", df)

    # --- continuous queries

    def _compile(self, text: str, streaming: bool) -> Compiled:
        known = lambda n: n in self.catalog.tables
        timed = lambda n: self.catalog.tables[n].watermark is not None
        reference = lambda n: n in self.catalog.tables and self.catalog.tables[n].role == "reference"
        return Compiler(self.spark, text, known, lambda n: self.catalog.tables[n].updating, streaming, timed, reference).compile()

    def _register(self, names: set[str], streaming: bool) -> None:
        for name in names:
            table = self.catalog.get(name)
            rows = load(self.spark, table, streaming and table.role != "reference", self.bound)
            (rows.drop(TIME) if table.role == "reference" else rows).createOrReplaceTempView(name)

    def _select(self, compiled: Compiled, streaming: bool) -> DataFrame:
        self._register(compiled.sources, streaming)
        df = self.spark.sql(compiled.sql)
        return df.drop(TIME) if TIME in df.columns else df

    def _create_job(self, s: ddl.CreateStreamingTable) -> Result:
        if s.name in self.jobs or s.name in self.catalog.tables:
            if s.if_not_exists:
                return Result(True, 200, f"streaming table {s.name} exists already")
            raise AlreadyExists(f"streaming table {s.name} already exists")
        compiled = self._compile(s.select, streaming=True)
        sinks.check(s.options, compiled.relation.updating)
        job = Job(s.name, s.text)
        write = sinks.batch_writer(s.options, s.name, self.collected)
        if compiled.over:
            stream, apply = self._over(s.select, compiled)
            writer = stream.writeStream.outputMode("append").foreachBatch(lambda rows, n: write(apply(rows), n))
        elif compiled.changes:
            stream, apply = self._updating(compiled, s.name)
            writer = stream.writeStream.outputMode("append").foreachBatch(lambda rows, n: write(apply(rows), n))
        elif compiled.relation.updating:
            writer = self._select(compiled, True).writeStream.outputMode("append").foreachBatch(write)
        else:
            writer = sinks.writer(self._select(compiled, True), s.options, s.name)
        writer = writer.queryName(s.name).option("checkpointLocation", f"{self.checkpoints}/{s.name}")
        if self.available_now:
            writer = writer.trigger(availableNow=True)
        elif any(self.catalog.get(n).options.get("rate_limit.messages_per_second") for n in compiled.sources):
            writer = writer.trigger(processingTime="1 second")  # each batch holds a second's records at most
        elif interval := Options(s.options).duration("flush.interval", None):
            writer = writer.trigger(processingTime=f"{int(interval * 1000)} milliseconds")
        job.query = writer.start()
        self.jobs[s.name] = job
        self.catalog.add_job(s.name, s.text)
        return Result(True, 200, f"streaming table {s.name} started")

    def _over(self, text: str, compiled: Compiled):
        """The stream below an OVER, and what to do with each finished batch of it.

        The query's FROM is a sub-query in brackets, as the rule that the input
        is windowed implies; it runs as the stream."""
        found, depth, begin = ddl.tokens(text), 0, None
        for k, t in enumerate(found):
            if depth == 0 and t.word == "from" and found[k + 1].text == "(":
                begin = k + 1
            depth += (t.text == "(") - (t.text == ")")
            if begin is not None and depth == 0 and t.text == ")":
                inner, view = text[found[begin].end : t.start], f"rv_{abs(hash(text))}"
                outer = text[: found[begin].start] + view + text[t.end :]
                stream = self._select(self._compile(inner, True), True)

                def apply(rows: DataFrame, view=view, outer=outer) -> DataFrame:
                    rows.createOrReplaceTempView(view)
                    return rows.sparkSession.sql(outer)

                return stream, apply
        raise PlanError("window functions need a sub-query in FROM")

    def _updating(self, compiled: Compiled, name: str):
        """The aggregate's changelog as a stream, and what is made of each batch of it."""
        changes, view = compiled.changes, f"rv_changes_{name}"
        self._register(compiled.sources, True)
        rows = self.spark.sql(changes.input)
        log = updating_aggregate(rows, changes.keys, changes.aggs, None if self.available_now else DAY_MS)

        def apply(rows: DataFrame) -> DataFrame:
            rows.createOrReplaceTempView(view)
            return rows.sparkSession.sql(changes.outer.replace("{changelog}", view))

        # found out now what the query made of the results has wrong
        empty = self.spark.createDataFrame([], log.schema)
        empty.createOrReplaceTempView(view)
        self.spark.sql(changes.outer.replace("{changelog}", view))
        return log, apply

    def _job(self, name: str) -> Job:
        if name not in self.jobs:
            raise NotFound(f"streaming table {name} not found")
        return self.jobs[name]

    def _drop_job(self, s: ddl.Drop) -> Result:
        if s.name not in self.jobs:
            if s.if_exists:
                return Result(True, 200, f"streaming table {s.name} not found, skipped")
            raise NotFound(f"streaming table {s.name} not found")
        job = self.jobs.pop(s.name)
        job.query.stop()
        self.catalog.drop_job(s.name)
        if not self.checkpoints.startswith(("hdfs", "s3")):
            shutil.rmtree(f"{self.checkpoints.removeprefix('file://')}/{s.name}", ignore_errors=True)
        return Result(True, 200, f"streaming table {s.name} dropped")

    def wait(self, name: str, seconds: float = 120) -> bool:
        """Wait for a query that ends (``available_now``), or for what has arrived."""
        query = self._job(name.lower()).query
        if self.available_now:
            return bool(query.awaitTermination(seconds))
        query.processAllAvailable()
        return True

    def restore(self) -> None:
        """Start the jobs that the catalog remembers, and register its functions
        again (stopped; their state is in their checkpoints)."""
        for name, text in list(self.catalog.functions.items()):
            if name not in self.functions:
                self.functions[name] = deploy(self.spark, json.loads(text), self.checkpoints)
        for name, text in list(self.catalog.jobs.items()):
            if name not in self.jobs:
                self._create_job(ddl.parse_one(text))  # type: ignore[arg-type]

    # --- functions

    def create_function(self, processor: type, config: dict, inputs: list[DataFrame] | None = None) -> Deployment:
        """Register a processor class with its configuration (no SQL needed)."""
        d = Deployment(self.spark, processor, config, self.checkpoints, inputs)
        if d.name in self.functions:
            raise AlreadyExists(f"function {d.name} already exists")
        self.functions[d.name] = d
        return d

    def _function(self, name: str) -> Deployment:
        if name not in self.functions:
            raise NotFound(f"function {name} not found")
        return self.functions[name]

    def _drop_function(self, s: ddl.Drop) -> Result:
        if s.name not in self.functions:
            if s.if_exists:
                return Result(True, 200, f"function {s.name} not found, skipped")
            raise NotFound(f"function {s.name} not found")
        self.functions.pop(s.name).close()
        self.catalog.drop_function(s.name)
        return Result(True, 200, f"function {s.name} dropped")
