"""The line reader, builders and configurations, reference tables and metadata columns."""

import json
from datetime import datetime, timedelta

import pytest

from rivulet.errors import PlanError
from rivulet.plans.query import Compiler
from rivulet.repl import Repl, table
from rivulet.streaming.builder import FileInput, FileOutput, KafkaInput, KafkaOutput, TaskBuilder, session_from
from rivulet.streaming.session import Session

T0 = datetime(2024, 1, 1)


def test_repl(spark):
    repl = Repl(Session(spark))
    assert repl.feed("") is None and "semicolon" in repl.feed("help") and repl.prompt == "rivulet> "
    assert repl.feed("CREATE TABLE rides (") is None and repl.prompt == "... "
    assert repl.feed("  id BIGINT -- a comment; no end") is None
    assert "created" in repl.feed(") WITH ('connector' = 'memory');")
    out = repl.feed("SHOW TABLES;")
    assert "| rides" in out and out.endswith("1 row(s)")
    assert repl.feed("SHOW CREATE TABLE") is None and repl.feed("clear") == "" and repl.prompt == "rivulet> "
    assert repl.feed("DROP TABLE nosuch;").startswith("error 404")
    assert repl.feed("SELECT 1;").startswith("error 400")
    assert repl.open and repl.feed("exit;") == "bye" and not repl.open
    assert table([(1, None), (22, "a\nb")], ["n", "text"]).split("\n")[1:] == ["| n  | text |", "+----+------+", "| 1  |      |", "| 22 | a b  |", "+----+------+"]


def test_builder():
    made = TaskBuilder("smoother").reads(KafkaInput("broker:1", "in", "readers"), FileInput("/more")).writes(KafkaOutput("broker:1", "out"), FileOutput("/side")).configured(width=3).keyed_by("id").build()
    assert made["input-groups"] == [{"inputs": [{"input-type": "kafka", "bootstrap_servers": "broker:1", "topic": "in", "group_id": "readers"}, {"input-type": "file", "path": "/more"}]}]
    assert [o["output-type"] for o in made["outputs"]] == ["kafka", "file"] and made["init-config"] == {"width": 3} and made["key-by"] == "id"
    for broken in (TaskBuilder("9x"), TaskBuilder(""), TaskBuilder("x").reads()):
        with pytest.raises(PlanError):
            broken.build()


def test_session_from_a_configuration(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    s = session_from(spark, {"state_storage": {"storage_type": "rocksdb"}, "stream_catalog": {"path": str(tmp_path / "c.json")}, "task_storage": {"path": str(tmp_path / "cp")}})
    assert s.checkpoints == str(tmp_path / "cp") and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert s.sql("CREATE TABLE kept (id INT) WITH ('connector' = 'memory')").ok and (tmp_path / "c.json").exists()
    with pytest.raises(PlanError):
        session_from(spark, {"state_storage": {"storage_type": "tape"}})


def test_metadata_columns(spark):
    rows = [(json.dumps({"id": k, "note": "x"}).encode(), k * 10, 0, "rides", T0 + timedelta(seconds=k)) for k in range(3)]
    s = Session(spark)
    s.bind("rides", spark.createDataFrame(rows, "value binary, offset long, partition int, topic string, timestamp timestamp"))
    made = s.sql("CREATE TABLE rides (id BIGINT, place BIGINT METADATA FROM 'offset_id', topic STRING METADATA FROM 'topic', at TIMESTAMP METADATA FROM 'timestamp', later BIGINT GENERATED ALWAYS AS (place + 1)) WITH ('connector' = 'memory', 'format' = 'json')")
    assert made.ok, made.message
    got = sorted(tuple(r) for r in s.query("SELECT id, place, topic, at, later FROM rides").collect())
    assert got == [(k, k * 10, "rides", T0 + timedelta(seconds=k), k * 10 + 1) for k in range(3)]
    s.bind("bare", spark.createDataFrame([(b"{}",)], "value binary"))
    assert s.sql("CREATE TABLE bare (id BIGINT, place BIGINT METADATA FROM 'offset') WITH ('connector' = 'memory', 'format' = 'json')").ok
    with pytest.raises(PlanError, match="no metadata"):
        s.query("SELECT id FROM bare")


def test_reference_table_in_a_stream(spark, tmp_path):
    """Each row finds its reference row, or none; windows above see their event times."""
    spark.createDataFrame([(k, T0 + timedelta(seconds=30 * k)) for k in range(20)] + [(1, T0 + timedelta(days=1))], "k long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/facts")
    spark.createDataFrame([(k, f"name{k % 3}") for k in range(0, 20, 2)], "id long, name string").write.parquet(f"{tmp_path}/names")
    s = Session(spark, None, str(tmp_path / "cp"), available_now=True)
    files = lambda p, more="": f"WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{tmp_path}/{p}'{more})"
    assert s.sql(f"CREATE TABLE facts (k BIGINT, ts TIMESTAMP, WATERMARK FOR ts) {files('facts')}; CREATE TABLE names (id BIGINT, name STRING) {files('names', ', ' + repr('type') + ' = ' + repr('lookup'))}").ok
    for name, select in (("j1", "SELECT f.k, n.name FROM facts f LEFT JOIN names n ON f.k = n.id"), ("j2", "SELECT f.k, n.name FROM facts f JOIN names n ON f.k = n.id WHERE n.name <> 'name0'")):
        made = s.sql(f"CREATE STREAMING TABLE {name} WITH ('connector' = 'memory') AS {select}")
        assert made.ok, made.message
        assert s.wait(name)
        assert sorted(map(str, s.rows(name).collect())) == sorted(map(str, s.query(select).collect()))
    windowed = "SELECT TUMBLE(INTERVAL '5' MINUTE) AS w, n.name AS name, COUNT(*) AS c FROM facts f JOIN names n ON f.k = n.id GROUP BY 1, n.name"
    assert s.sql(f"CREATE STREAMING TABLE j3 WITH ('connector' = 'memory') AS {windowed}").ok and s.wait("j3")
    assert {(r.name, r.c) for r in s.rows("j3").collect()} == {(r.name, r.c) for r in s.query(windowed).collect() if r.w.start < T0 + timedelta(hours=1)}
    for select in ("SELECT n.name FROM names n JOIN facts f ON f.k = n.id", "SELECT f.k FROM facts f RIGHT JOIN names n ON f.k = n.id", "SELECT f.k FROM facts f JOIN names n ON f.k > n.id"):
        assert s.sql(f"CREATE STREAMING TABLE no WITH ('connector' = 'memory') AS {select}").code == 400


def test_rules_of_reference_tables(spark):
    of = lambda sql: Compiler(spark, sql, lambda n: n in ("a", "dim"), updating=lambda n: n == "a", reference=lambda n: n == "dim").compile()
    with pytest.raises(PlanError, match="updating rows"):
        of("SELECT a.k FROM a JOIN dim ON a.k = dim.k")
