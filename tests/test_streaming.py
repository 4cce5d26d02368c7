"""Continuous queries: the stream's result is the batch result, less what is still open."""

import json
from datetime import datetime, timedelta

import pytest

from rivulet.streaming.processor import Processor, read_config, run_bounded
from rivulet.streaming.session import Session
from rivulet.streaming.state import AggregatingState, ComplexKey, DictBackend, Keyed, KvStore, ListState, MapState, PriorityQueueState, ReducingState, ValueState

T0 = datetime(2024, 1, 1)


@pytest.fixture
def clicks(spark, tmp_path):
    """Ten minutes of clicks in three files, and one far later to close the windows."""
    rows = [(T0 + timedelta(seconds=20 * k), k % 3, float(k)) for k in range(30)] + [(T0 + timedelta(days=1), 9, 0.0)]
    path = str(tmp_path / "clicks")
    for part in (rows[:10], rows[10:20], rows[20:]):
        lines = [(json.dumps({"ts": t.isoformat() + "Z", "user": u, "v": v, "more": 1}),) for t, u, v in part]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)
    return path


@pytest.fixture
def session(spark, tmp_path, clicks):
    s = Session(spark, str(tmp_path / "catalog.json"), str(tmp_path / "checkpoints"), available_now=True)
    made = s.sql(f"""CREATE TABLE clicks (ts TIMESTAMP NOT NULL, user BIGINT, v DOUBLE, WATERMARK FOR ts AS ts - INTERVAL '5' SECOND)
        WITH ('connector' = 'filesystem', 'path' = '{clicks}', 'format' = 'json')""")
    assert made.ok, made.message
    yield s
    for q in spark.streams.active:
        q.stop()


def run(session, name, select, options="'connector' = 'memory'"):
    made = session.sql(f"CREATE STREAMING TABLE {name} WITH ({options}) AS {select}")
    assert made.ok, made.message
    assert session.wait(name), session.jobs[name].query.exception()
    return session


def test_tumble_equals_batch(session):
    select = "SELECT TUMBLE(INTERVAL '1' MINUTE) AS w, user, COUNT(*) AS n FROM clicks GROUP BY 1, user"
    got = {(r.w.start, r.user, r.n) for r in run(session, "t1", select).rows("t1").collect()}
    batch = {(r.w.start, r.user, r.n) for r in session.query(select).collect()}
    assert got == {x for x in batch if x[0] < T0 + timedelta(hours=1)} and len(got) == 30


def test_hop_distinct_and_session(session):
    run(session, "h1", "SELECT HOP(INTERVAL '1' MINUTE, INTERVAL '2' MINUTE) AS w, COUNT(DISTINCT user) AS u FROM clicks GROUP BY 1")
    assert {r.u for r in session.rows("h1").collect()} == {3}
    run(session, "s1", "SELECT SESSION(INTERVAL '90' SECOND) AS w, user, COUNT(*) AS n FROM clicks GROUP BY 1, user")
    assert sorted((r.user, r.n) for r in session.rows("s1").collect()) == [(0, 10), (1, 10), (2, 10)]


def test_over_on_a_stream(session):
    select = "SELECT w, user, n, ROW_NUMBER() OVER (PARTITION BY w ORDER BY user DESC) AS r FROM (SELECT TUMBLE(INTERVAL '5' MINUTE) AS w, user, COUNT(*) AS n FROM clicks GROUP BY 1, user) t"
    got = [(r.user, r.r) for r in run(session, "o1", select).rows("o1").collect()]
    assert sorted(got) == sorted([(0, 3), (1, 2), (2, 1)] * 2)


def test_updating_aggregate(session, tmp_path):
    run(session, "u1", "SELECT user, COUNT(*) AS n, MAX(v) AS top FROM clicks GROUP BY user", f"'connector'='filesystem', 'format'='debezium_json', 'path'='{tmp_path}/u1'")
    rows = [json.loads(r.value) for r in session.spark.read.text(f"{tmp_path}/u1/batch=*").collect()]
    final = {r["after"]["user"]: (r["after"]["n"], r["after"]["top"]) for r in rows if r["after"]}
    assert final[0] == (10, 27.0) and final[9] == (1, 0.0)
    refused = session.sql("CREATE STREAMING TABLE u2 WITH ('connector'='filesystem','path'='/x') AS SELECT user, COUNT(*) AS n FROM clicks GROUP BY user")
    assert (refused.ok, refused.code) == (False, 400) and "debezium_json" in refused.message


def final(session, name, columns):
    """What is left of a changelog once all its retractions are taken back."""
    left = {}
    for r in session.rows(name).collect():
        key = tuple(r[c] for c in columns)
        left[key] = left.get(key, 0) + (-1 if r._updating_meta.is_retract else 1)
    assert set(left.values()) <= {0, 1}
    return sorted(k for k, n in left.items() if n)


def test_updating_queries_of_all_shapes(session, spark):
    """A projection above, a CTE, computed keys, HAVING, FILTER, and all rows."""
    shapes = {
        "a1": ("SELECT user, n * 2 AS m FROM (SELECT user, COUNT(*) AS n FROM clicks GROUP BY user) x WHERE n > 1", ["user", "m"]),
        "a2": ("WITH e AS (SELECT user AS u, v FROM clicks WHERE v >= 10) SELECT u, COUNT(*) AS n FROM e GROUP BY u", ["u", "n"]),
        "a3": ("SELECT user + 1 AS k, SUM(v) / COUNT(*) AS mean FROM clicks GROUP BY user + 1", ["k", "mean"]),
        "a4": ("SELECT user, MAX(v) AS top FROM clicks GROUP BY user HAVING COUNT(*) > 5", ["user", "top"]),
        "a5": ("SELECT COUNT(*) AS n, COUNT(DISTINCT user) AS users, MIN(v) FILTER (WHERE user = 1) AS low FROM clicks", ["n", "users", "low"]),
        "a6": ("SELECT concat('u', user, NULL) AS name, AVG(v) AS mean FROM clicks GROUP BY name", ["name", "mean"]),
    }
    for name, (select, columns) in shapes.items():
        run(session, name, select)
        want = sorted(tuple(r) for r in session.query(select).select(*columns).collect())
        assert final(session, name, columns) == want, name
    for select in ("SELECT nosuch, COUNT(*) AS n FROM clicks GROUP BY nosuch", "SELECT user, n + 'x' + z AS m FROM (SELECT user, COUNT(*) AS n FROM clicks GROUP BY user) x", "SELECT user, stddev(v) AS s FROM clicks GROUP BY user"):
        refused = session.sql(f"CREATE STREAMING TABLE bad WITH ('connector' = 'memory') AS {select}")
        assert (refused.ok, refused.code) == (False, 400), refused


def test_updating_whole_numbers_are_exact(session, spark, tmp_path):
    """Beside nulls, beyond what a double holds; distinct lists and times too."""
    big = 2**60 + 1
    rows = [(1, big, [1, 2], T0), (1, None, [1, 2], T0), (1, 2, [3], None), (2, None, None, None), (3, big, [1], T0), (3, big, [1], T0)]
    path = str(tmp_path / "whole")
    spark.createDataFrame(rows, "k long, v long, xs array<int>, t timestamp").repartition(3).write.parquet(path)
    assert session.sql(f"CREATE TABLE whole (k BIGINT, v BIGINT, xs ARRAY<INT>, t TIMESTAMP) WITH ('connector' = 'filesystem', 'path' = '{path}', 'format' = 'parquet')").ok
    select = "SELECT k, SUM(v) AS s, MAX(v) AS top, COUNT(v) AS n, COUNT(DISTINCT xs) AS lists, COUNT(DISTINCT t) AS times FROM whole GROUP BY k"
    run(session, "w1", select)
    columns = ["k", "s", "top", "n", "lists", "times"]
    assert final(session, "w1", columns) == sorted(tuple(r) for r in session.query(select).collect())


def test_updating_decimals_are_exact(session, spark, tmp_path):
    from decimal import Decimal

    rows = [(1, Decimal("0.10")), (1, Decimal("0.20")), (2, Decimal("12345678901234.56")), (2, Decimal("0.01")), (2, Decimal("-3.00")), (3, None)]
    path = str(tmp_path / "amounts")
    spark.createDataFrame(rows, "k long, v decimal(18,2)").repartition(3).write.parquet(path)
    assert session.sql(f"CREATE TABLE amounts (k BIGINT, v DECIMAL(18,2)) WITH ('connector' = 'filesystem', 'path' = '{path}', 'format' = 'parquet')").ok
    select = "SELECT k, SUM(v) AS s, AVG(v) AS mean, MIN(v) AS low, COUNT(DISTINCT v) AS n FROM amounts GROUP BY k"
    run(session, "m1", select)
    want = session.query(select)
    got = spark.createDataFrame([r for r in session.rows("m1").drop("_updating_meta", "_rv_seq").collect() if r.n or r.k == 3], session.rows("m1").drop("_updating_meta", "_rv_seq").schema)
    assert {c: t for c, t in got.dtypes if c != "n"} == {c: t for c, t in want.dtypes if c != "n"}
    key = lambda r: (r[0], *map(str, r[1:]))
    assert final(session, "m1", ["k", "s", "mean", "low", "n"]) == sorted((tuple(r) for r in want.collect()), key=key)


def test_stateless_file_sink_and_restart(session, spark, tmp_path, clicks):
    options = f"'connector'='filesystem','format'='parquet','path'='{tmp_path}/out','partition_by'='user'"
    run(session, "p1", "SELECT user, v FROM clicks WHERE v > 5", options)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 24
    again = Session(spark, str(tmp_path / "catalog.json"), session.checkpoints, available_now=True)
    again.restore()
    again.wait("p1")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 24


def test_show_and_drop(session):
    assert [r.table_name for r in session.sql("SHOW TABLES").df.collect()] == ["clicks"]
    assert "WATERMARK" in session.sql("SHOW CREATE TABLE clicks").df.first().ddl
    run(session, "d1", "SELECT user FROM clicks")
    assert session.sql("SHOW STREAMING TABLES").df.first().status == "Finished"
    assert session.sql("SHOW CREATE STREAMING TABLE d1").df.first().ddl.startswith("CREATE STREAMING TABLE d1")
    assert session.sql("CREATE STREAMING TABLE d1 WITH ('connector'='memory') AS SELECT user FROM clicks").code == 409
    assert session.sql("DROP STREAMING TABLE d1; DROP TABLE clicks").ok
    assert session.sql("DROP TABLE clicks").code == 404
    assert session.sql("DROP TABLE IF EXISTS clicks").ok
    assert session.sql("SELECT 1").code == 400


class Counter(Processor):
    """Counts words; the total runs over all of them."""

    def init(self, ctx, config):
        self.words, self.total = ctx.get_or_create_kv_store("words"), ValueState(ctx.getOrCreateKVStore("all"), "total", "int64")

    def process(self, ctx, source_id, data):
        word = data.decode().strip()
        if not word:
            return
        n = int(self.words.get_state(word.encode()) or b"0") + 1
        self.words.put_state(word.encode(), str(n).encode())
        self.total.update((self.total.value() or 0) + 1)
        ctx.emit(json.dumps({"word": word, "count": n, "total": self.total.value()}).encode())


def counted(words):
    return [json.loads(v) for _, v in run_bounded(Counter, {}, [(0, w.encode()) for w in words])]


def test_counter():
    """Each word's own count and the running total, over any mix of words and blanks."""
    words = [w for k in range(40) for w in ([f"w{k % 7}"] if k % 3 else [f"w{k % 7}", "\t "])]
    seen: dict[str, int] = {}
    out = counted(words)
    real = [w for w in words if w.strip()]
    assert len(out) == len(real)
    for n, (row, word) in enumerate(zip(out, real, strict=True), start=1):
        seen[word] = seen.get(word, 0) + 1
        assert row == {"word": word, "count": seen[word], "total": n}
    assert counted(["", " "]) == []


class Watching(Processor):
    """Emits which callbacks were made, and how often its key has been seen."""

    def init(self, ctx, config):
        self.seen = ctx.get_or_create_kv_store("seen")

    def process(self, ctx, source_id, data):
        n = int(self.seen.get_state(b"n") or b"0") + 1
        self.seen.put_state(b"n", str(n).encode())
        ctx.emit(b"row %d" % n, 1)

    def process_watermark(self, ctx, source_id, watermark):
        ctx.emit_watermark(watermark)
        ctx.emit(b"source %d at %d" % (source_id, ctx.watermarks[0]))

    def take_checkpoint(self, ctx, checkpoint_id):
        ctx.emit(b"batch %d" % checkpoint_id)

    def check_heartbeat(self, ctx):
        return not ctx.config.get("ill")


def test_callbacks_and_keys(spark, tmp_path):
    """Watermarks by source, checkpoints by batch, a key of the task's own; a failed heartbeat ends the query."""
    path = str(tmp_path / "in")
    rows = [(json.dumps({"id": i}), T0 + timedelta(seconds=k)) for k, i in enumerate(["a", "b", "a", "a"])]
    spark.createDataFrame(rows, "value string, timestamp timestamp").coalesce(1).write.parquet(path)
    s = Session(spark, None, str(tmp_path / "cp"), available_now=True)
    stream = lambda: spark.readStream.schema("value string, timestamp timestamp").parquet(path)
    got = []
    d = s.create_function(Watching, {"name": "watching", "key-by": "id"}, [stream()])
    d.sink = lambda out, n: got.extend(bytes(r.value).decode() for r in out.collect())
    d.start(available_now=True)
    d.wait()
    ms = int(T0.timestamp() * 1000)
    assert sorted(got) == sorted(["row 1", "row 2", "row 3", f"source 0 at {ms + 3000}", "batch 1", "row 1", f"source 0 at {ms + 1000}", "batch 1"])
    ill = s.create_function(Watching, {"name": "ill", "init-config": {"ill": True}}, [stream()])
    ill.sink = lambda out, n: out.collect()
    ill.start(available_now=True)
    with pytest.raises(Exception, match="heartbeat"):
        ill.wait()
    assert ill.status() == "Error"


def test_functions_are_restored(spark, tmp_path):
    (tmp_path / "f.py").write_text("from rivulet.streaming.processor import Processor\n\n\nclass Echo(Processor):\n    def process(self, ctx, source_id, data):\n        ctx.emit(data)\n")
    (tmp_path / "f.yaml").write_text(f"name: echo\ninput-groups:\n  - inputs:\n      - input-type: file\n        path: {tmp_path}/in\noutputs:\n  - output-type: file\n    path: {tmp_path}/out\n")
    spark.createDataFrame([("x",), ("y",)], "value string").write.text(str(tmp_path / "in"))
    make = lambda: Session(spark, str(tmp_path / "catalog.json"), str(tmp_path / "cp"), available_now=True)
    first = make()
    assert first.sql(f"CREATE FUNCTION WITH ('function_path' = '{tmp_path}/f.py', 'config_path' = '{tmp_path}/f.yaml')").ok
    again = make()
    assert again.sql("START FUNCTION echo").code == 404
    again.restore()
    assert again.sql("START FUNCTION echo").ok
    again.functions["echo"].wait()
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/batch=*").collect()) == ["x", "y"]
    assert again.sql("DROP FUNCTION echo").ok
    third = make()
    third.restore()
    assert third.functions == {}


def test_counter_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("a",), ("b",), ("",), ("a",)], "value string").coalesce(1).write.text(path)
    s = Session(spark, None, str(tmp_path / "cp"), available_now=True)
    rows = spark.readStream.format("text").schema("value string").load(path)
    d = s.create_function(Counter, {"name": "counter", "outputs": [{"output-type": "file", "path": str(tmp_path / "out")}]}, [rows])
    assert s.sql("SHOW FUNCTIONS").df.first().status == "Initialized"
    assert s.sql("START FUNCTION counter").ok
    d.wait()
    got = sorted((r["word"], r["count"], r["total"]) for r in map(json.loads, (x.value for x in spark.read.text(str(tmp_path / "out/batch=*")).collect())))
    assert [(w, n) for w, n, _ in got] == [("a", 1), ("a", 2), ("b", 1)] and sorted(t for *_, t in got) == [1, 2, 3]
    assert s.sql("DROP FUNCTION counter").ok and s.sql("START FUNCTION counter").code == 404


def test_stores_and_states():
    kv = KvStore(DictBackend())
    for k in (b"a", b"b", b"c"):
        kv.put_state(k, b"1")
    assert kv.list_states(b"a", b"c") == [b"a", b"b"]
    kv.delete_state(b"a")
    assert kv.get_state(b"a") is None
    key = ComplexKey(b"g", b"k", b"n", b"u")
    kv.merge(key, b"x")
    kv.merge(key, b"y")
    assert kv.get(key) == b"xy" and kv.list_complex(b"g", b"k", b"n", b"a", b"z") == [b"u"]
    kv.delete_prefix(ComplexKey(b"g", b"k", b"n"))
    assert kv.get(key) is None
    values = ListState(kv, "l", "int64")
    values.add(1)
    values.add(-2)
    assert values.get() == [1, -2]
    m = MapState(kv, "m", "int64", "string")
    m.put(-1, "x")
    m.put(-5, "y")
    assert m.items() == [(-5, "y"), (-1, "x")]
    q = PriorityQueueState(kv, "q", "float64")
    for x in (2.5, -1.0, 0.0):
        q.add(x)
    assert [q.poll() for _ in range(4)] == [-1.0, 0.0, 2.5, None]
    top = Keyed(ReducingState, kv, "r", max)
    top("a").add(3)
    top("a").add(2)
    top("b").add(1)
    assert (top("a").get(), top("b").get()) == (3, 1)
    mean = AggregatingState(kv, "avg", lambda: (0, 0), lambda acc, x: (acc[0] + x, acc[1] + 1), lambda acc: acc[0] / acc[1])
    mean.add(1)
    mean.add(4)
    assert mean.get() == 2.5


def test_config_without_the_library():
    from rivulet.streaming.processor import _plain_yaml

    text = "name: t\ntype: python\ninput-groups:\n  - inputs:\n      - input-type: kafka\n        topic: 'a'\n        partition: 0\noutputs:\n- output-type: kafka\n  topic: b # the sink\ninit-config:\n  k: true\n"
    assert _plain_yaml(text) == read_config(text)
