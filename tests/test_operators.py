from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivulet.errors import PlanError
from rivulet.operators import cdc, joins, sets, stateless, windows

T0 = datetime(2024, 1, 1)


def at(**kw):
    return T0 + timedelta(**kw)


def test_tumble_boundary(spark):
    df = spark.createDataFrame([(at(seconds=0), 1), (at(seconds=59, microseconds=999999), 1), (at(seconds=60), 1)], "ts timestamp, k int")
    out = windows.flat(windows.windowed(df, windows.tumble("ts", "1 minute"), ["k"], [F.count("*").alias("n")])).orderBy("window_start").collect()
    assert [(r.window_start, r.n) for r in out] == [(at(seconds=0), 2), (at(seconds=60), 1)]


def test_hop_fan_out_and_rule(spark):
    df = spark.createDataFrame([(at(seconds=5), 1)], "ts timestamp, k int")
    assert windows.windowed(df, windows.hop("ts", "1 minute", "10 minutes"), [], [F.count("*").alias("n")]).count() == 10
    with pytest.raises(PlanError):
        windows.hop("ts", "3 minutes", "10 minutes")
    with pytest.raises(PlanError):
        windows.tumble("ts", "1 month")


def test_session_boundary(spark):
    rows = [(at(seconds=0), 1), (at(seconds=30), 1), (at(seconds=0), 2), (at(seconds=30, microseconds=1), 2)]
    df = spark.createDataFrame(rows, "ts timestamp, k int")
    out = windows.flat(windows.windowed(df, windows.session("ts", "30 seconds"), ["k"], [F.count("*").alias("n")])).collect()
    assert sorted((r.k, r.n) for r in out) == [(1, 2), (2, 1), (2, 1)]
    assert next(r.window_end for r in out if r.k == 1) == at(seconds=60)


@pytest.mark.parametrize(("how", "n"), [("inner", 1), ("left", 3), ("right", 3), ("full", 5)])
def test_window_join_kinds(spark, how, n):
    make = lambda ks, name: windows.windowed(spark.createDataFrame([(at(seconds=1), k) for k in ks], "ts timestamp, k int"), windows.tumble("ts", "1 minute"), ["k"], [F.count("*").alias(name)])
    out = joins.window_join(make([1, 2, None], "a"), make([2, 3, None], "b"), ["k"], how)
    assert out.count() == n
    with pytest.raises(PlanError):
        joins.window_join(make([1], "a"), make([1], "b").drop("window"), ["k"])


def test_unroll_and_errors(spark):
    rows = [(None, (1, "a"), "c"), (None, (2, "b"), "r"), ((1, "a"), (1, "x"), "u"), ((2, "b"), None, "d")]
    df = spark.createDataFrame(rows, "before struct<id:int,v:string>, after struct<id:int,v:string>, op string")
    out = [(r.id, r.v, r._updating_meta.is_retract) for r in cdc.unroll(df, ["id"]).collect()]
    assert out == [(1, "a", False), (2, "b", False), (1, "a", True), (1, "x", False), (2, "b", True)]
    bad = spark.createDataFrame([(None, (1, "a"), "x")], df.schema)
    with pytest.raises(Exception, match="unknown change operation"):
        cdc.unroll(bad, ["id"]).collect()
    with pytest.raises(PlanError):
        cdc.unroll(df, [])


def test_pack(spark):
    log = [(1, "a", False, 0), (1, "b", False, 1), (2, "a", True, 0), (2, "b", True, 1), (3, "a", True, 0), (3, "b", False, 1), (4, "a", False, 0), (4, "b", True, 1)]
    df = spark.createDataFrame(log, "id int, v string, gone boolean, seq int").withColumn(cdc.META, F.struct(F.col("gone").alias("is_retract"), cdc.multi_hash("id").alias("id"))).drop("gone")
    out = {(r.op, r.before and r.before.v, r.after and r.after.v) for r in cdc.pack(df, "seq").collect()}
    assert out == {("c", None, "b"), ("d", "a", None), ("u", "a", "b")}
    plain = cdc.pack(df.drop(cdc.META), "seq").collect()
    assert {r.op for r in plain} == {"c"} and len(plain) == 8


def test_changelog(spark):
    df = spark.createDataFrame([(1, 5, 0), (1, 3, 1), (1, 9, 2), (2, 1, 3)], "k int, v int, t int")
    out = sorted((r.k, r.t, not r._updating_meta.is_retract, r.top) for r in cdc.changelog(df, ["k"], {"top": F.max("v")}, "t").collect())
    assert out == [(1, 0, True, 5), (1, 2, False, 5), (1, 2, True, 9), (2, 3, True, 1)]


def test_sets_and_unnest(spark):
    a = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, xs array<int>")
    assert sorted((r.k, r.x) for r in stateless.unnest(a, "xs", "x").collect()) == [(1, 1), (1, 2)]
    with pytest.raises(PlanError):
        stateless.unnest(a, "k")
    b = a.select("k")
    assert sets.union(b, b).count() == 3 and sets.union_all(b, b).count() == 6
    with pytest.raises(PlanError):
        sets.union_all(a, b)


async def slow_double(x):
    import asyncio

    await asyncio.sleep(0.01 * (3 - x))
    return 2 * x


def test_async_map(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int").coalesce(1)
    assert [r.y for r in stateless.async_map(df, slow_double, ["x"], "y", "int").collect()] == [2, 4]
    assert [r.y for r in stateless.async_map(df, slow_double, ["x"], "y", "int", ordered=False).collect()] == [4, 2]
