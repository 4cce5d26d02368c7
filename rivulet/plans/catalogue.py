"""The registered queries, each with the SQL that gives the same rows.

All run in batch mode over whole tables; sums of doubles are returned as whole
cents, times without a zone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions import json as json_functions
from rivulet.functions import dialect, scalar, udf
from rivulet.operators import cdc, joins, over, sets, stateless, windows
from rivulet.plans.query import Compiler
from rivulet.sources.formats import decode_json, encode_json

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The end of a window of so many seconds, in oracle SQL.
_BIN = "make_timestamp((epoch_us(ts) // {us}) * {us})"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``, with its oracle SQL if there is one."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str | Column) -> Column:
    """A sum of amounts as whole cents. Each amount is rounded before it is added
    up, so the order of adding does not matter."""
    return F.sum(F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("long"))


_C = "CAST(sum(CAST(round({0} * 100) AS BIGINT)) AS BIGINT)"


def bin_sql(minutes: int) -> str:
    return _BIN.format(us=minutes * 60 * 10**6)


# --- windows


@register("tumble_hourly", f"SELECT {bin_sql(60)} AS window_start, {bin_sql(60)} + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, {_C.format('value')} AS cents FROM events GROUP BY ALL")
def tumble_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return windows.flat(windows.windowed(events, windows.tumble("ts", "1 hour"), ["event_type"], [F.count("*").alias("n"), cents("value").alias("cents")]))


@register("tumble_global", f"SELECT {bin_sql(10)} AS window_start, {bin_sql(10)} + INTERVAL 10 MINUTE AS window_end, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def tumble_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return windows.flat(windows.windowed(events, windows.tumble("ts", "10 minutes"), [], [F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")]))


_HOP = "SELECT make_timestamp(s * 600000000) AS window_start, make_timestamp((s + 6) * 600000000) AS window_end, event_type, {0} FROM (SELECT *, unnest(generate_series(epoch_us(ts) // 600000000 - 5, epoch_us(ts) // 600000000)) AS s FROM events) GROUP BY ALL"


@register("hop_distinct_users", _HOP.format("count(DISTINCT user_id) AS users"))
def hop_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return windows.flat(windows.hop_distinct_by_panes(events, "ts", "10 minutes", "1 hour", ["event_type"], "user_id", "users"))


@register("hop_by_panes", _HOP.format(f"count(*) AS n, {_C.format('value')} AS cents"))
def hop_by_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return windows.flat(windows.hop_by_panes(events, "ts", "10 minutes", "1 hour", ["event_type"], {"n": F.lit(1), "cents": F.round(F.col("value") * 100).cast("long")}))


@register(
    "session_users",
    """
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k
    """,
)
def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return windows.flat(windows.windowed(events, windows.session("ts", "30 minutes"), ["user_id"], [F.count("*").alias("n")]))


@register("window_having", f"SELECT {bin_sql(60)} AS window_start, {bin_sql(60)} + INTERVAL 1 HOUR AS window_end, user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY ALL HAVING count(*) > 1")
def window_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    counted = windows.windowed(events, windows.tumble("ts", "1 hour"), ["user_id"], [F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks")])
    return windows.flat(counted.where("n > 1"))


@register("window_reaggregate", f"SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, max(n) AS most, count(*) AS types FROM (SELECT {bin_sql(60)} AS w, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY w")
def window_reaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = windows.windowed(events, windows.tumble("ts", "1 hour"), ["event_type"], [F.count("*").alias("n")])
    return windows.flat(windows.reaggregate(first, [], [F.max("n").alias("most"), F.count("*").alias("types")]))


@register("window_distinct_two_step", f"SELECT {bin_sql(60)} AS window_start, {bin_sql(60)} + INTERVAL 1 HOUR AS window_end, event_type, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def window_distinct_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return windows.flat(windows.distinct_within(events, windows.tumble("ts", "1 hour"), ["event_type"], "user_id", "users"))


@register("window_event_time", f"SELECT event_type, {bin_sql(60)} + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND AS event_time, count(*) AS n FROM events GROUP BY ALL")
def window_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = windows.windowed(table(spark, sf_dir, "events"), windows.tumble("ts", "1 hour"), ["event_type"], [F.count("*").alias("n")])
    return counted.select("event_type", windows.event_time().alias("event_time"), "n")


# --- the SQL front end in batch mode


def _through_sql(spark: SparkSession, sf_dir: str, sql: str, tables: dict[str, str], streaming_rules: bool = True) -> DataFrame:
    """A query of the dialect over driver tables; the values name the event times."""
    for name, time in tables.items():
        df = table(spark, sf_dir, name)
        (df.withColumn("_timestamp", F.col(time)) if time else df).createOrReplaceTempView(name)
    scalar.register(spark)
    dialect.register(spark)
    compiled = Compiler(spark, sql, lambda n: n in tables, streaming=streaming_rules).compile()
    df = spark.sql(compiled.sql)
    return df.drop("_timestamp") if "_timestamp" in df.columns else df


def _dialect(name: str, sql: str, tables: dict[str, str], oracle: str, streaming_rules: bool = True, window: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _through_sql(spark, sf_dir, sql, tables, streaming_rules)
        return windows.flat(df, window) if window else df

    register(name, oracle)(run)


_dialect(
    "sql_tumble",
    "SELECT TUMBLE(INTERVAL '5' MINUTE) AS w, event_type, COUNT(*) AS n FROM events WHERE value > 10 GROUP BY 1, event_type HAVING COUNT(*) > 0",
    {"events": "ts"},
    f"SELECT {bin_sql(5)} AS window_start, {bin_sql(5)} + INTERVAL 5 MINUTE AS window_end, event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY ALL",
    window="w",
)
_dialect("sql_hop", "SELECT HOP(INTERVAL '10' MINUTE, INTERVAL '1' HOUR) AS w, event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY w, event_type", {"events": "ts"}, _HOP.format("CAST(count(DISTINCT user_id) AS INTEGER) AS users"), window="w")
_dialect("sql_session", "SELECT SESSION(INTERVAL '30' MINUTE) AS w, user_id, COUNT(*) AS n FROM events GROUP BY 1, user_id", {"events": "ts"}, _SQL["session_users"], window="w")
_dialect(
    "sql_window_join",
    """
    SELECT v.w AS w, v.user_id, v.views, COALESCE(c.clicks, 0) AS clicks
    FROM (SELECT TUMBLE(INTERVAL '1' DAY) AS w, user_id, COUNT(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, user_id) v
    LEFT JOIN (SELECT TUMBLE(INTERVAL '1' DAY) AS w, user_id, COUNT(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1, user_id) c
    ON v.w = c.w AND v.user_id = c.user_id
    """,
    {"events": "ts"},
    f"""
    WITH x AS (SELECT {bin_sql(1440)} AS w, user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT v.w AS window_start, v.w + INTERVAL 1 DAY AS window_end, v.user_id, v.n AS views, coalesce(c.n, 0) AS clicks
    FROM (SELECT * FROM x WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM x WHERE event_type = 'click') c ON v.w = c.w AND v.user_id = c.user_id
    """,
    window="w",
)
_dialect(
    "sql_over_top",
    """
    SELECT w, user_id, n, r FROM (
      SELECT w, user_id, n, ROW_NUMBER() OVER (PARTITION BY w ORDER BY n DESC, user_id) AS r
      FROM (SELECT TUMBLE(INTERVAL '1' DAY) AS w, user_id, COUNT(*) AS n FROM events GROUP BY 1, user_id) t) u
    WHERE r <= 3
    """,
    {"events": "ts"},
    f"SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, user_id, n, r FROM (SELECT w, user_id, n, CAST(row_number() OVER (PARTITION BY w ORDER BY n DESC, user_id) AS INTEGER) AS r FROM (SELECT {bin_sql(1440)} AS w, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 3",
    window="w",
)
_dialect(
    "sql_nested_window",
    "SELECT TUMBLE(INTERVAL '1' HOUR) AS w, MAX(n) AS most FROM (SELECT TUMBLE(INTERVAL '1' HOUR) AS w, user_id, COUNT(*) AS n FROM events GROUP BY 1, user_id) x GROUP BY 1",
    {"events": "ts"},
    f"SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, max(n) AS most FROM (SELECT {bin_sql(60)} AS w, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY w",
    window="w",
)
_dialect("sql_row_time", "SELECT event_id, row_time() AS t FROM events WHERE event_type = 'purchase'", {"events": "ts"}, "SELECT event_id, ts AS t FROM events WHERE event_type = 'purchase'")
_dialect("sql_cte_case_union", "WITH big AS (SELECT event_id, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS band FROM events) SELECT event_id, band FROM big WHERE band = 'high' UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'error'", {"events": "ts"}, "SELECT event_id, 'high' AS band FROM events WHERE value > 100 UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'error'")
_dialect("sql_updating_aggregate", "SELECT user_id, COUNT(*) AS n, MAX(event_id) AS last FROM events GROUP BY user_id", {"events": "ts"}, "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
_dialect("sql_updating_join", "SELECT o_orderkey, o_orderstatus, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45", {"orders": "", "lineitem": ""}, "SELECT o_orderkey, o_orderstatus, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45")
_dialect(
    "sql_batch_extras",
    "SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'P') GROUP BY ROLLUP (c_mktsegment) ORDER BY n LIMIT 100",
    {"customer": "", "orders": ""},
    "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'P') GROUP BY ROLLUP (c_mktsegment)",
    streaming_rules=False,
)


# --- stateless, sets


@register("project_filter", "SELECT event_id, upper(event_type) AS kind, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value > 50 AND event_type IS NOT NULL")
def project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return stateless.project(stateless.keep(events, "value > 50 and event_type is not null"), "event_id", F.upper("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("cents"))


@register("union_distinct", "SELECT user_id, event_type FROM events WHERE value < 20 UNION SELECT user_id, event_type FROM events WHERE value > 80")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return sets.union(e.where("value < 20").drop("value"), e.where("value > 80").drop("value"))


@register("distinct_rows", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.distinct(table(spark, sf_dir, "events").select("user_id", "event_type"))


@register("intersect_users", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def intersect_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sets.intersect(e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'purchase'").select("user_id"))


@register("except_customers", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.except_(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey"))


@register("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return sets.semi(table(spark, sf_dir, "customer"), orders, [("c_custkey", "o_custkey")]).select("c_custkey", "c_name")


@register("anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return sets.semi(table(spark, sf_dir, "customer"), orders, [("c_custkey", "o_custkey")], anti=True).select("c_custkey", "c_name")


@register("key_by", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def key_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouping reuses the partitioning that KeyBy made."""
    return sets.keyed(table(spark, sf_dir, "events").select("user_id"), ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@register("unnest_embeddings", "SELECT vec_id, CAST(round(v * 1000) AS BIGINT) AS milli FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings)")
def unnest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product is a float, as in SQL; Spark's is a double for a float and an int,
    which rounds otherwise next to a half."""
    e = stateless.unnest(table(spark, sf_dir, "embeddings"), "embedding", "v")
    return e.select("vec_id", F.round(F.col("v") * F.lit(1000).cast("float")).cast("long").alias("milli"))


async def _twice(x: int) -> int:
    return 2 * x


@register("async_udf", "SELECT event_id, 2 * user_id AS twice FROM events")
def async_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateless.async_map(table(spark, sf_dir, "events").select("event_id", "user_id"), _twice, ["user_id"], "twice", "long").drop("user_id")


# --- joins


def _by_window(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return windows.windowed(events, windows.tumble("ts", "1 hour"), ["user_id"], [F.count("*").alias(name)])


def _window_join(how: str) -> None:
    oracle = f"""
    WITH x AS (SELECT {bin_sql(60)} AS w, user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
    v AS (SELECT * FROM x WHERE event_type = 'view'), c AS (SELECT * FROM x WHERE event_type = 'click')
    SELECT coalesce(v.w, c.w) AS window_start, coalesce(v.w, c.w) + INTERVAL 1 HOUR AS window_end, coalesce(v.user_id, c.user_id) AS user_id, v.n AS views, c.n AS clicks
    FROM v {how.upper()} JOIN c ON v.w = c.w AND v.user_id = c.user_id
    """

    @register(f"window_join_{how}", oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windows.flat(joins.window_join(_by_window(spark, sf_dir, "view", "views"), _by_window(spark, sf_dir, "click", "clicks"), ["user_id"], how))


for _how in ("inner", "left", "right", "full"):
    _window_join(_how)


@register("window_join_residual", f"WITH x AS (SELECT {bin_sql(60)} AS w, user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT v.w AS window_start, v.w + INTERVAL 1 HOUR AS window_end, v.user_id AS user_id, c.user_id AS other FROM x v JOIN x c ON v.w = c.w AND v.event_type = 'view' AND c.event_type = 'error' AND v.user_id < c.user_id")
def window_join_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the window is equal; the rest of the condition is a comparison."""
    v = _by_window(spark, sf_dir, "view", "views").drop("views")
    c = _by_window(spark, sf_dir, "error", "errors").select("window", F.col("user_id").alias("other"))
    return windows.flat(joins.window_join(v, c, [], "inner", condition=F.col("l.user_id") < F.col("r.other")))


@register("expiring_join", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 60 DAY AND o_orderdate + INTERVAL 60 DAY")
def expiring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.expiring_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), [("o_orderkey", "l_orderkey")], "o_orderdate", "l_shipdate", "60 days").select("o_orderkey", "l_linenumber")


@register("interval_join", "SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("au"), F.col("ts").alias("at"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("bu"), F.col("ts").alias("bt"))
    return joins.interval_join(a, b, [("au", "bu")], "at", "bt", "0 seconds", "2 hours").select("click", "purchase")


@register("lookup_join", "SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    found = joins.lookup_join(joins.lookup_join(orders, customers, [("o_custkey", "c_custkey")], "left"), nations, [("c_nationkey", "n_nationkey")], "left")
    return found.select("o_orderkey", "c_mktsegment", "n_name")


# --- window functions


_DAILY = f"(SELECT {bin_sql(1440)} AS w, event_type, user_id, count(*) AS n FROM events GROUP BY ALL)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(table(spark, sf_dir, "events"), windows.tumble("ts", "1 day"), ["event_type", "user_id"], [F.count("*").alias("n")])


@register("over_top_k", f"SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, event_type, user_id, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY w, event_type ORDER BY n DESC, user_id) AS r FROM {_DAILY}) WHERE r <= 3")
def over_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.flat(over.top_k(_daily(spark, sf_dir), 3, [F.desc("n"), "user_id"], ["event_type"]))


@register(
    "over_functions",
    f"""
    SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, event_type, user_id, n, CAST(rank() OVER o AS INTEGER) AS rnk, CAST(dense_rank() OVER o AS INTEGER) AS drnk,
      CAST(ntile(4) OVER u AS INTEGER) AS quarter, lag(n) OVER u AS before, lead(n) OVER u AS after, first_value(n) OVER u AS first, nth_value(n, 2) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
      CAST(sum(n) OVER (u ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS two, CAST(round(percent_rank() OVER o * 1000000) AS BIGINT) AS pr, CAST(round(cume_dist() OVER o * 1000000) AS BIGINT) AS cd
    FROM {_DAILY} WINDOW o AS (PARTITION BY w, event_type ORDER BY n), u AS (PARTITION BY w, event_type ORDER BY user_id)
    """,
)
def over_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, u = over.spec(["event_type"], ["n"]), over.spec(["event_type"], ["user_id"])
    whole = u.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    millionths = lambda c: F.round(c * 1000000).cast("long")
    return windows.flat(
        over.with_over(
            _daily(spark, sf_dir),
            {
                "rnk": F.rank().over(o), "drnk": F.dense_rank().over(o), "quarter": F.ntile(4).over(u), "before": F.lag("n").over(u), "after": F.lead("n").over(u),
                "first": F.first("n").over(u), "second": F.nth_value("n", 2).over(whole), "two": F.sum("n").over(u.rowsBetween(-1, 0)), "pr": millionths(F.percent_rank().over(o)), "cd": millionths(F.cume_dist().over(o)),
            },
        )
    )


@register("over_groups_frame", f"SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, event_type, user_id, n, CAST(sum(n) OVER (PARTITION BY w, event_type ORDER BY n GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM {_DAILY}")
def over_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.flat(over.groups_frame_sum(_daily(spark, sf_dir), "n", ["window", "event_type"], "n", 1, 0, "s"))


# --- change data


def _orders_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as envelopes: created, every third updated, every fifth deleted."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    row = F.struct("o_orderkey", "o_orderstatus", "o_custkey")
    new = F.struct("o_orderkey", F.lit("X").alias("o_orderstatus"), "o_custkey")
    last = F.when(F.col("o_orderkey") % 3 == 0, new).otherwise(row)
    none = F.lit(None).cast(o.select(row.alias("r")).schema["r"].dataType)
    step = lambda b, a, op: F.struct(b.alias("before"), a.alias("after"), F.lit(op).alias("op"))
    steps = F.array_compact(F.array(step(none, row, "c"), F.when(F.col("o_orderkey") % 3 == 0, step(row, new, "u")), F.when(F.col("o_orderkey") % 5 == 0, step(last, none, "d"))))
    return o.select(F.explode(steps).alias("e")).select("e.*")


@register("cdc_unroll", "SELECT o_orderstatus, is_retract, count(*) AS n FROM (SELECT o_orderstatus, false AS is_retract FROM orders UNION ALL SELECT o_orderstatus, true FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'X', false FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END, true FROM orders WHERE o_orderkey % 5 = 0) GROUP BY ALL")
def cdc_unroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cdc.unroll(_orders_changes(spark, sf_dir), ["o_orderkey"])
    return rows.groupBy("o_orderstatus", F.col("_updating_meta.is_retract").alias("is_retract")).agg(F.count("*").alias("n"))


@register("cdc_aggregate", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS custkeys FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")
def cdc_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cdc.unroll(_orders_changes(spark, sf_dir), ["o_orderkey"])
    return cdc.applied(rows, ["o_orderstatus"], {"custkeys": "o_custkey"})


@register("cdc_pack", "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'gone' ELSE 'c' END AS op, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 0")
def cdc_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cdc.unroll(_orders_changes(spark, sf_dir), ["o_orderkey"])
    # the order of an order's changes: first row, taken back, new row, taken back
    seq = F.when(F.col("o_orderstatus") != "X", F.col("_updating_meta.is_retract").cast("int")).otherwise(2 + F.col("_updating_meta.is_retract").cast("int"))
    packed = cdc.pack(rows.withColumn("seq", seq), "seq")
    return packed.select("op", "after.o_orderkey", F.col("after.o_orderstatus").alias("status"))


@register(
    "updating_changelog",
    """
    WITH x AS (SELECT event_type, event_id, max(user_id) OVER w AS top, lag(event_id) OVER w AS prev FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
    y AS (SELECT *, lag(top) OVER (PARTITION BY event_type ORDER BY event_id) AS old FROM x)
    SELECT event_type, event_id, old AS top, true AS is_retract FROM y WHERE prev IS NOT NULL AND old <> top
    UNION ALL SELECT event_type, event_id, top, false FROM y WHERE prev IS NULL OR old <> top
    """,
)
def updating_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cdc.changelog(table(spark, sf_dir, "events"), ["event_type"], {"top": F.max("user_id")}, "event_id")
    return log.select("event_type", "event_id", "top", F.col("_updating_meta.is_retract").alias("is_retract"))


# --- formats and functions


@register("json_decode_drop", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0")
def json_decode_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh record is broken and dropped."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 7 == 0, "").otherwise("}"))
    from pyspark.sql.types import LongType, StructType

    return decode_json(e.select(text.cast("binary").alias("value")), StructType().add("event_id", LongType()).add("k", LongType()), "drop")


@register("json_encode", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","ts":' || (epoch_us(ts) // 1000) || ',"note":null}' AS value FROM events""")
def json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.lit(None).cast("string").alias("note"))
    return encode_json(e, "unix_millis")


@register("json_functions", """SELECT event_id, props->>'$.k' AS first, [props->>'$.k'] AS every, event_type AS text FROM events""")
def json_functions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", json_functions.get_first_json_object("props", "$.k").alias("first"), json_functions.extract_json("props", "$['k']").alias("every"), json_functions.extract_json_string(F.to_json(F.struct("event_type")), "$.event_type").alias("text"))


@register(
    "scalar_functions",
    """
    SELECT p_partkey, concat(p_name, NULL, '-', p_brand) AS name, strpos(p_brand, '#') AS found_at, lower(to_hex(p_partkey)) AS hexed, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l,
           regexp_replace(p_name, '[aeiou]', '_') AS once, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, starts_with(p_name, 'small') AS small, CAST(trunc(p_retailprice) AS BIGINT) AS whole,
           array_to_string([p_size, p_size + 1], '-') AS joined, len(generate_series(1, p_size)) AS steps
    FROM part
    """,
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", scalar.concat("p_name", F.lit(None).cast("string"), F.lit("-"), "p_brand").alias("name"), scalar.strpos("p_brand", F.lit("#")).cast("long").alias("found_at"), scalar.to_hex("p_partkey").alias("hexed"),
        scalar.gcd("p_partkey", "p_size").alias("g"), scalar.lcm("p_partkey", "p_size").alias("l"), scalar.regexp_replace("p_name", "[aeiou]", "_").alias("once"), scalar.regexp_replace("p_name", "[aeiou]", "_", "g").alias("every"),
        scalar.starts_with("p_name", F.lit("small")).alias("small"), scalar.trunc("p_retailprice").cast("long").alias("whole"), scalar.array_to_string(F.array("p_size", F.col("p_size") + 1), "-").alias("joined"), F.size(scalar.generate_series(1, "p_size")).cast("long").alias("steps"),
    )


@register(
    "date_functions",
    """
    SELECT event_id, date_part('dow', ts) AS dow, date_part('hour', ts) AS hour, time_bucket(INTERVAL 15 MINUTE, ts) AS bin, date_trunc('day', ts) AS day, epoch_us(ts) // 1000000 AS secs FROM events
    """,
)
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", scalar.date_part("dow", "ts").cast("long").alias("dow"), scalar.date_part("hour", "ts").cast("long").alias("hour"), scalar.date_bin("15 minutes", "ts").cast("timestamp_ntz").alias("bin"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.floor(scalar.date_part("epoch", "ts")).alias("secs"),
    )


@register(
    "aggregate_functions",
    f"""
    SELECT l_returnflag, count(*) AS n, {_C.format('l_extendedprice')} AS cents, CAST(round(avg(l_quantity) * 1000000) AS BIGINT) AS mean, median(l_quantity) AS mid, count(DISTINCT l_suppkey) AS suppliers,
           bool_and(l_quantity > 0) AS positive, bool_or(l_discount > 0.09) AS any_discount, bit_or(l_linenumber) AS bits, CAST(round(stddev_samp(l_quantity) * 1000) AS BIGINT) AS sd, CAST(round(corr(l_quantity, l_extendedprice) * 1000) AS BIGINT) AS r,
           CAST(round(regr_slope(l_extendedprice, l_quantity)) AS BIGINT) AS slope, count(*) FILTER (WHERE l_linestatus = 'O') AS open, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses
    FROM lineitem GROUP BY 1
    """,
)
def aggregate_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return li.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), cents("l_extendedprice").alias("cents"), F.round(F.avg(q) * 1000000).cast("long").alias("mean"), F.median(q).alias("mid"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.every(q > 0).alias("positive"), F.some(F.col("l_discount") > 0.09).alias("any_discount"), F.bit_or("l_linenumber").alias("bits"), F.round(F.stddev_samp(q) * 1000).cast("long").alias("sd"),
        F.round(F.corr(q, F.col("l_extendedprice")) * 1000).cast("long").alias("r"), F.round(F.regr_slope(F.col("l_extendedprice"), q)).cast("long").alias("slope"), F.count_if(F.col("l_linestatus") == "O").alias("open"),
        F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("statuses"),
    )


@register("grouping_sets", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_C.format('l_tax')} AS tax FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), cents("l_tax").alias("tax"))


@register("array_functions", "SELECT vec_id, len(embedding) AS n, list_max(embedding) AS high, list_min(embedding) AS low, embedding[1] AS first, len(embedding[1:10]) AS ten FROM embeddings")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.size("embedding").cast("long").alias("n"), F.array_max("embedding").alias("high"), F.array_min("embedding").alias("low"), F.try_element_at("embedding", F.lit(1)).alias("first"), F.size(F.slice("embedding", 1, 10)).cast("long").alias("ten"))


# --- functions as SQL means them, through a session


_COLUMNS = {
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_size INT, p_retailprice DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "lineitem": "l_returnflag STRING, l_linestatus STRING, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>",
}


def _session(name: str, sql: str, of: str, oracle: str) -> None:
    """A bounded query of a session over one file table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from rivulet.streaming.session import Session

        session = Session(spark)
        made = session.sql(f"CREATE TABLE {of} ({_COLUMNS[of]}) WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{sf_dir}/{of}.parquet')")
        if not made.ok:
            raise ValueError(made.message)
        return session.query(sql)

    register(name, oracle)(run)


_session(
    "sql_math",
    """
    SELECT p_partkey, CAST(round(log(p_partkey + 1) * 1000000) AS BIGINT) AS lg, CAST(round(log(2, p_partkey + 1) * 1000000) AS BIGINT) AS lg2, CAST(round(ln(p_partkey + 1) * 1000000) AS BIGINT) AS natural,
      CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(trunc(-p_retailprice / 7) AS BIGINT) AS below, CAST(round(trunc(p_retailprice / 7, 1) * 10) AS BIGINT) AS tenths, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l,
      gcd(0, p_partkey) AS g0, iszero(p_partkey - 7) AS seventh, CAST(pow(p_size, 2) AS BIGINT) AS square, CAST(round(cbrt(p_size) * 1000) AS BIGINT) AS root, signum(p_size - 25.0) AS side, log(CAST(NULL AS DOUBLE)) AS nothing
    FROM part
    """,
    "part",
    """
    SELECT p_partkey, CAST(round(log10(p_partkey + 1) * 1000000) AS BIGINT) AS lg, CAST(round(log2(p_partkey + 1) * 1000000) AS BIGINT) AS lg2, CAST(round(ln(p_partkey + 1) * 1000000) AS BIGINT) AS natural,
      CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(trunc(-p_retailprice / 7) AS BIGINT) AS below, CAST(trunc(p_retailprice / 7 * 10) AS BIGINT) AS tenths, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l,
      p_partkey AS g0, p_partkey = 7 AS seventh, CAST(p_size * p_size AS BIGINT) AS square, CAST(round(cbrt(p_size) * 1000) AS BIGINT) AS root, CAST(sign(p_size - 25) AS DOUBLE) AS side, CAST(NULL AS DOUBLE) AS nothing
    FROM part
    """,
)
_session(
    "sql_strings",
    """
    SELECT p_partkey, concat('a', NULL, p_brand, p_size) AS joined, concat(NULL) AS empty, p_name || NULL AS piped, strpos(p_brand, '#') AS found_at, to_hex(p_partkey) AS hexed, chr(228) AS umlaut, split_part(p_name, ' ', 2) AS second,
      starts_with(p_name, 'small') AS small, ends_with(p_brand, '1') AS one, lpad(p_brand, 10, '*') AS padded, initcap(p_name) AS capital, levenshtein(p_brand, 'Brand') AS far, length(p_name) AS n, sha256(p_name) AS digested, encode(p_brand, 'base64') AS b64,
      CAST(decode('48656c6c6f', 'hex') AS STRING) AS hello, lower(hex(digest(p_brand, 'md5'))) AS md
    FROM part
    """,
    "part",
    """
    SELECT p_partkey, concat('a', NULL, p_brand, p_size) AS joined, '' AS empty, CAST(p_name || NULL AS VARCHAR) AS piped, CAST(strpos(p_brand, '#') AS INTEGER) AS found_at, lower(to_hex(p_partkey)) AS hexed, chr(228) AS umlaut, split_part(p_name, ' ', 2) AS second,
      starts_with(p_name, 'small') AS small, ends_with(p_brand, '1') AS one, lpad(p_brand, 10, '*') AS padded, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS capital, CAST(levenshtein(p_brand, 'Brand') AS INTEGER) AS far,
      CAST(length(p_name) AS INTEGER) AS n, sha256(p_name) AS digested, rtrim(to_base64(encode(p_brand)), '=') AS b64, 'Hello' AS hello, md5(p_brand) AS md
    FROM part
    """,
)
_session(
    "sql_regex",
    r"""
    SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS once, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, regexp_replace('aaa', 'a', 'b') AS first, regexp_replace(p_name, '(\\w)(\\w)', '\\2\\1') AS swapped, regexp_replace(p_name, 'X', '$') AS none,
      regexp_replace(upper(p_name), '[aeiou]', '$', 'gi') AS dollars, regexp_like(p_name, '^S', 'i') AS begins, regexp_count(p_name, '[aeiou]') AS vowels, regexp_match(p_brand, '#(\\d)(\\d)') AS digits, regexp_match(p_name, 'q+z') AS unmatched, regexp_match(p_name, '[a-z]+') AS whole
    FROM part
    """,
    "part",
    r"""
    SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS once, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, 'baa' AS first, regexp_replace(p_name, '(\w)(\w)', '\2\1') AS swapped, p_name AS none,
      regexp_replace(upper(p_name), '[AEIOU]', '$', 'g') AS dollars, regexp_matches(lower(p_name), '^s') AS begins, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER) AS vowels,
      CASE WHEN regexp_matches(p_brand, '#\d\d') THEN [regexp_extract(p_brand, '#(\d)(\d)', 1), regexp_extract(p_brand, '#(\d)(\d)', 2)] END AS digits, CAST(NULL AS VARCHAR[]) AS unmatched,
      CASE WHEN regexp_matches(p_name, '[a-z]+') THEN [regexp_extract(p_name, '[a-z]+')] END AS whole
    FROM part
    """,
)
_session(
    "sql_dates",
    """
    SELECT event_id, date_part('dow', ts) AS dow, EXTRACT(dow FROM TIMESTAMP '2024-03-03 10:00:00') AS sunday, date_part('doy', ts) AS doy, date_part('second', ts) AS s, date_part('millisecond', ts) AS ms, CAST(date_part('epoch', ts) AS BIGINT) AS secs,
      CAST(date_bin(INTERVAL '15' MINUTE, ts) AS TIMESTAMP_NTZ) AS bin, CAST(date_bin(INTERVAL '1' HOUR, ts, TIMESTAMP '1970-01-01 00:20:00') AS TIMESTAMP_NTZ) AS shifted, to_unixtime(ts) AS unix, to_local_time(ts) AS local,
      to_char(ts, '%Y-%m-%d at %H:%M') AS text, CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ) AS month, CAST(from_unixtime(86400) AS TIMESTAMP_NTZ) AS day_two, CAST(to_timestamp_millis(1500) AS TIMESTAMP_NTZ) AS after, date_part('dow', CAST(NULL AS TIMESTAMP)) AS nothing
    FROM events
    """,
    "events",
    """
    SELECT event_id, CAST(date_part('dow', ts) AS INTEGER) AS dow, CAST(0 AS INTEGER) AS sunday, CAST(date_part('doy', ts) AS INTEGER) AS doy, CAST(date_part('second', ts) AS INTEGER) AS s, CAST(date_part('millisecond', ts) AS INTEGER) AS ms, epoch_us(ts) // 1000000 AS secs,
      time_bucket(INTERVAL 15 MINUTE, ts) AS bin, make_timestamp((epoch_us(ts) - 1200000000) // 3600000000 * 3600000000 + 1200000000) AS shifted, epoch_us(ts) // 1000000 AS unix, ts AS local,
      strftime(ts, '%Y-%m-%d at %H:%M') AS text, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, TIMESTAMP '1970-01-02 00:00:00' AS day_two, TIMESTAMP '1970-01-01 00:00:01.5' AS after, CAST(NULL AS INTEGER) AS nothing
    FROM events
    """,
)
_session(
    "sql_arrays",
    """
    SELECT vec_id, array_length(embedding) AS n, cardinality(make_array(1, 2, NULL)) AS three, array_has(make_array(1, 2), 2) AS has, array_has_all(make_array(1, 2, 3), make_array(3, 1)) AS has_all, array_has_any(make_array(1), make_array(2, 3)) AS has_any,
      array_position(make_array('a', 'b'), 'b') AS place, array_position(make_array('a'), 'z') AS no_place, array_positions(make_array(5, 6, 5), 5) AS places, array_remove(make_array(5, 6, 5), 5) AS less, array_remove_all(make_array(5, 6, 5), 5) AS none_left,
      array_replace(make_array(5, 6, 5), 5, 9) AS one_new, array_replace_all(make_array(5, 6, 5), 5, 9) AS all_new, array_slice(make_array(1, 2, 3, 4), 2, 3) AS middle, array_resize(make_array(1, 2), 3, 0) AS longer, array_pop_back(make_array(1, 2)) AS front, array_pop_front(make_array(1, 2)) AS back,
      array_to_string(make_array(1, NULL, 3), '-', 'x') AS text, string_to_array('a.b.c', '.') AS pieces, generate_series(1, 4) AS series, range(1, 4) AS open, array_concat(make_array(1), make_array(2, 3)) AS both, array_element(make_array(1, 2), 5) AS beyond, empty(make_array(1)) AS bare,
      array_reverse(make_array(1, 2)) AS turned, map_extract(map('k', 1), 'k') AS value
    FROM embeddings
    """,
    "embeddings",
    """
    SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(3 AS INTEGER) AS three, true AS has, true AS has_all, false AS has_any, CAST(2 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS no_place, [CAST(1 AS BIGINT), 3] AS places, [6, 5] AS less, [6] AS none_left,
      [9, 6, 5] AS one_new, [9, 6, 9] AS all_new, [2, 3] AS middle, [1, 2, 0] AS longer, [1] AS front, [2] AS back, '1-x-3' AS text, ['a', 'b', 'c'] AS pieces, [1, 2, 3, 4] AS series, [1, 2, 3] AS open, [1, 2, 3] AS both, CAST(NULL AS INTEGER) AS beyond, false AS bare, [2, 1] AS turned, [1] AS value
    FROM embeddings
    """,
)
_session(
    "sql_aggregates",
    f"""
    SELECT l_returnflag, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers, approx_distinct(l_linenumber) AS about, bool_and(l_quantity > 0) AS positive, bool_or(l_discount > 0.09) AS some_discount, bit_and(l_linenumber) AS b_and, bit_or(l_linenumber) AS b_or, bit_xor(l_linenumber) AS b_xor,
      median(l_quantity) AS mid, approx_median(l_linenumber) AS line, CAST(round(var(l_quantity) * 1000) AS BIGINT) AS v, CAST(round(var_pop(l_quantity) * 1000) AS BIGINT) AS vp, CAST(round(stddev_pop(l_quantity) * 1000) AS BIGINT) AS sp, CAST(round(covar_samp(l_quantity, l_discount) * 1000) AS BIGINT) AS cs,
      CAST(round(covar_pop(l_quantity, l_discount) * 1000) AS BIGINT) AS cp, CAST(round(regr_slope(l_extendedprice, l_quantity)) AS BIGINT) AS slope, CAST(round(regr_intercept(l_extendedprice, l_quantity)) AS BIGINT) AS cut, regr_count(l_extendedprice, l_quantity) AS pairs, CAST(round(regr_r2(l_extendedprice, l_quantity) * 1000) AS BIGINT) AS r2,
      CAST(round(regr_avgx(l_extendedprice, l_quantity) * 1000) AS BIGINT) AS ax, CAST(round(regr_sxx(l_extendedprice, l_quantity)) AS BIGINT) AS sxx, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS open, array_sort(array_agg(DISTINCT l_linestatus)) AS statuses
    FROM lineitem GROUP BY l_returnflag
    """,
    "lineitem",
    """
    SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_linenumber) AS about, bool_and(l_quantity > 0) AS positive, bool_or(l_discount > 0.09) AS some_discount, bit_and(l_linenumber) AS b_and, bit_or(l_linenumber) AS b_or, bit_xor(l_linenumber) AS b_xor,
      median(l_quantity) AS mid, quantile_disc(l_linenumber, 0.5) AS line, CAST(round(var_samp(l_quantity) * 1000) AS BIGINT) AS v, CAST(round(var_pop(l_quantity) * 1000) AS BIGINT) AS vp, CAST(round(stddev_pop(l_quantity) * 1000) AS BIGINT) AS sp, CAST(round(covar_samp(l_quantity, l_discount) * 1000) AS BIGINT) AS cs,
      CAST(round(covar_pop(l_quantity, l_discount) * 1000) AS BIGINT) AS cp, CAST(round(regr_slope(l_extendedprice, l_quantity)) AS BIGINT) AS slope, CAST(round(regr_intercept(l_extendedprice, l_quantity)) AS BIGINT) AS cut, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS pairs, CAST(round(regr_r2(l_extendedprice, l_quantity) * 1000) AS BIGINT) AS r2,
      CAST(round(regr_avgx(l_extendedprice, l_quantity) * 1000) AS BIGINT) AS ax, CAST(round(regr_sxx(l_extendedprice, l_quantity)) AS BIGINT) AS sxx, count(*) FILTER (WHERE l_linestatus = 'O') AS open, list_sort(array_agg(DISTINCT l_linestatus)) AS statuses
    FROM lineitem GROUP BY l_returnflag
    """,
)
_session(
    "sql_json",
    """
    SELECT event_id, get_first_json_object(props, '$.k') AS k, get_first_json_object(concat('{"a": {"t": "', event_type, '"}}'), '$.a.t') AS quoted, extract_json_string(concat('{"a": ["', event_type, '", 2]}'), '$.a[0]') AS text, extract_json_string(props, '$.k') AS no_string,
      extract_json(concat('{"a": [{"n": ', user_id, '}, {"n": 2}]}'), '$.a[*].n') AS every, extract_json('{"a": [1, 5, 9]}', '$.a[1:]') AS tail, extract_json(props, '$.nosuch') AS none, extract_json('{broken', '$.a') AS broken, get_first_json_object(NULL, '$.a') AS nothing
    FROM events
    """,
    "events",
    """
    SELECT event_id, props->>'$.k' AS k, '"' || event_type || '"' AS quoted, event_type AS text, CAST(NULL AS VARCHAR) AS no_string, [CAST(user_id AS VARCHAR), '2'] AS every, ['5', '9'] AS tail, CAST([] AS VARCHAR[]) AS none, CAST(NULL AS VARCHAR[]) AS broken, CAST(NULL AS VARCHAR) AS nothing FROM events
    """,
)


@register("updating_stream", "SELECT event_type, count(*) * 2 AS twice, max(user_id) AS top, count(DISTINCT user_id) AS users, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE value > 10 GROUP BY event_type HAVING count(*) > 5")
def updating_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A continuous query run until its input ends; its changelog is replayed: what
    is retracted goes, and each row must be appended once more than it is retracted."""
    from rivulet.streaming.session import Session

    session = Session(spark, available_now=True)
    name = f"replayed_{uuid.uuid4().hex}"
    made = session.sql(
        f"""
        CREATE TABLE events ({_COLUMNS["events"]}) WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{sf_dir}/events.parque[t]');
        CREATE STREAMING TABLE {name} WITH ('connector' = 'memory') AS
        SELECT event_type, n * 2 AS twice, top, users, ids FROM (
          SELECT event_type, COUNT(*) AS n, MAX(user_id) AS top, COUNT(DISTINCT user_id) AS users, SUM(event_id) AS ids FROM events WHERE value > 10 GROUP BY event_type HAVING COUNT(*) > 5) x
        """
    )
    if not made.ok or not session.wait(name, 600):
        raise ValueError(made.message or "the query did not end")
    sign = F.when(F.col("_updating_meta.is_retract"), -1).otherwise(1)
    return session.rows(name).groupBy("event_type", "twice", "top", "users", "ids").agg(F.sum(sign).alias("left")).where("left = 1").drop("left")


class _Words:
    """A table function: the words of a name and their places."""

    def eval(self, name: str):
        for k, w in enumerate(name.split(" ")):
            yield k, w


@register("udf_surface", "SELECT p_brand, k, w, count(*) AS n, max(p_size) - min(p_size) AS span, sum(2 * p_size)::BIGINT AS twice FROM (SELECT *, unnest(generate_series(0, len(string_split(p_name, ' ')) - 1)) AS k, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY ALL")
def udf_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    udf.register_scalar(spark, "rv_twice", lambda x: 2 * x, "long")
    udf.register_aggregate(spark, "rv_span", lambda x: int(x.max() - x.min()), "int")
    udf.register_table(spark, "rv_words", _Words, "k bigint, w string")
    table(spark, sf_dir, "part").createOrReplaceTempView("rv_part")
    twice = spark.sql("SELECT p_brand, p_size, k, w, rv_twice(p_size) AS t FROM rv_part, LATERAL rv_words(p_name)")
    sums = twice.groupBy("p_brand", "k", "w").agg(F.count("*").alias("n"), F.sum("t").alias("twice"))
    twice.createOrReplaceTempView("rv_twice_part")
    spans = spark.sql("SELECT p_brand, k, w, rv_span(p_size) AS span FROM rv_twice_part GROUP BY p_brand, k, w")
    return sums.join(spans, ["p_brand", "k", "w"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
