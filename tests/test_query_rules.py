import pytest

from rivulet.errors import NotFound, ParseError, PlanError
from rivulet.plans.query import Compiler

T1 = "(SELECT TUMBLE(INTERVAL '1' MINUTE) AS w, k, COUNT(*) AS n FROM a GROUP BY 1, k)"
T2 = "(SELECT TUMBLE(INTERVAL '2' MINUTE) AS w, k, COUNT(*) AS m FROM a GROUP BY 1, k)"
S1 = "(SELECT SESSION(INTERVAL '1' MINUTE) AS w, k, COUNT(*) AS m FROM a GROUP BY 1, k)"


def compiled(spark, sql, streaming=True):
    return Compiler(spark, sql, lambda n: n in ("a", "b"), streaming=streaming).compile()


@pytest.mark.parametrize(
    ("sql", "said"),
    [
        ("SELECT k FROM a ORDER BY k", "ORDER BY"),
        ("SELECT k FROM a LIMIT 3", "LIMIT"),
        ("SELECT TUMBLE(INTERVAL '1' MINUTE), k FROM a", "missing a GROUP BY"),
        ("SELECT HOP(INTERVAL '3' MINUTE, INTERVAL '10' MINUTE) AS w, COUNT(*) FROM a GROUP BY 1", "multiple of the slide"),
        ("SELECT TUMBLE(INTERVAL '1' MONTH) AS w, COUNT(*) FROM a GROUP BY 1", "months"),
        ("SELECT TUMBLE(INTERVAL '1' MINUTE) AS w, SESSION(INTERVAL '1' MINUTE) AS v, COUNT(*) FROM a GROUP BY 1, 2", "only one window"),
        (f"SELECT TUMBLE(INTERVAL '5' MINUTE) AS v, SUM(n) FROM {T1} x GROUP BY 1", "differs from the window"),
        (f"SELECT SESSION(INTERVAL '5' MINUTE) AS v, SUM(n) FROM {T1} x GROUP BY 1", "cannot be nested"),
        (f"SELECT w, TUMBLE(INTERVAL '1' MINUTE) AS v, SUM(n) FROM {T1} x GROUP BY 1, 2", "redundant"),
        ("SELECT a.k FROM a LEFT JOIN b ON a.k = b.k", "require windowing"),
        ("SELECT a.k FROM a JOIN b ON a.k < b.k", "equality of keys"),
        ("SELECT a.k FROM a CROSS JOIN b", "equality of keys"),
        ("SELECT a.k FROM a JOIN b USING (k)", "USING"),
        ("SELECT a.k FROM a LEFT SEMI JOIN b ON a.k = b.k", "not supported"),
        ("SELECT k FROM a WHERE k IN (SELECT k FROM b)", "sub-queries"),
        ("SELECT k FROM a WHERE EXISTS (SELECT 1 FROM b)", "sub-queries"),
        (f"SELECT x.k FROM {T1} x JOIN b ON x.k = b.k", "un-windowed"),
        (f"SELECT x.k FROM {T1} x JOIN {T2} y ON x.w = y.w", "same window"),
        (f"SELECT x.k FROM {S1} x JOIN {S1} y ON x.w = y.w", "session"),
        (f"SELECT x.k FROM {T1} x JOIN {T1} y ON x.k = y.k", "equate the window"),
        ("SELECT k, ROW_NUMBER() OVER (PARTITION BY k ORDER BY k) FROM a", "windowed input"),
        (f"SELECT k, ROW_NUMBER() OVER (PARTITION BY w ORDER BY k) FROM {S1} x", "session"),
        (f"SELECT k, ROW_NUMBER() OVER (PARTITION BY k ORDER BY n) FROM {T1} x", "exactly one window column"),
        (f"SELECT ROW_NUMBER() OVER (PARTITION BY w ORDER BY n), RANK() OVER (PARTITION BY w ORDER BY n) FROM {T1} x", "only one window function"),
        ("SELECT k FROM a INTERSECT SELECT k FROM b", "INTERSECT"),
        ("SELECT k FROM a EXCEPT SELECT k FROM b", "EXCEPT"),
        ("SELECT unnest(x), unnest(y) FROM a", "one distinct unnest"),
        ("SELECT k FROM a WHERE unnest(x) = 1", "SELECT only"),
        ("SELECT k, COUNT(*) FROM a GROUP BY ROLLUP (k)", "batch"),
    ],
)
def test_rejected(spark, sql, said):
    with pytest.raises(PlanError, match=said):
        compiled(spark, sql)


def test_unknown_table_and_bad_text(spark):
    with pytest.raises(NotFound):
        compiled(spark, "SELECT 1 FROM nowhere")
    with pytest.raises(ParseError):
        compiled(spark, "SELEC 1")


@pytest.mark.parametrize(
    ("sql", "window"),
    [
        (f"SELECT * FROM {T1} x", ("tumble", 60_000_000)),
        ("SELECT HOP(INTERVAL '1' MINUTE, INTERVAL '1' MINUTE) AS w, COUNT(*) AS n FROM a GROUP BY w", ("tumble", 60_000_000)),
        ("SELECT HOP(INTERVAL '1' MINUTE, INTERVAL '10' MINUTE) AS w, COUNT(*) AS n FROM a GROUP BY 1", ("hop", 60_000_000, 600_000_000)),
        (f"SELECT w AS v, SUM(n) AS s FROM {T1} x GROUP BY w", ("tumble", 60_000_000)),
        (f"SELECT TUMBLE(INTERVAL '1' MINUTE) AS v, SUM(n) AS s FROM {T1} x GROUP BY 1", ("tumble", 60_000_000)),
        (f"SELECT x.w, y.n FROM {T1} x FULL JOIN {T1} y ON x.w = y.w AND x.k = y.k", ("tumble", 60_000_000)),
        (f"WITH t AS {T1} SELECT * FROM t UNION ALL SELECT * FROM t", ("tumble", 60_000_000)),
    ],
)
def test_windows_inferred(spark, sql, window):
    assert compiled(spark, sql).relation.window == window


def test_rewrites(spark):
    sql = compiled(spark, "SELECT HOP(INTERVAL '1' MINUTE, INTERVAL '10' MINUTE) AS w, COUNT(DISTINCT CAST(k AS STRING)) AS u, 'TUMBLE(x)' AS t FROM a GROUP BY 1, 3").sql
    assert sql == "SELECT window(_timestamp, '600000000 microseconds', '60000000 microseconds') AS w, size(collect_set(CAST(k AS STRING))) AS u, 'TUMBLE(x)' AS t FROM a GROUP BY 1, 3"
    assert compiled(spark, "SELECT row_time() AS t, unnest(x) AS y FROM a").sql == "SELECT _timestamp AS t, explode(x) AS y FROM a"


def test_updating(spark):
    assert compiled(spark, "SELECT k, COUNT(*) AS n FROM a GROUP BY k").relation.updating
    assert compiled(spark, "SELECT a.k FROM a JOIN b ON a.k = b.k").relation.updating
    assert compiled(spark, "SELECT k, COUNT(*) AS n FROM a GROUP BY k").aggregate == (["k"], [("n", "count", "1")])
    assert not compiled(spark, "SELECT k FROM a").relation.updating


def test_batch_allows(spark):
    for sql in ("SELECT k FROM a ORDER BY k LIMIT 3", "SELECT k FROM a WHERE k IN (SELECT k FROM b)", "SELECT a.k FROM a LEFT JOIN b ON a.k = b.k", "SELECT k FROM a EXCEPT SELECT k FROM b"):
        compiled(spark, sql, streaming=False)


def test_updating_queries_are_split(spark):
    """What the aggregate reads, and what is made of its changelog."""
    c = compiled(spark, "SELECT k, n * 2 AS m FROM (SELECT k, COUNT(*) AS n FROM a WHERE v > 1 GROUP BY k) x WHERE n > 3").changes
    assert c.input == "SELECT k AS _rv_k0, 1 AS _rv_a0 FROM a WHERE v > 1 "
    assert c.outer == "SELECT k, n * 2 AS m, _updating_meta, _rv_seq FROM (SELECT _rv_k0 AS `k`, _rv_a0 AS `n`, _updating_meta, _rv_seq FROM {changelog}) x WHERE n > 3"
    c = compiled(spark, "WITH e AS (SELECT k, log(v) AS v FROM a) SELECT k + 1 AS j, SUM(v) / COUNT(*) AS r FROM e GROUP BY k + 1 HAVING MAX(v) > 2 AND COUNT(*) > 1").changes
    assert c.input == "WITH e AS (SELECT k, log10(v) AS v FROM a) SELECT k + 1 AS _rv_k0, SUM".removesuffix("SUM") + "v AS _rv_a0, 1 AS _rv_a1, v AS _rv_a2 FROM e "
    assert c.aggs == [("_rv_a0", "sum", "_rv_a0"), ("_rv_a1", "count", "_rv_a1"), ("_rv_a2", "max", "_rv_a2")]
    assert c.outer.endswith("SELECT _rv_k0 AS `j`, _rv_a0 / _rv_a1 AS `r`, _updating_meta, _rv_seq FROM {changelog} WHERE _rv_a2 > 2 AND _rv_a1 > 1")
    c = compiled(spark, "SELECT COUNT(DISTINCT u) AS n, MIN(v) FILTER (WHERE w) AS low FROM a").changes
    assert (c.keys, [x[1] for x in c.aggs]) == ([], ["count_distinct", "min"]) and c.input.rstrip() == "SELECT u AS _rv_a0, CASE WHEN w THEN v END AS _rv_a1 FROM a"
    for sql in ("SELECT MAX(n) AS m FROM (SELECT k, COUNT(*) AS n FROM a GROUP BY k) x", "SELECT x.k FROM (SELECT k, COUNT(*) AS n FROM a GROUP BY k) x JOIN b ON x.k = b.k", "SELECT SUM(DISTINCT v) AS s FROM a"):
        with pytest.raises(PlanError):
            compiled(spark, sql)


def test_joins_without_windows_expire(spark):
    sql = "SELECT x.k FROM a x JOIN b ON x.k = b.k OR x.j = b.j AND x.k = b.k WHERE x.k > 1"
    with pytest.raises(PlanError, match="equality"):
        compiled(spark, "SELECT x.k FROM a x JOIN b ON x.k = b.k OR x.j = b.j")
    timed = Compiler(spark, "SELECT x.k FROM a x JOIN b ON x.k = b.k AND x.j < b.j", lambda n: n in ("a", "b"), timed=lambda n: True).compile().sql
    assert timed == "SELECT x.k FROM a x JOIN b ON (x.k = b.k AND x.j < b.j) AND `x`._timestamp >= `b`._timestamp - INTERVAL '24' HOUR AND `x`._timestamp <= `b`._timestamp + INTERVAL '24' HOUR"
    assert "INTERVAL" not in compiled(spark, sql.replace(" OR x.j = b.j", "")).sql


@pytest.mark.parametrize(
    ("sql", "said"),
    [
        ("SELECT concat(k, concat('x', NULL)) AS c FROM a", "SELECT concat_ws('', CAST(k AS STRING), CAST(concat_ws('', CAST('x' AS STRING), CAST(NULL AS STRING)) AS STRING)) AS c FROM a"),
        ("SELECT EXTRACT(dow FROM t) AS d FROM a", "SELECT (dayofweek(t) - 1) AS d FROM a"),
        ("SELECT approx_distinct(log(k)) FILTER (WHERE k > 1) AS n FROM a GROUP BY j", "SELECT approx_count_distinct(log10(k)) FILTER (WHERE k > 1) AS n FROM a GROUP BY j"),
        ("SELECT array_has_all(x, make_array(1, 2)) AS h FROM a", "SELECT (size(array_except(array(1, 2), x)) = 0) AS h FROM a"),
        ("SELECT to_char(t, '%Y-%m-%d at %H') AS s FROM a", "SELECT date_format(t, 'yyyy-MM-dd \\'at\\' HH') AS s FROM a"),
    ],
)
def test_functions_of_the_dialect(spark, sql, said):
    assert compiled(spark, sql, streaming=False).sql == said


def test_functions_refused(spark):
    for sql in ("SELECT regexp_replace(k, k, 'x') FROM a", "SELECT get_first_json_object(k, NULL) FROM a", "SELECT extract_json(k, 'no path') FROM a", "SELECT to_char(k, '%Q') FROM a", "SELECT digest(k, 'crc') FROM a", "SELECT encode(k, 'utf-7') FROM a"):
        with pytest.raises(PlanError):
            compiled(spark, sql, streaming=False)


def test_updating_aggregate_keeps_its_own_text(spark):
    """What is made of the changelog stands apart; a bounded run reads the query itself."""
    sql = "SELECT k, COUNT(*) + 1 AS n, MAX(j) AS top FROM a GROUP BY k HAVING COUNT(*) > 2"
    got = compiled(spark, sql)
    assert got.sql == sql and "{changelog}" in got.changes.outer
    spark.createDataFrame([(1, 5), (1, 7), (1, 6), (2, 9)], "k int, j int").createOrReplaceTempView("a")
    assert [tuple(r) for r in spark.sql(got.sql).collect()] == [(1, 4, 7)]
