import pytest

from rivulet.errors import ParseError, PlanError
from rivulet.plans import ddl
from rivulet.plans.catalog import table_of
from rivulet.plans.options import Options
from rivulet.plans.types import spark_type


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("CREATE TABLE trips (vehicle BIGINT, left_at TIMESTAMP NOT NULL, WATERMARK FOR left_at AS left_at - INTERVAL '3' SECOND) WITH ('connector' = 'memory')", ddl.CreateTable),
        ("Create Table If Not Exists stops (code STRING PRIMARY KEY)", ddl.CreateTable),
        ("CREATE STREAMING TABLE busy WITH ('connector' = 'blackhole') AS SELECT vehicle FROM trips", ddl.CreateStreamingTable),
        ("create streaming table if not exists busy with ('connector' = 'memory') as select 1 as one", ddl.CreateStreamingTable),
        ("SHOW CREATE STREAMING TABLE busy", ddl.Show),
        ("show create table trips", ddl.Show),
        ("SHOW STREAMING TABLES", ddl.Show),
        ("show tables", ddl.Show),
        ("Show Functions", ddl.Show),
        ("DROP STREAMING TABLE busy", ddl.Drop),
        ("DROP STREAMING TABLE IF EXISTS busy", ddl.Drop),
        ("drop table if exists trips", ddl.Drop),
        ("DROP TABLE stops", ddl.Drop),
        ("DROP FUNCTION smoother", ddl.Drop),
        ("CREATE FUNCTION WITH ('config_path' = '/tasks/smoother.yaml', 'function_path' = '/tasks/smoother.py')", ddl.CreateFunction),
        ("START FUNCTION smoother", ddl.FunctionState),
        ("Stop Function smoother", ddl.FunctionState),
    ],
)
def test_classifies(text, kind):
    assert isinstance(ddl.parse_one(text), kind)


def test_several_statements():
    found = ddl.parse("CREATE TABLE a (id INT); -- the ; in a comment\nCREATE STREAMING TABLE b WITH ('connector'='x;y') AS SELECT ';' FROM a;")
    assert [type(s) for s in found] == [ddl.CreateTable, ddl.CreateStreamingTable]
    assert found[1].options == {"connector": "x;y"}


@pytest.mark.parametrize("text", ["", "  ", ";", "-- nothing"])
def test_empty(text):
    with pytest.raises(ParseError):
        ddl.parse(text)


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("SELECT 1", "unsupported"),
        ("INSERT INTO a SELECT 1", "INSERT is not supported"),
        ("EXPLAIN SELECT 1", "unsupported"),
        ("CREATE TABLE a WITH ('connector'='kafka') AS SELECT 1", "CREATE STREAMING TABLE"),
        ("CREATE OR REPLACE TABLE a (id INT)", "OR"),
        ("CREATE TEMPORARY TABLE a (id INT)", "TEMPORARY"),
        ("CREATE EXTERNAL TABLE a (id INT)", "EXTERNAL"),
        ("DROP TABLE a, b", "one name"),
        ("CREATE TABLE a (id INT, PRIMARY KEY (id), PRIMARY KEY (id))", "one PRIMARY KEY"),
        ("CREATE TABLE a (t TIMESTAMP, WATERMARK FOR t, WATERMARK FOR t)", "one WATERMARK"),
        ("CREATE FUNCTION WITH ('config_path'='c')", "function_path"),
    ],
)
def test_rejects(text, said):
    with pytest.raises(PlanError, match=said):
        ddl.parse(text)


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("CREATE TABLE a (id INT)", "connector"),
        ("CREATE TABLE a (id INT) WITH ('connector'='nexus')", "Unknown adapter"),
        ("CREATE TABLE a (id INT) WITH ('connector'='kafka','topic'='t','bootstrap.servers'='b','format'='avro')", "not supported yet"),
        ("CREATE TABLE a (id INT) WITH ('connector'='kafka','topic'='t','bootstrap.servers'='b','json.compression'='gzip')", "filesystem"),
        ("CREATE TABLE a (x INT) WITH ('connector'='memory','format'='raw_string')", "value"),
        ("CREATE TABLE a (id INT, WATERMARK FOR t) WITH ('connector'='memory')", "not in the table"),
        ("CREATE TABLE a (id INT, WATERMARK FOR id) WITH ('connector'='memory')", "TIMESTAMP"),
        ("CREATE TABLE a (id INT) WITH ('connector'='memory','format'='debezium_json')", "PRIMARY KEY"),
        ("CREATE TABLE a (id INT PRIMARY KEY, b INT GENERATED ALWAYS AS (id + 1)) WITH ('connector'='memory','format'='debezium_json')", "computed"),
        ("CREATE TABLE a (id INT PRIMARY KEY) WITH ('connector'='memory','format'='debezium_json','event_time_field'='id')", "update mode"),
        ("CREATE TABLE a (id INT) WITH ('connector'='kafka','topic'='t')", "bootstrap.servers"),
        ("CREATE TABLE a (id INT, id INT) WITH ('connector'='memory')", "one name"),
        ("CREATE TABLE a (id INT) WITH ('connector'='memory','bad_data'='keep')", "bad_data"),
        ("CREATE TABLE a (id MAP<INT,INT>) WITH ('connector'='memory')", "Unsupported SQL type"),
    ],
)
def test_table_rules(text, said):
    with pytest.raises(PlanError, match=said):
        table_of(ddl.parse_one(text))


@pytest.mark.parametrize(
    ("text", "spark"),
    [
        ("INT", "int"), ("INT UNSIGNED", "bigint"), ("BIGINT UNSIGNED", "decimal(20,0)"), ("FLOAT", "float"), ("DOUBLE PRECISION", "double"), ("VARCHAR(20)", "string"),
        ("TIMESTAMP(3)", "timestamp"), ("NUMERIC(10, 2)", "decimal(10,2)"), ("BYTEA", "binary"), ("ARRAY<STRING>", "array<string>"), ("INT[]", "array<int>"),
        ("STRUCT<a INT, b ARRAY<STRING>>", "struct<a:int,b:array<string>>"), ("JSON", "string"), ("DATE", "date"),
    ],
)
def test_types(text, spark):
    assert spark_type(text).simpleString() == spark


@pytest.mark.parametrize("text", ["TIMESTAMP(2)", "DECIMAL(39, 1)", "DECIMAL(5, 6)", "ARRAY<ARRAY<INT>>", "ARRAY", "UUID", "STRUCT<INT>"])
def test_types_rejected(text):
    with pytest.raises(PlanError):
        spark_type(text)


def test_options():
    o = Options({"a": "yes", "b": "False", "n": "12", "d": "INTERVAL '5' SECOND", "e": "10 minutes", "bad": "x"})
    assert (o.boolean("a", None), o.boolean("b", None), o.integer("n", None), o.duration("d", None), o.duration("e", None)) == (True, False, 12, 5.0, 600.0)
    for read in (o.boolean, o.integer, o.duration):
        with pytest.raises(PlanError):
            read("bad", None)
