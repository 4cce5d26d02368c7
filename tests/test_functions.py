import pytest
from pyspark.sql import functions as F

from rivulet.errors import PlanError
from rivulet.functions import json as J
from rivulet.functions import scalar as S
from rivulet.plans.ddl import Column
from rivulet.sources.formats import decode_json, encode_json, in_range, unframe

DOCS = ['{"a":1,"b":2,"c":{"d":"hello"}}', '{"a":3}', '{"a":5,"b":6}', "{bad", None]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(d, k) for k, d in enumerate(DOCS)], "j string, k int")


def values(df, c):
    return [r[0] for r in df.orderBy("k").select(c).collect()]


def test_json_functions(docs):
    assert values(docs, J.extract_json("j", "$.c.d")) == [['"hello"'], [], [], None, None]
    assert values(docs, J.get_first_json_object("j", "$.b")) == ["2", None, "6", None, None]
    assert values(docs, J.get_first_json_object("j", "$.c.d")) == ['"hello"', None, None, None, None]
    assert values(docs, J.extract_json_string("j", "$.c.d")) == ["hello", None, None, None, None]
    assert values(docs, J.extract_json_string("j", "$.b")) == [None] * 5
    for bad in ("c.d", "$[", ""):
        with pytest.raises(PlanError):
            J.extract_json("j", bad)
    with pytest.raises(PlanError):
        J.get_first_json_object("j", None)


def test_json_paths():
    d = {"s": [{"p": 1, "t": "a"}, {"p": 5}], "x": {"p": 7}}
    assert J.matches(d, "$.s[*].p") == [1, 5]
    assert J.matches(d, "$..p") == [1, 5, 7]
    assert J.matches(d, "$.s[-1].p") == [5]
    assert J.matches(d, "$.s[0:1].p") == [1]
    assert J.matches(d, "$.s[?(@.p > 2)].p") == [5]
    assert J.matches(d, "$.s[?(@.t)].p") == [1]
    assert J.matches(d, "$['x']['p']") == [7]


def test_scalars(spark):
    df = spark.createDataFrame([("2024-01-07 10:07:30", "abab", [1, 2, 1], 12, -1.57, 0)], "t string, s string, xs array<int>, n int, d double, k int").withColumn("t", F.col("t").cast("timestamp"))
    one = lambda c: df.select(c).first()[0]
    assert one(S.date_part("dow", "t")) == 0
    assert str(one(S.date_bin("15 minutes", "t"))) == "2024-01-07 10:00:00"
    assert one(S.regexp_replace("s", "(a)b", "<\\1>")) == "<a>ab"
    assert one(S.regexp_replace("s", "A", "-", "gi")) == "-b-b"
    assert one(S.concat("s", F.lit(None).cast("string"), F.lit("!"))) == "abab!"
    assert (one(S.gcd("n", F.lit(18))), one(S.lcm("n", F.lit(18))), one(S.gcd(F.lit(0), F.lit(0)))) == (6, 36, 0)
    assert (one(S.trunc("d", 1)), one(S.trunc("d"))) == (-1.5, -1.0)
    assert one(S.array_positions("xs", F.lit(1))) == [1, 3]
    assert one(S.array_remove_n("xs", 1, 1)) == [2, 1] and one(S.array_replace_n("xs", 1, 9, 1)) == [9, 2, 1]
    assert one(S.array_resize("xs", 5, 0)) == [1, 2, 1, 0, 0] and one(S.array_resize("xs", 2)) == [1, 2]
    assert one(S.array_pop_back("xs")) == [1, 2] and one(S.array_pop_front("xs")) == [2, 1]
    assert one(S.map_extract(F.create_map(F.lit("a"), F.lit(1)), "b")) == [None]


def test_sql_functions(spark):
    S.register(spark)
    assert tuple(spark.sql("select strpos('abc', 'c'), to_hex(255), starts_with('abc', 'ab'), sha256('x') = sha2('x', 256)").first()) == (3, "ff", True, True)


def test_bad_data(spark):
    from pyspark.sql.types import IntegerType, StructType

    records = spark.createDataFrame([(b'{"a": 1, "z": 0}',), (b"{bad",), (None,)], "value binary")
    schema = StructType().add("a", IntegerType())
    assert [r.a for r in decode_json(records, schema, "drop").collect()] == [1]
    mixed = spark.createDataFrame([(x,) for x in (b'{"a": "x", "b": 1}', b'{"a": 2, "b": "y"}', b'{"a": 3, "b": null}', b'{"b": 4.5}', b"7", b"", b"{}", b'{"a": 99999999999}')], "value binary")
    both = StructType().add("a", IntegerType()).add("b", IntegerType())
    assert sorted(map(tuple, decode_json(mixed, both, "drop").collect()), key=str) == [(3, None), (None, None)]  # mistyped fields are bad, absent ones null
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        decode_json(records, schema, "fail").collect()
    assert [r.value for r in unframe(spark.createDataFrame([(b"a\nbcd\n",)], "value binary"), max_length=2).collect()] == ["a", "bc"]


def test_encode(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:01.5' as t, cast(-1.25 as decimal(10,2)) as d, cast('ab' as binary) as b, cast(null as int) as n, 1 as _timestamp")
    assert encode_json(df).first()[0] == '{"t":"2024-01-01T00:00:01.500000Z","d":-1.25,"b":"YWI=","n":null}'
    assert encode_json(df, "unix_millis", "string").first()[0] == '{"t":1704067201500,"d":"-1.25","b":"YWI=","n":null}'
    import base64
    import json

    raw = base64.b64decode(json.loads(encode_json(df, decimals="bytes").first()[0])["d"])
    assert int.from_bytes(raw, "big", signed=True) == -125 and len(raw) == 16


def test_unsigned_range(spark):
    df = spark.createDataFrame([(255,)], "x smallint")
    column = [Column("x", "TINYINT UNSIGNED")]
    assert in_range(df, column).first()[0] == 255
    with pytest.raises(Exception, match="out of the range"):
        in_range(spark.createDataFrame([(256,)], "x smallint"), column).collect()
