"""Scalar and aggregate functions whose meaning differs from Spark's of the
same name, as columns and as SQL functions (``register``).

All are built-in expressions, so they fuse with the plan around them.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_C = Column | str


def _c(x: _C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat(*xs: _C) -> Column:
    """Text of all parts; nulls are skipped."""
    return F.concat_ws("", *map(_c, xs))


def strpos(text: _C, part: _C) -> Column:
    """The place of a part, from 1; 0 if it is not there."""
    return F.call_function("instr", _c(text), _c(part))


def to_hex(x: _C) -> Column:
    return F.lower(F.hex(_c(x)))


def date_part(part: str, time: _C) -> Column:
    """A field of a time; days of the week count from Sunday, 0."""
    t = _c(time)
    if part.lower() in ("dow", "dayofweek"):
        return F.dayofweek(t) - 1
    if part.lower() == "epoch":
        return F.unix_micros(t.cast("timestamp")) / 1e6
    return F.date_part(F.lit(part), t)


def date_bin(stride: str, time: _C, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the time's bin of a fixed length, counted from an origin."""
    from rivulet.operators.windows import _micros

    n = _micros(stride)
    start = F.unix_micros(F.lit(origin).cast("timestamp"))
    at = F.unix_micros(_c(time).cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at - start, F.lit(n)))


def trunc(x: _C, digits: int = 0) -> Column:
    """A number cut off after so many digits, towards zero."""
    scale = F.lit(10.0**digits)
    y = _c(x) * scale
    return F.when(y >= 0, F.floor(y)).otherwise(F.ceil(y)) / scale


def regexp_replace(text: _C, pattern: str, by: str, flags: str = "") -> Column:
    """The first match replaced, or all with flag g; flag i folds case. Groups are \\1, \\2 ..."""
    import re

    by = re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$"))
    inline = "(?i)" if "i" in flags else ""
    if "g" in flags:
        return F.regexp_replace(_c(text), inline + pattern, by)
    groups = re.compile(pattern).groups
    by = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 1}", by)
    return F.regexp_replace(_c(text), rf"{inline}(?s)\A(.*?)(?:{pattern})(.*)\z", f"$1{by}${groups + 2}")


def nanvl(x: _C, y: _C) -> Column:
    return F.nanvl(_c(x).cast("double"), _c(y).cast("double"))


def gcd(x: _C, y: _C) -> Column:
    """Greatest common divisor, by Euclid's steps over as many rounds as 64 bits may take."""
    pair = F.aggregate(
        F.sequence(F.lit(1), F.lit(93)),
        F.struct(F.abs(_c(x)).cast("long").alias("a"), F.abs(_c(y)).cast("long").alias("b")),
        lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.try_mod(p["a"], p["b"]).alias("b"))),
    )
    return pair["a"]


def lcm(x: _C, y: _C) -> Column:
    g = gcd(x, y)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(_c(x).cast("long") / g * _c(y)).cast("long"))


def iszero(x: _C) -> Column:
    return _c(x) == 0


def array_positions(xs: _C, value: _C | int) -> Column:
    """All places of a value, from 1."""
    v = _c(value) if isinstance(value, (str, Column)) else F.lit(value)
    return F.filter(F.transform(_c(xs), lambda x, i: F.when(x == v, i + 1)), lambda i: i.isNotNull())


def array_remove_n(xs: _C, value: int | str, n: int) -> Column:
    """Without the first n occurrences of a value."""
    x = _c(xs)
    gone = F.slice(array_positions(x, F.lit(value)), 1, n)
    return F.transform(F.filter(F.transform(x, lambda e, i: F.struct(e.alias("e"), (i + 1).alias("i"))), lambda s: ~F.array_contains(gone, s["i"])), lambda s: s["e"])


def array_replace_n(xs: _C, old: int | str, new: int | str, n: int) -> Column:
    """With the first n occurrences of a value replaced."""
    x = _c(xs)
    which = F.slice(array_positions(x, F.lit(old)), 1, n)
    return F.transform(x, lambda e, i: F.when(F.array_contains(which, i + 1), F.lit(new)).otherwise(e))


def array_resize(xs: _C, n: int, fill: int | str | None = None) -> Column:
    """Cut or filled up to n elements."""
    x = _c(xs)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i < F.size(x), F.get(x, i)).otherwise(F.lit(fill))) if n else F.slice(x, 1, 0)


def array_pop_back(xs: _C) -> Column:
    x = _c(xs)
    return F.slice(x, F.lit(1), F.greatest(F.lit(0), F.size(x) - 1))


def array_pop_front(xs: _C) -> Column:
    x = _c(xs)
    return F.slice(x, F.lit(2), F.greatest(F.lit(0), F.size(x) - 1))


def array_to_string(xs: _C, by: str, null: str | None = None) -> Column:
    return F.array_join(_c(xs).cast("array<string>"), by, null) if null is not None else F.array_join(_c(xs).cast("array<string>"), by)


def generate_series(start: _C | int, stop: _C | int, step: int = 1) -> Column:
    """Both ends included."""
    lit = lambda v: v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)
    return F.sequence(lit(start), lit(stop), F.lit(step))


def map_extract(m: _C, key: int | str) -> Column:
    """A list of the key's value, or of null."""
    return F.array(F.try_element_at(_c(m), F.lit(key)))


def starts_with(text: _C, part: _C) -> Column:
    return F.startswith(_c(text), _c(part))


#: SQL names that Spark lacks, as SQL expressions of their arguments.
SQL_FUNCTIONS = {
    "strpos": "strpos(s STRING, p STRING) RETURNS INT RETURN instr(s, p)",
    "to_hex": "to_hex(x BIGINT) RETURNS STRING RETURN lower(hex(x))",
    "starts_with": "starts_with(s STRING, p STRING) RETURNS BOOLEAN RETURN startswith(s, p)",
    "ends_with": "ends_with(s STRING, p STRING) RETURNS BOOLEAN RETURN endswith(s, p)",
    "iszero": "iszero(x DOUBLE) RETURNS BOOLEAN RETURN x = 0",
    "to_timestamp_seconds": "to_timestamp_seconds(x BIGINT) RETURNS TIMESTAMP RETURN timestamp_seconds(x)",
    "to_timestamp_millis": "to_timestamp_millis(x BIGINT) RETURNS TIMESTAMP RETURN timestamp_millis(x)",
    "to_timestamp_micros": "to_timestamp_micros(x BIGINT) RETURNS TIMESTAMP RETURN timestamp_micros(x)",
    "sha224": "sha224(x STRING) RETURNS STRING RETURN sha2(x, 224)",
    "sha256": "sha256(x STRING) RETURNS STRING RETURN sha2(x, 256)",
    "sha384": "sha384(x STRING) RETURNS STRING RETURN sha2(x, 384)",
    "sha512": "sha512(x STRING) RETURNS STRING RETURN sha2(x, 512)",
}


def register(spark: SparkSession) -> None:
    """Make the SQL names known to the session, as temporary SQL functions."""
    for text in SQL_FUNCTIONS.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
