"""Calls of the dialect's functions, as Spark SQL text of the same meaning.

Spark has many of the names with another meaning, or another name for the
meaning. ``rewrite`` gives the text of one call, in which ``{0}``, ``{1}`` ...
stand for its arguments; the compiler fills in the arguments' own text, calls in
them rewritten too. All of it is built-in expressions, but for JSONPaths beyond
plain members, which are an Arrow function that ``register`` names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rivulet.errors import PlanError
from rivulet.functions import json as jsonpath

#: Names that only the name tells apart; DISTINCT, FILTER and the arguments stay.
RENAMED = {
    "approx_distinct": "approx_count_distinct",
    "approx_percentile_cont": "percentile_approx",
    "var": "var_samp",
    "var_sample": "var_samp",
    "var_population": "var_pop",
    "stddev_samp": "stddev_samp",
    "bool_and": "every",
    "bool_or": "some",
    "pow": "power",
    "make_array": "array",
    "make_list": "array",
    "list_append": "array_append",
    "list_prepend": "array_prepend",
    "list_distinct": "array_distinct",
    "list_sort": "array_sort",
    "array_has": "array_contains",
    "list_has": "array_contains",
    "list_contains": "array_contains",
    "array_has_any": "arrays_overlap",
    "list_has_any": "arrays_overlap",
    "array_concat": "concat",
    "array_cat": "concat",
    "list_concat": "concat",
    "list_cat": "concat",
    "array_reverse": "reverse",
    "list_reverse": "reverse",
    "array_element": "try_element_at",
    "array_extract": "try_element_at",
    "list_element": "try_element_at",
    "list_extract": "try_element_at",
    "element_at": "try_element_at",
    "list_max": "array_max",
    "list_union": "array_union",
    "list_intersect": "array_intersect",
    "list_except": "array_except",
    "array_push_back": "array_append",
    "list_push_back": "array_append",
    "character_length": "char_length",
    "length": "char_length",
    "to_timestamp_seconds": "timestamp_seconds",
    "to_timestamp_millis": "timestamp_millis",
    "to_timestamp_micros": "timestamp_micros",
    "today": "current_date",
    "datetrunc": "date_trunc",
    "from_unixtime": "timestamp_seconds",
    "ends_with": "endswith",
    "starts_with": "startswith",
    "strpos": "instr",
    "random": "rand",
}

_WITHOUT = "transform(filter(transform({0}, (x, i) -> named_struct('x', x, 'i', i)), s -> NOT array_contains({1}, s.i)), s -> s.x)"
_PLACES = "filter(transform({0}, (x, i) -> IF(x <=> {1}, i, NULL)), i -> i IS NOT NULL)"


def _removed(n: str) -> str:
    """Without the first n elements that are {1}."""
    places = f"slice({_PLACES}, 1, {n})"
    return "transform(filter(transform({0}, (x, i) -> named_struct('x', x, 'i', i)), s -> NOT array_contains(" + places + ", s.i)), s -> s.x)"


def _replaced(n: str | None) -> str:
    """With the first n elements that are {1} (all without n) replaced by {2}."""
    if n is None:
        return "transform({0}, x -> IF(x <=> {1}, {2}, x))"
    return "transform({0}, (x, i) -> IF(array_contains(slice(" + _PLACES.replace("x, i", "y, j").replace("IF(x", "IF(y").replace(", i, NULL", ", j, NULL").replace("i -> i", "j -> j") + f", 1, {n})" + ", i), {2}, x))"


_GCD = "aggregate(sequence(1, 93), named_struct('a', abs(CAST({0} AS BIGINT)), 'b', abs(CAST({1} AS BIGINT))), (p, k) -> IF(p.b = 0, p, named_struct('a', p.b, 'b', p.a % nullif(p.b, 0))), p -> p.a)"
_CUT = "(CASE WHEN {0} >= 0 THEN floor({0} * power(10D, {1})) ELSE ceil({0} * power(10D, {1})) END / power(10D, {1}))"
_UNIX = "unix_micros(CAST({0} AS TIMESTAMP))"
_FLAG = "IF(contains({0}, 'i'), '(?i)', '')"

#: Calls by name and number of arguments.
TEMPLATES: dict[str, dict[int, str]] = {
    "log": {1: "log10({0})"},
    "trunc": {1: _CUT.replace("{1}", "0"), 2: _CUT},
    "gcd": {2: _GCD},
    "lcm": {2: "IF({0} = 0 OR {1} = 0, 0L, CAST(abs(CAST({0} AS BIGINT) div nullif(" + _GCD + ", 0) * {1}) AS BIGINT))"},
    "iszero": {1: "({0} = 0)"},
    "nanvl": {2: "nanvl(CAST({0} AS DOUBLE), CAST({1} AS DOUBLE))"},
    "to_hex": {1: "lower(hex({0}))"},
    "chr": {1: "decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32')"},
    "regexp_like": {2: "regexp_like({0}, {1})", 3: "regexp_like({0}, concat(" + _FLAG.replace("{0}", "{2}") + ", {1}))"},
    "regexp_count": {2: "regexp_count({0}, {1})", 3: "regexp_count(substr({0}, {2}), {1})", 4: "regexp_count(substr({0}, {2}), concat(" + _FLAG.replace("{0}", "{3}") + ", {1}))"},
    "regexp_instr": {2: "regexp_instr({0}, {1})", 3: "(CASE WHEN regexp_instr(substr({0}, {2}), {1}) = 0 THEN 0 ELSE regexp_instr(substr({0}, {2}), {1}) + {2} - 1 END)"},
    "to_unixtime": {1: "unix_seconds(CAST({0} AS TIMESTAMP))"},
    "to_local_time": {1: "CAST({0} AS TIMESTAMP_NTZ)"},
    "to_timestamp_nanos": {1: "timestamp_micros({0} div 1000)"},
    "sha224": {1: "sha2({0}, 224)"},
    "sha256": {1: "sha2({0}, 256)"},
    "sha384": {1: "sha2({0}, 384)"},
    "sha512": {1: "sha2({0}, 512)"},
    "array_length": {1: "nullif(size({0}), -1)"},
    "list_length": {1: "nullif(size({0}), -1)"},
    "cardinality": {1: "nullif(size({0}), -1)"},
    "empty": {1: "(size({0}) = 0)"},
    "array_has_all": {2: "(size(array_except({1}, {0})) = 0)"},
    "list_has_all": {2: "(size(array_except({1}, {0})) = 0)"},
    "array_position": {2: "nullif(array_position({0}, {1}), 0)", 3: "nullif(array_position(slice({0}, {2}, greatest(size({0}) - {2} + 1, 0)), {1}) + {2} - 1, {2} - 1)"},
    "array_positions": {2: "transform(" + _PLACES + ", i -> CAST(i + 1 AS BIGINT))"},
    "array_remove": {2: _removed("1")},
    "array_remove_n": {3: _removed("{2}")},
    "array_remove_all": {2: "filter({0}, x -> NOT (x <=> {1}))"},
    "array_replace": {3: _replaced("1")},
    "array_replace_n": {4: _replaced("{3}")},
    "array_replace_all": {3: _replaced(None)},
    "array_resize": {2: "transform(slice(sequence(0, {1}), 1, {1}), i -> get({0}, i))", 3: "transform(slice(sequence(0, {1}), 1, {1}), i -> IF(i < size({0}), get({0}, i), {2}))"},
    "array_slice": {3: "slice({0}, {1}, greatest({2} - {1} + 1, 0))", 4: "filter(slice({0}, {1}, greatest({2} - {1} + 1, 0)), (x, i) -> i % {3} = 0)"},
    "array_pop_back": {1: "slice({0}, 1, greatest(size({0}) - 1, 0))"},
    "array_pop_front": {1: "slice({0}, 2, greatest(size({0}) - 1, 0))"},
    "array_to_string": {2: "array_join(CAST({0} AS ARRAY<STRING>), {1})", 3: "array_join(CAST({0} AS ARRAY<STRING>), {1}, {2})"},
    "list_to_string": {2: "array_join(CAST({0} AS ARRAY<STRING>), {1})", 3: "array_join(CAST({0} AS ARRAY<STRING>), {1}, {2})"},
    "array_join": {2: "array_join(CAST({0} AS ARRAY<STRING>), {1})", 3: "array_join(CAST({0} AS ARRAY<STRING>), {1}, {2})"},
    "string_to_array": {2: r"split({0}, concat('\\Q', {1}, '\\E'))", 3: r"transform(split({0}, concat('\\Q', {1}, '\\E')), x -> nullif(x, {2}))"},
    "string_to_list": {2: r"split({0}, concat('\\Q', {1}, '\\E'))"},
    "generate_series": {1: "sequence(0L, {0})", 2: "IF({0} <= {1}, sequence({0}, {1}), slice(array({0}), 1, 0))", 3: "sequence({0}, {1}, {2})"},
    "range": {1: "IF({0} > 0, sequence(0L, {0} - 1), slice(array({0}), 1, 0))", 2: "IF({0} < {1}, sequence({0}, {1} - 1), slice(array({0}), 1, 0))", 3: "IF({0} < {1}, sequence({0}, {1} - 1, {2}), slice(array({0}), 1, 0))"},
    "map_extract": {2: "array(try_element_at({0}, {1}))"},
    "window": {2: "named_struct('start', {0}, 'end', {1})"},
    "approx_median": {1: "percentile_approx({0}, 0.5D)"},
    "approx_percentile_cont_with_weight": {3: "percentile({0}, {2}, {1})"},
    "date_trunc": {2: "date_trunc({0}, {1})"},
}
for _alias in ("position", "positions", "remove", "remove_n", "remove_all", "replace", "replace_n", "replace_all", "resize", "slice", "pop_back", "pop_front"):
    TEMPLATES[f"list_{_alias}"] = TEMPLATES[f"array_{_alias}"]

#: Directives of a strftime format, as letters of Spark's patterns.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "z": "xx", "Z": "zzz", "%": "'%'",
}


def quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strftime(pattern: str) -> str:
    """A strftime format as a pattern of Spark's date_format."""
    out = []
    for directive, letters, other in re.findall(r"%(.?)|([A-Za-z]+)|([^%A-Za-z])", pattern):
        if letters or other:
            out.append(f"'{letters}'" if letters else "''" if other == "'" else other)
        elif directive in STRFTIME:
            out.append(STRFTIME[directive])
        else:
            raise PlanError(f"to_char: %{directive} is not supported")
    return "".join(out)


def _literal(value: object, what: str) -> str:
    if not isinstance(value, str):
        raise PlanError(f"{what} must be a literal string")
    return value


def _regexp_replace(args: list) -> str:
    """The first match, or all with flag g; groups are written \\1, \\2 ..."""
    pattern, by = _literal(args[1], "regexp_replace: the pattern"), _literal(args[2], "regexp_replace: the replacement")
    flags = _literal(args[3], "regexp_replace: the flags") if len(args) > 3 else ""
    shift, out = 0 if "g" in flags else 1, ""
    for group, ch in re.findall(r"\\(\d)|([\s\S])", by):
        out += f"${int(group) + shift}" if group else f"\\{ch}" if ch in "\\$0123456789" else ch
    inline = "(?i)" if "i" in flags else ""
    if shift:  # what stands before and after the first match is a group too
        groups = len(re.findall(r"(?<!\\)\((?:(?!\?)|\?P?<(?![=!]))", pattern))
        pattern = r"\A([\s\S]*?)(?:" + re.sub(r"\\(\d)", lambda m: f"\\{int(m[1]) + 1}", pattern) + r")([\s\S]*)\z"
        out = f"$1{out}${groups + 2}"
    return f"regexp_replace({{0}}, {quoted(inline + pattern)}, {quoted(out)})"


def _regexp_match(args: list) -> str:
    """The groups of the first match (the whole match without groups); null without one."""
    pattern = _literal(args[1], "regexp_match: the pattern")
    if len(args) > 2 and "i" in _literal(args[2], "regexp_match: the flags"):
        pattern = "(?i)" + pattern
    groups = len(re.findall(r"(?<!\\)\((?!\?)", pattern))
    found = [f"regexp_extract({{0}}, {quoted(pattern)}, {k})" for k in (range(1, groups + 1) if groups else [0])]
    return f"IF(regexp_like({{0}}, {quoted(pattern)}), array({', '.join(found)}), NULL)"


def _date_part(args: list) -> str:
    part = _literal(args[0], "date_part: the part").lower()
    t = "CAST({1} AS TIMESTAMP)"
    whole = {"dow": "(dayofweek({1}) - 1)", "dayofweek": "(dayofweek({1}) - 1)", "doy": "dayofyear({1})", "epoch": f"({_UNIX.replace('{0}', '{1}')} / 1000000D)", "second": f"second({t})", "isodow": "(weekday({1}))"}
    micros = f"pmod({_UNIX.replace('{0}', '{1}')}, 60000000)"
    within = {"millisecond": f"CAST({micros} div 1000 AS INT)", "microsecond": f"CAST({micros} AS INT)", "nanosecond": f"({micros} * 1000)"}
    part = part if part in whole else part.rstrip("s")
    if part in whole:
        return whole[part]
    return within.get(part) or f"date_part({quoted(part)}, {{1}})"


def _date_bin(args: list) -> str:
    if not isinstance(args[0], int):
        raise PlanError("date_bin takes a literal interval of days or less")
    start = "unix_micros(CAST({2} AS TIMESTAMP))" if len(args) > 2 else "0"
    at = "unix_micros(CAST({1} AS TIMESTAMP))"
    return f"timestamp_micros({at} - pmod({at} - {start}, {args[0]}))"


def _coded(args: list, way: dict[str, str], name: str) -> str:
    kind = _literal(args[1], f"{name}: the encoding").lower()
    if kind not in way:
        raise PlanError(f"{name}: {kind} is not base64 or hex")
    return way[kind]


def _digest(args: list) -> str:
    kind = _literal(args[1], "digest: the method").lower()
    if kind == "md5":
        return "unhex(md5({0}))"
    if kind not in ("sha224", "sha256", "sha384", "sha512"):
        raise PlanError(f"digest: {kind} is not supported")
    return f"unhex(sha2({{0}}, {kind[3:]}))"


def _path(args: list) -> str:
    path = _literal(args[1] if len(args) > 1 else None, "a JSONPath")
    jsonpath.steps(path)
    return path


def _first_json(args: list) -> str:
    path = _path(args)
    if jsonpath.is_plain(path):
        return f"to_json(try_variant_get(try_parse_json({{0}}), {quoted(path)}, 'variant'))"
    return f"get(rv_extract_json({{0}}, {quoted(path)}), 0)"


def _json_string(args: list) -> str:
    first = _first_json(args)
    return f"IF(startswith({first}, '\"'), try_variant_get(try_parse_json({first}), '$', 'string'), NULL)"


#: Calls whose text depends on literal arguments: strings, or microseconds of intervals; None for others.
MADE: dict[str, Callable[[list], str]] = {
    "concat": lambda a: "concat_ws(''" + "".join(f", CAST({{{k}}} AS STRING)" for k in range(len(a))) + ")",
    "regexp_replace": _regexp_replace,
    "regexp_match": _regexp_match,
    "date_part": _date_part,
    "datepart": _date_part,
    "extract": _date_part,
    "date_bin": _date_bin,
    "to_char": lambda a: f"date_format({{0}}, {quoted(strftime(_literal(a[1], 'to_char: the format')))})",
    "encode": lambda a: _coded(a, {"base64": "rtrim('=', base64(CAST({0} AS BINARY)))", "hex": "lower(hex(CAST({0} AS BINARY)))"}, "encode"),
    "decode": lambda a: _coded(a, {"base64": "unbase64({0})", "hex": "unhex({0})"}, "decode"),
    "digest": _digest,
    "get_field": lambda a: "({0})." + "`" + _literal(a[1], "get_field: the name").replace("`", "``") + "`",
    "get_first_json_object": _first_json,
    "extract_json": lambda a: f"rv_extract_json({{0}}, {quoted(_path(a))})",
    "extract_json_string": _json_string,
    "multi_hash": lambda a: "unhex(md5(CAST(to_json(named_struct(" + ", ".join(f"'c{k}', {{{k}}}" for k in range(len(a))) + "), map('ignoreNullFields', 'false')) AS BINARY)))",
}


def rewrite(name: str, args: list) -> str | None:
    """The text of a call, or None if Spark's own meaning serves. ``args`` holds
    the values of literal strings and intervals, None for other arguments."""
    if name in MADE:
        return MADE[name](args)
    return TEMPLATES.get(name, {}).get(len(args))


def register(spark: SparkSession) -> None:
    """Name the one function that is no built-in expression."""

    def extract(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([jsonpath.all_matches(t, p) for t, p in zip(texts, paths, strict=True)], dtype=object)

    spark.udf.register("rv_extract_json", F.pandas_udf(extract, "array<string>"))
