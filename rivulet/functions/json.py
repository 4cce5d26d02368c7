"""JSON functions by JSONPath.

``get_first_json_object`` and ``extract_json`` give matches as JSON text (a
string keeps its quotes), ``extract_json_string`` only strings, without quotes.
Text that is no JSON gives null. A path is a literal; plain member paths stay
in the JVM, others (wildcards, slices, filters by existence or comparison,
recursive descent) are evaluated in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.errors import PlanError

_PLAIN = re.compile(r"\$(?:\.[A-Za-z_]\w*)*$")
_STEP = re.compile(
    r"""\.\.(?P<deep>\*|[\w-]+)|\.(?P<member>\*|[\w-]+)
    |\[(?:(?P<index>-?\d+)|(?P<star>\*)|'(?P<single>[^']*)'|"(?P<double>[^"]*)"|(?P<slice>-?\d*:-?\d*(?::-?\d+)?)
    |\?\(?\s*@\.(?P<field>[\w.]+)\s*(?:(?P<op>==|!=|<=|>=|<|>)\s*(?P<value>'[^']*'|"[^"]*"|[\w.+-]+))?\s*\)?)\]""",
    re.X,
)


@lru_cache(256)
def steps(path: str) -> tuple[tuple[str, object], ...]:
    """A path's steps; an error if it is no JSONPath."""
    if not path or not path.startswith("$"):
        raise PlanError(f"not a JSONPath: {path!r}")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise PlanError(f"not a JSONPath: {path!r}")
        g = m.groupdict()
        if g["deep"]:
            out.append(("deep", g["deep"]))
        elif g["member"] == "*" or g["star"]:
            out.append(("all", None))
        elif g["index"]:
            out.append(("index", int(g["index"])))
        elif g["slice"]:
            out.append(("slice", slice(*(int(x) if x else None for x in g["slice"].split(":")))))
        elif g["field"]:
            value = g["value"]
            out.append(("filter", (g["field"].split("."), g["op"], value[1:-1] if value and value[0] in "'\"" else json.loads(value) if value else None)))
        else:
            out.append(("member", g["member"] or g["single"] or g["double"]))
        at = m.end()
    return tuple(out)


def _children(x: object) -> list:
    return list(x.values()) if isinstance(x, dict) else list(x) if isinstance(x, list) else []


def _under(x: object) -> Iterator[object]:
    yield x
    for c in _children(x):
        yield from _under(c)


def _passes(x: object, test: tuple) -> bool:
    names, op, value = test
    for n in names:
        if not isinstance(x, dict) or n not in x:
            return False
        x = x[n]
    if op is None:
        return True
    try:
        return {"==": x == value, "!=": x != value}[op] if op in ("==", "!=") else {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}[op]
    except TypeError:
        return False


def matches(document: object, path: str) -> list:
    found = [document]
    for what, arg in steps(path):
        if what == "member":
            found = [x[arg] for x in found if isinstance(x, dict) and arg in x]
        elif what == "index":
            found = [x[arg] for x in found if isinstance(x, list) and -len(x) <= arg < len(x)]
        elif what == "slice":
            found = [y for x in found if isinstance(x, list) for y in x[arg]]
        elif what == "all":
            found = [y for x in found for y in _children(x)]
        elif what == "deep":
            found = [y for x in found for z in _under(x) for y in (_children(z) if arg == "*" else [z[arg]] if isinstance(z, dict) and arg in z else [])]
        else:
            found = [y for x in found for y in _children(x) if _passes(y, arg)]
    return found


def _text(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _parsed(text: str | None) -> tuple[bool, object]:
    if text is None:
        return False, None
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def is_plain(path: str) -> bool:
    """Whether the path has plain members only, which the JVM can follow."""
    return _PLAIN.match(path) is not None


def all_matches(text: str | None, path: str) -> list[str] | None:
    """All matches as JSON text; None if the text is no JSON."""
    ok, doc = _parsed(text)
    return [_text(x) for x in matches(doc, path)] if ok else None


def _all(path: str):
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([all_matches(t, path) for t in texts], dtype=object)

    return found


def extract_json(col: Column | str, path: str) -> Column:
    """All matches as JSON text; an empty list if there is none, null for bad JSON."""
    steps(path)
    return _all(path)(F.col(col) if isinstance(col, str) else col)


def _variant(col: Column | str) -> Column:
    return F.try_parse_json(F.col(col) if isinstance(col, str) else col)


def get_first_json_object(col: Column | str, path: str | None) -> Column:
    """The first match as JSON text; null without a match."""
    if path is None:
        raise PlanError("a JSONPath is a literal string")
    steps(path)
    if is_plain(path):
        return F.to_json(F.try_variant_get(_variant(col), path, "variant"))
    return F.get(extract_json(col, path), 0)


def extract_json_string(col: Column | str, path: str) -> Column:
    """The first match if it is a string, without its quotes; else null."""
    first = get_first_json_object(col, path)
    return F.when(first.startswith('"'), F.try_variant_get(F.try_parse_json(first), "$", "string"))


def serialize_json_union(col: Column | str) -> Column:
    """A tagged JSON value (a variant, or a struct with one field set) as its text."""
    return F.to_json(F.col(col) if isinstance(col, str) else col)
