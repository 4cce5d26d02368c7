"""Compiling a SELECT of the dialect to Spark SQL, after checking its rules.

Spark's own parser gives the tree. It is walked from the sources up to learn
what each relation is: which window its rows carry, under which column names,
and whether it is a changelog. The rules of streaming queries are checked on the
way, and calls that Spark lacks or means otherwise are replaced in the text at
the places that the tree names: TUMBLE, HOP and SESSION, row_time(), unnest()
and the functions of ``functions.dialect``.

An aggregate without a window is taken out of a streaming query: what it reads
becomes one query, and what is made of its results another, over its changelog.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from rivulet.errors import NotFound, ParseError, PlanError
from rivulet.functions import dialect
from rivulet.plans import ddl

WINDOWS = {"tumble": 1, "hop": 2, "session": 1}
TIME = "_timestamp"
#: What rows of a changelog carry beside their own columns.
CARRIED = ("_updating_meta", "_rv_seq")
RETRACTABLE = ("count", "sum", "avg", "min", "max")
#: Hours that rows of a join without windows wait for each other.
JOIN_HOURS = 24


@dataclass
class Relation:
    """What is known of a relation's rows."""

    window: tuple | None = None  # (kind, microseconds ...)
    names: set[str] = field(default_factory=set)  # columns that carry the window
    updating: bool = False


@dataclass
class Changes:
    """An updating aggregate: the query of its input with columns for keys and
    arguments, (output, function, argument) of its aggregates, and what is made
    of its changelog, which stands as ``{changelog}`` in the text."""

    input: str
    keys: list[str]
    aggs: list[tuple[str, str, str]]
    outer: str
    stated: tuple[list[str], list[tuple[str, str, str]]]


@dataclass
class Compiled:
    sql: str
    relation: Relation
    over: bool
    sources: set[str]
    changes: Changes | None = None

    @property
    def aggregate(self) -> tuple[list[str], list[tuple[str, str, str]]] | None:
        """Keys and plain aggregates of an updating query, as it states them."""
        return self.changes.stated if self.changes else None


@dataclass
class _Block:
    """The text of an aggregate's query and what is in it."""

    start: int
    stop: int
    source: tuple[int, int]  # from FROM to the end of WHERE
    ctes: list[tuple[str, tuple[int, int]]]
    grouping: list
    out: list
    having: object
    updating: bool


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _items(seq) -> Iterator:
    for k in range(seq.size()):
        yield seq.apply(k)


def _expressions(e) -> Iterator:
    yield e
    for c in _items(e.children()):
        yield from _expressions(c)


def _name(e) -> str:
    return e.nameParts().mkString(".").lower() if _kind(e) == "UnresolvedFunction" else ""


def _column(e) -> str | None:
    """The bare, lower-case name of a column reference, under its alias' own."""
    return e.nameParts().last().lower() if _kind(e) == "UnresolvedAttribute" else None


class Compiler:
    def __init__(self, spark: SparkSession, sql: str, known: Callable[[str], bool], updating: Callable[[str], bool] = lambda _: False, streaming: bool = True, timed: Callable[[str], bool] = lambda _: False, reference: Callable[[str], bool] = lambda _: False) -> None:
        self.sql, self.known, self.is_updating, self.streaming, self.timed, self.reference = sql, known, updating, streaming, timed, reference
        try:
            self.plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception as e:
            raise ParseError(str(e).split("\n")[0]) from None
        #: What replaces a span of the text: strings, and spans whose own text goes there.
        self.edits: dict[tuple[int, int], list] = {}
        self.over, self.sources = False, set()
        self.ctes: dict[str, Relation] = {}
        self.cte_texts: list[tuple[str, tuple[int, int]]] = []
        self.having, self.block, self.counting = None, None, False

    def compile(self) -> Compiled:
        relation = self.walk(self.plan)
        sql = self._render((0, len(self.sql) - 1))  # before the aggregate's own edits, which are of its changelog
        return Compiled(sql, relation, self.over, self.sources, self._changes() if self.block else None)

    # --- places in the text

    def _span(self, e) -> tuple[int, int]:
        return e.origin().startIndex().get(), e.origin().stopIndex().get()

    def _replace(self, e, *parts: str | tuple[int, int]) -> None:
        self.edits[self._span(e)] = list(parts)

    def _render(self, span: tuple[int, int], within: tuple[int, int] | None = None) -> str:
        """The text of a span, edited; ``within`` is the edit being filled in."""
        out, at = [], span[0]
        for (start, stop), parts in sorted(self.edits.items(), key=lambda x: (x[0][0], -x[0][1])):
            if start < at or stop > span[1] or (start, stop) == within == span:
                continue
            out.append(self.sql[at:start])
            out += [p if isinstance(p, str) else self._render(p, (start, stop)) for p in parts]
            at = stop + 1
        return "".join([*out, self.sql[at : span[1] + 1]])

    def _text(self, e) -> str:
        return self._render(self._span(e))

    # --- windows

    def _window(self, e) -> tuple:
        """The window that a call states."""
        name, args = _name(e), list(_items(e.arguments()))
        if len(args) != WINDOWS[name]:
            raise PlanError(f"{name} takes {WINDOWS[name]} interval(s)")
        sizes = []
        for a in args:
            if _kind(a) != "Literal" or "interval" not in a.dataType().typeName():
                raise PlanError(f"{name} takes literal intervals")
            if "DayTime" not in a.dataType().getClass().getSimpleName():
                raise PlanError(f"{name}: months have no fixed length")
            sizes.append(int(a.value()))
        if min(sizes) <= 0:
            raise PlanError(f"{name} needs positive intervals")
        if name == "hop":
            slide, width = sizes
            if width % slide:
                raise PlanError("hop: the width must be a multiple of the slide")
            return ("tumble", width) if slide == width else ("hop", slide, width)
        return (name, sizes[0])

    @staticmethod
    def _spark_window(w: tuple) -> str:
        if w[0] == "tumble":
            return f"window({TIME}, '{w[1]} microseconds')"
        if w[0] == "hop":
            return f"window({TIME}, '{w[2]} microseconds', '{w[1]} microseconds')"
        return f"session_window({TIME}, '{w[1]} microseconds')"

    # --- expressions

    def _scan(self, exprs: list, clause: str) -> None:
        """Rules and replacements that hold in any expression."""
        unnests = set()
        for top in exprs:
            for e in _expressions(top):
                kind = _kind(e)
                if kind in ("ScalarSubquery", "ListQuery", "Exists", "InSubquery", "LateralSubquery"):
                    if self.streaming:
                        raise PlanError("sub-queries in expressions are not supported: a join needs windows on both sides")
                    if kind != "InSubquery":
                        self.walk(e.plan())
                name = _name(e)
                if name == "row_time":
                    self._replace(e, TIME)
                elif name == "unnest":
                    if clause != "SELECT":
                        raise PlanError("unnest is allowed in SELECT only")
                    unnests.add(e.sql())
                    arg = next(_items(e.arguments()))
                    start, _ = self._span(e)
                    self.edits[start, self._span(arg)[0] - 1] = ["explode("]
                elif name in ("count", "approx_distinct") and e.isDistinct() and self.streaming:
                    args = list(_items(e.arguments()))
                    if len(args) != 1:
                        raise PlanError("COUNT(DISTINCT) takes one expression in streaming queries")
                    if not self.counting:
                        self._replace(e, "size(collect_set(", self._span(args[0]), "))")
                elif name:
                    self._dialect(e, name)
        if len(unnests) > 1:
            raise PlanError("only one distinct unnest is allowed in a SELECT")

    def _dialect(self, e, name: str) -> None:
        """Give a call the dialect's meaning."""
        start, stop = self._span(e)
        if name in dialect.RENAMED:
            if self.sql[start : start + len(name)].lower() == name:
                self.edits[start, start + len(name) - 1] = [dialect.RENAMED[name]]
            return
        args = list(_items(e.arguments()))
        if name == "window" and len(args) == 2 and isinstance(self._value(args[1]), str):
            return  # Spark's own, as windows are written once compiled
        text = dialect.rewrite(name, [self._value(a) for a in args])
        if text is None:
            return
        if e.isDistinct() or e.filter().isDefined():
            raise PlanError(f"{name} takes no DISTINCT or FILTER")
        parts: list = []
        for k, piece in enumerate(re.split(r"\{(\d+)\}", text)):
            parts.append(self._span(args[int(piece)]) if k % 2 else piece)
        self.edits[start, stop] = parts

    @staticmethod
    def _value(a) -> str | int | None:
        """A literal string, or an interval's microseconds."""
        if _kind(a) != "Literal" or a.value() is None:
            return None
        kind = a.dataType().getClass().getSimpleName()
        if "DayTime" in kind:
            return int(a.value())
        return a.value().toString() if "String" in kind else None

    def _no_windows(self, exprs: list) -> None:
        for top in exprs:
            for e in _expressions(top):
                if _name(e) in WINDOWS:
                    raise PlanError(f"{_name(e)} is only allowed in GROUP BY; missing a GROUP BY clause?")

    # --- relations

    def walk(self, node) -> Relation:
        kind = _kind(node)
        handler = getattr(self, f"_on_{kind.lower().removeprefix('unresolved')}", None)
        if handler:
            return handler(node)
        children = list(_items(node.children()))
        if not children:
            return Relation()
        if len(children) == 1:
            self._scan(list(_items(node.expressions())), kind)
            return self.walk(children[0])
        raise PlanError(f"unsupported query: {kind}")

    def _on_with(self, node) -> Relation:
        for r in _items(node.cteRelations()):
            self.ctes[r._1().lower()] = self.walk(r._2())
            self.cte_texts.append((r._1(), self._span(r._2())))
        return self.walk(next(_items(node.children())))

    def _on_relation(self, node) -> Relation:
        name = node.multipartIdentifier().last().lower()
        if name in self.ctes:
            return self.ctes[name]
        if not self.known(name):
            raise NotFound(f"table {name} not found")
        self.sources.add(name)
        return Relation(updating=self.is_updating(name))

    def _on_subqueryalias(self, node) -> Relation:
        return self.walk(node.child())

    def _on_filter(self, node) -> Relation:
        self._no_windows(list(_items(node.expressions())))
        self._scan(list(_items(node.expressions())), "WHERE")
        return self.walk(node.child())

    def _on_having(self, node) -> Relation:
        self.counting = self._is_updating(node.child())
        self._scan(list(_items(node.expressions())), "HAVING")
        self.having = node
        return self.walk(node.child())

    def _carried(self, exprs: list, child: Relation) -> set[str]:
        out: set[str] = set()
        for e in exprs:
            if _kind(e) == "UnresolvedStar" or _kind(e) == "UnresolvedStarExceptOrReplace":
                out |= child.names
            elif _kind(e) == "Alias" and _column(e.child()) in child.names:
                out.add(e.name().lower())
            elif _column(e) in child.names:
                out.add(_column(e))
        return out

    def _on_project(self, node) -> Relation:
        child = self.walk(node.child())
        exprs = list(_items(node.projectList()))
        self._no_windows(exprs)
        overall = self.streaming and any(self._aggregates(e) for e in exprs)
        self.counting = overall
        self._scan(exprs, "SELECT")
        self.counting = False
        if overall:  # of all rows, without GROUP BY
            if child.window is not None:
                raise PlanError("an aggregate over windows needs the window in GROUP BY")
            self._remember(node, [], exprs, None, child)
            return Relation(updating=True)
        overs = [e for top in exprs for e in _expressions(top) if _kind(e) == "WindowExpression"]
        if overs:
            self._check_over(overs, child)
        names = self._carried(exprs, child)
        if self.block and self.streaming and not any(_kind(e).startswith("UnresolvedStar") for e in exprs):
            last = max(self._span(e.child() if _kind(e) == "UnresolvedAlias" else e)[1] for e in exprs)
            self.edits[last + 1, last] = [f", {', '.join(CARRIED)}"]
        return Relation(child.window if names else None, names, child.updating)

    def _aggregates(self, e) -> bool:
        """Whether an expression calls an aggregate, not over a window."""
        if _kind(e) == "WindowExpression":
            return False
        return _name(e) in RETRACTABLE or any(self._aggregates(c) for c in _items(e.children()))

    def _check_over(self, overs: list, child: Relation) -> None:
        if not self.streaming:
            self.over = True
            return
        if len(overs) > 1:
            raise PlanError("only one window function is allowed in a query block")
        if child.window is None:
            raise PlanError("window functions need a windowed input")
        if child.window[0] == "session":
            raise PlanError("window functions over session windows are not supported")
        spec = overs[0].windowSpec()
        if sum(_column(e) in child.names for e in _items(spec.partitionSpec())) != 1:
            raise PlanError("PARTITION BY must contain exactly one window column")
        self.over = True

    def _is_updating(self, node) -> bool:
        """Whether an aggregate of a streaming query has no window of its own, nor one passed on to it."""
        if not self.streaming or _kind(node) != "Aggregate":
            return False
        every = [e for top in [*_items(node.groupingExpressions()), *_items(node.aggregateExpressions())] for e in _expressions(top)]
        return not any(_name(e) in WINDOWS for e in every)

    def _on_aggregate(self, node) -> Relation:
        having, self.having = self.having, None
        child = self.walk(node.child())
        out = list(_items(node.aggregateExpressions()))
        grouped = {_column(e) for e in [*_items(node.groupingExpressions()), *out]}
        self.counting = self._is_updating(node) and not grouped & child.names
        self._scan([*out, *(e for e in _items(node.groupingExpressions()) if _kind(e) != "UnresolvedOrdinal")], "SELECT")
        self.counting = False
        grouping = []
        for e in _items(node.groupingExpressions()):
            if _kind(e) in ("GroupingSets", "Cube", "Rollup") or "Grouping" in _kind(e):
                if self.streaming:
                    raise PlanError("GROUPING SETS, CUBE and ROLLUP are for batch queries")
            if _kind(e) == "UnresolvedOrdinal":
                if not 1 <= e.ordinal() <= len(out):
                    raise PlanError(f"GROUP BY position {e.ordinal()} is not in the SELECT list")
                e = out[e.ordinal() - 1]
            elif (name := _column(e)) and (alias := next((o for o in out if _kind(o) == "Alias" and o.name().lower() == name), None)) is not None and (any(_name(x) in WINDOWS for x in _expressions(alias)) or self.streaming and _column(alias.child()) is None and not any(_name(x) in RETRACTABLE for x in _expressions(alias))):
                e = alias
            grouping.append(e.child() if _kind(e) == "Alias" else e)
        calls = [e for g in grouping for e in _expressions(g) if _name(e) in WINDOWS]
        stated = {self._window(e) for e in calls}
        every = [e for top in [*out, *_items(node.groupingExpressions())] for e in _expressions(top) if _name(e) in WINDOWS]
        if every and not calls:
            self._no_windows(every)
        if len(stated) > 1 or len({e.sql() for e in calls}) > 1:
            raise PlanError("only one window is allowed in GROUP BY")
        passed = {_column(g) for g in grouping} & child.names
        if calls:
            window = stated.pop()
            if any(self._window(e) != window for e in every):
                raise PlanError("the window in SELECT is not the one in GROUP BY")
            if child.updating and self.streaming:
                raise PlanError("windows over updating inputs are not supported")
            if child.window is not None:
                if passed:
                    raise PlanError("the input is windowed already; a second window is redundant")
                if window[0] == "session":
                    raise PlanError("session windows cannot be nested")
                if window != child.window:
                    raise PlanError("the window differs from the window of the input")
                text = sorted(child.names)[0]
            else:
                text = self._spark_window(window)
            for e in every:
                self._replace(e, text)
            names = {o.name().lower() for o in out if _kind(o) == "Alias" and _name(o.child()) in WINDOWS} or {"window" if window[0] != "session" else "session_window"}
            return Relation(window, names)
        if passed:
            return Relation(child.window, self._carried(out, child))
        if self.streaming:
            self._remember(node, grouping, out, having, child)
        return Relation(updating=True)

    def _remember(self, node, grouping: list, out: list, having, child: Relation) -> None:
        """Where the text of an updating aggregate's query is."""
        if self.block:
            raise PlanError("an aggregate over an updating aggregate is not supported")
        start, stop = self._span(having or node)
        begun, _ = self._span(node)
        found = ddl.tokens(self.sql)
        if self.sql[begun : begun + 6].lower() == "select":  # without GROUP BY
            end = stop
        else:
            depth, end = 0, begun - 1
            for t in reversed([t for t in found if t.start < begun]):
                depth += (t.text == ")") - (t.text == "(")
                if depth == 0 and t.word == "select":
                    start = t.start
                    break
        depth, source = 0, None
        for t in found:
            if start <= t.start <= end:
                if depth == 0 and t.word == "from" and source is None:
                    source = t.start
                if depth == 0 and t.word == "having" and source is not None:
                    end = t.start - 1
                depth += (t.text == "(") - (t.text == ")")
        if source is None:
            raise PlanError("an aggregate needs a FROM")
        self.block = _Block(start, stop, (source, end), list(self.cte_texts), grouping, out, having and having.havingCondition(), child.updating)

    def _changes(self) -> Changes:
        """Split the query at the updating aggregate."""
        block, keys, aggs = self.block, [], []
        columns = []
        for k, g in enumerate(block.grouping):
            keys.append(f"_rv_k{k}")
            columns.append(f"{self._text(g)} AS _rv_k{k}")
        same = {g.sql(): key for g, key in zip(block.grouping, keys, strict=True)}
        named: dict[str, str] = {}
        later: list[tuple[object, str]] = []

        def visit(e) -> None:
            if e.sql() in same:
                later.append((e, same[e.sql()]))
                return
            name = _name(e)
            if name in RETRACTABLE:
                if e.sql() not in named:
                    column = named[e.sql()] = f"_rv_a{len(aggs)}"
                    args = list(_items(e.arguments()))
                    if len(args) > 1:
                        raise PlanError(f"{name} takes one argument in an updating aggregate")
                    text = "1" if not args or _kind(args[0]) == "UnresolvedStar" or args[0].sql() == "1" else self._text(args[0])
                    if e.filter().isDefined():
                        text = f"CASE WHEN {self._text(e.filter().get())} THEN {text} END"
                    if e.isDistinct() and name not in ("count", "min", "max"):
                        raise PlanError(f"{name} of distinct values is not kept in updating aggregates")
                    aggs.append((column, "count_distinct" if e.isDistinct() and name == "count" else name, column))
                    columns.append(f"{text} AS {column}")
                later.append((e, named[e.sql()]))
                return
            for c in _items(e.children()):
                visit(c)

        tops = [o.child() if _kind(o) in ("Alias", "UnresolvedAlias") else o for o in block.out]
        for e in [*tops, *([block.having] if block.having is not None else [])]:
            visit(e)
        meta = [CARRIED[0]] if block.updating else []
        ctes = ", ".join(f"{name} AS ({self._render(self._unwrapped(span))})" for name, span in block.ctes)
        query = f"{f'WITH {ctes} ' if ctes else ''}SELECT {', '.join([*columns, *meta])} {self._render(block.source)}"
        texts = dict(zip(named.values(), (c.rsplit(" AS ", 1)[0] for c in columns[len(keys) :]), strict=True))
        functions = {column: fn for column, fn, _ in aggs}
        stated = [self._text(g) for g in block.grouping], [(o.name(), functions[c], texts[c]) for o in block.out if _kind(o) == "Alias" and (c := named.get(o.child().sql()))]
        for e, column in later:  # from here on, what is made of the results
            self._replace(e, column)
        items = []
        for o, e in zip(block.out, tops, strict=True):
            name = o.name() if _kind(o) == "Alias" else e.nameParts().last() if _kind(e) == "UnresolvedAttribute" else e.sql()
            items.append(f"{self._text(e)} AS `{name}`")
        text = f"SELECT {', '.join([*items, *CARRIED])} FROM {{changelog}}"
        if block.having is not None:
            text += f" WHERE {self._text(block.having)}"
        self.edits[block.start, block.stop] = [text]
        outer = self._render((0, len(self.sql) - 1))
        if self.cte_texts:  # those that the input reads are no part of what is made of its results
            rest = ", ".join(self._render(span) for name, span in self.cte_texts[len(block.ctes) :])
            outer = (f"WITH {rest} " if rest else "") + self._render((self.cte_texts[-1][1][1] + 1, len(self.sql) - 1)).lstrip()
        return Changes(query, keys, aggs, outer, stated)

    def _unwrapped(self, span: tuple[int, int]) -> tuple[int, int]:
        """The query inside a CTE's ``name AS (...)``."""
        start = self.sql.index("(", span[0])
        return start + 1, span[1] - 1

    def _on_distinct(self, node) -> Relation:
        child = self.walk(node.child())
        return Relation(child.window, child.names, child.updating or child.window is None)

    def _on_union(self, node) -> Relation:
        branches = [self.walk(c) for c in _items(node.children())]
        if self.block:
            raise PlanError("a union of updating aggregates is not supported")
        if len({b.window for b in branches}) > 1:
            raise PlanError("the branches of a union carry different windows")
        return Relation(branches[0].window, branches[0].names, any(b.updating for b in branches))

    def _table(self, node) -> str | None:
        """The name of a table, under its alias."""
        node = node.child() if _kind(node) == "SubqueryAlias" else node
        return node.multipartIdentifier().last().lower() if _kind(node) == "UnresolvedRelation" else None

    def _lookup(self, node, left: Relation) -> bool:
        """Whether rows are joined with a reference table, which is read whole for
        each batch and needs no window."""
        if not (name := self._table(node.right())) or not self.reference(name):
            return False
        if node.joinType().toString() not in ("Inner", "LeftOuter"):
            raise PlanError("a reference table is joined by INNER or LEFT JOIN")
        condition = node.condition()
        if not condition.isDefined() or not any(_kind(c) == "EqualTo" for c in self._conjuncts(condition.get())):
            raise PlanError("a join with a reference table needs an equality of keys")
        if left.updating:
            raise PlanError("updating rows cannot be joined with a reference table")
        return True

    def _on_join(self, node) -> Relation:
        left, right = self.walk(node.left()), self.walk(node.right())
        kind, condition = node.joinType().toString(), node.condition()
        conjuncts = list(self._conjuncts(condition.get())) if condition.isDefined() else []
        self._scan(conjuncts, "ON")
        if not self.streaming:
            return Relation(left.window, left.names | right.names if left.window == right.window else left.names, left.updating or right.updating)
        if self._lookup(node, left):
            return left
        if (name := self._table(node.left())) and self.reference(name):
            raise PlanError("a reference table stands on the right of a join")
        if kind.startswith(("UsingJoin", "NaturalJoin")):
            raise PlanError("USING and NATURAL joins are not implemented")
        if kind not in ("Inner", "Cross", "LeftOuter", "RightOuter", "FullOuter"):
            raise PlanError(f"{kind} joins are not supported")
        windows = [r.window for r in (left, right)]
        if None in windows:
            if windows != [None, None]:
                raise PlanError("joining windowed and un-windowed inputs is not supported")
            if kind not in ("Inner", "Cross"):
                raise PlanError("outer joins require windowing to bound state")
            if not any(_kind(c) == "EqualTo" for c in conjuncts):
                raise PlanError("a join without windows needs an equality of keys")
            if self.block:
                raise PlanError("a join of updating aggregates is not supported")
            self._expire(node)
            return Relation(updating=True)
        if any(w[0] == "session" for w in windows if w):
            raise PlanError("joins of session windows are not supported")
        if windows[0] != windows[1]:
            raise PlanError("the inputs of a join must have the same window")
        aligned = any(_kind(c) == "EqualTo" and _column(c.left()) in left.names | right.names and _column(c.right()) in left.names | right.names for c in conjuncts)
        if not aligned:
            raise PlanError("the join condition must equate the window columns of both sides")
        return Relation(left.window, left.names | right.names)

    def _expire(self, node) -> None:
        """Rows of a join without windows wait for each other for a bounded time,
        where both sides are tables with event times."""
        names = []
        for side in (node.left(), node.right()):
            if (table := self._table(side)) is None or not self.timed(table):
                return
            names.append(side.identifier().name() if _kind(side) == "SubqueryAlias" else side.multipartIdentifier().last())
        a, b = (f"`{n}`.{TIME}" for n in names)
        start, stop = self._span(node.condition().get())
        wait = f"INTERVAL '{JOIN_HOURS}' HOUR"
        self.edits[start, start - 1] = ["("]
        self.edits[stop + 1, stop] = [f") AND {a} >= {b} - {wait} AND {a} <= {b} + {wait}"]

    def _conjuncts(self, e) -> Iterator:
        if _kind(e) == "And":
            yield from self._conjuncts(e.left())
            yield from self._conjuncts(e.right())
        else:
            yield e

    def _reject(self, what: str, node) -> Relation:
        if self.streaming:
            raise PlanError(f"{what} is not supported in streaming queries")
        self._scan(list(_items(node.expressions())), what)
        return [self.walk(c) for c in _items(node.children())][0]

    def _on_sort(self, node) -> Relation:
        return self._reject("ORDER BY", node)

    def _on_globallimit(self, node) -> Relation:
        return self._reject("LIMIT", node)

    def _on_locallimit(self, node) -> Relation:
        return self._reject("LIMIT", node)

    def _on_offset(self, node) -> Relation:
        return self._reject("OFFSET", node)

    def _on_intersect(self, node) -> Relation:
        return self._reject("INTERSECT", node)

    def _on_except(self, node) -> Relation:
        return self._reject("EXCEPT", node)

    def _on_repartitionbyexpression(self, node) -> Relation:
        return self._reject("DISTRIBUTE BY", node)

    def _on_explaincommand(self, node) -> Relation:
        raise PlanError("EXPLAIN is not supported")
