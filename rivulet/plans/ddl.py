"""Statements of the dialect: splitting a script and classifying what it holds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from rivulet.errors import ParseError, PlanError

_TOKEN = re.compile(r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^']|'')*')|(?P<quoted>"[^"]*"|`[^`]*`)|(?P<word>[A-Za-z_]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<other>.)""", re.S | re.X)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def word(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text


def tokens(sql: str) -> list[Token]:
    """Tokens without white space and comments."""
    return [Token(m.lastgroup or "", m[0], m.start(), m.end()) for m in _TOKEN.finditer(sql) if m.lastgroup != "space"]


def split(sql: str) -> list[str]:
    """The statements of a script, without their semicolons."""
    out, at = [], 0
    for t in tokens(sql):
        if t.text == ";":
            out.append(sql[at : t.start])
            at = t.end
    out = [s.strip() for s in [*out, sql[at:]] if tokens(s)]
    if not out:
        raise ParseError("Query is empty")
    return out


@dataclass
class Column:
    name: str
    type: str
    not_null: bool = False
    expr: str | None = None


@dataclass
class CreateTable:
    name: str
    columns: list[Column]
    options: dict[str, str]
    primary_key: list[str] = field(default_factory=list)
    watermark: tuple[str, str | None] | None = None
    if_not_exists: bool = False
    text: str = ""


@dataclass
class CreateStreamingTable:
    name: str
    options: dict[str, str]
    select: str
    comment: str | None = None
    if_not_exists: bool = False
    text: str = ""


@dataclass
class Drop:
    what: str  # table, streaming table or function
    name: str
    if_exists: bool = False


@dataclass
class Show:
    what: str  # tables, streaming tables or functions
    name: str | None = None  # with a name: SHOW CREATE


@dataclass
class CreateFunction:
    options: dict[str, str]


@dataclass
class FunctionState:
    action: str  # start or stop
    name: str


Statement = CreateTable | CreateStreamingTable | Drop | Show | CreateFunction | FunctionState


def name_of(t: Token) -> str:
    if t.kind not in ("word", "quoted"):
        raise ParseError(f"a name is expected, not {t.text!r}")
    return t.text.strip('"`').lower()


class _Reader:
    """Reads the tokens of one statement."""

    def __init__(self, sql: str) -> None:
        self.sql, self.all, self.at = sql, tokens(sql), 0

    def peek(self, ahead: int = 0) -> str:
        return self.all[self.at + ahead].word if self.at + ahead < len(self.all) else ""

    def next(self) -> Token:
        if self.at >= len(self.all):
            raise ParseError(f"the statement ends too early: {self.sql[-60:]}")
        self.at += 1
        return self.all[self.at - 1]

    def accept(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise ParseError(f"{' '.join(words).upper()} is expected at {self.peek()!r}")

    def name(self) -> str:
        return name_of(self.next())

    def done(self) -> None:
        if self.at < len(self.all):
            raise ParseError(f"unexpected {self.peek()!r}")

    def options(self) -> dict[str, str]:
        """('key' = 'value', ...)"""
        out: dict[str, str] = {}
        self.expect("(")
        while not self.accept(")"):
            key, _, value = self.next(), self.expect("="), self.next()
            if key.kind != "text":
                raise ParseError(f"an option's name is a string, not {key.text}")
            out[key.text[1:-1].replace("''", "'")] = value.text[1:-1].replace("''", "'") if value.kind == "text" else value.text
            self.accept(",")
        return out

    def until(self, *stops: str) -> str:
        """Source text up to a stop outside brackets."""
        depth, begin = 0, self.at
        while self.at < len(self.all):
            t = self.peek()
            if depth == 0 and t in stops:
                break
            depth += (t in ("(", "<", "[")) - (t in (")", ">", "]"))
            self.at += 1
        if begin == self.at:
            raise ParseError(f"something is missing before {self.peek()!r}")
        return self.sql[self.all[begin].start : self.all[self.at - 1].end]


def _columns(r: _Reader, out: CreateTable) -> None:
    r.expect("(")
    while not r.accept(")"):
        if r.accept("watermark"):
            if out.watermark:
                raise PlanError("only one WATERMARK is allowed")
            r.expect("for")
            name = r.name()
            out.watermark = (name, r.until(",", ")") if r.accept("as") else None)
        elif r.accept("primary", "key"):
            if out.primary_key:
                raise PlanError("only one PRIMARY KEY is allowed")
            r.expect("(")
            while not r.accept(")"):
                out.primary_key.append(r.name())
                r.accept(",")
        else:
            column = Column(r.name(), r.until(",", ")", "not", "null", "primary", "generated", "as", "metadata"))
            while r.peek() not in (",", ")"):
                if r.accept("not", "null"):
                    column.not_null = True
                elif r.accept("null"):
                    pass
                elif r.accept("primary", "key"):
                    if out.primary_key:
                        raise PlanError("only one PRIMARY KEY is allowed")
                    out.primary_key.append(column.name)
                elif r.accept("generated", "always", "as") or r.accept("as"):
                    column.expr = r.until(",", ")", "stored", "virtual") if not r.accept("(") else r.until(")")
                    r.accept(")")
                    r.accept("stored") or r.accept("virtual")
                elif r.accept("metadata"):
                    r.expect("from")
                    column.expr = f"metadata:{r.next().text.strip(chr(39))}"
                else:
                    raise ParseError(f"unexpected {r.peek()!r} in column {column.name}")
            out.columns.append(column)
        if r.peek() not in (",", ")"):
            raise ParseError(f"unexpected {r.peek()!r} in the columns")
        r.accept(",")


def _create(r: _Reader) -> Statement:
    if r.accept("function"):
        r.expect("with")
        out = CreateFunction(r.options())
        if "function_path" not in out.options:
            raise PlanError("CREATE FUNCTION needs 'function_path'")
        return out
    if r.accept("streaming", "table"):
        exists = r.accept("if", "not", "exists")
        name = r.name()
        r.expect("with")
        options = r.options()
        comment = r.next().text[1:-1] if r.accept("comment") else None
        r.expect("as")
        if r.at >= len(r.all):
            raise ParseError("AS needs a query")
        return CreateStreamingTable(name, options, r.sql[r.all[r.at].start :], comment, exists, r.sql)
    for word in ("or", "temporary", "temp", "external"):
        if r.peek() == word:
            raise PlanError(f"CREATE {word.upper()} is not supported for tables with a connector")
    r.expect("table")
    out = CreateTable("", [], {}, text=r.sql)
    out.if_not_exists = r.accept("if", "not", "exists")
    out.name = r.name()
    if r.peek() == "(":
        _columns(r, out)
    if r.accept("with"):
        out.options = r.options()
    if r.accept("as"):
        raise PlanError("CREATE TABLE ... AS SELECT is not supported; use CREATE STREAMING TABLE")
    r.done()
    return out


def parse_one(sql: str) -> Statement:
    r = _Reader(sql)
    if r.accept("create"):
        return _create(r)
    if r.accept("drop"):
        what = "streaming table" if r.accept("streaming", "table") else "function" if r.accept("function") else "table"
        if what == "table":
            r.expect("table")
        out = Drop(what, "", r.accept("if", "exists"))
        out.name = r.name()
        if r.peek() == ",":
            raise PlanError("DROP takes one name")
        r.done()
        return out
    if r.accept("show"):
        if r.accept("create"):
            what = "streaming tables" if r.accept("streaming") else "tables"
            r.expect("table")
            out = Show(what, r.name())
        else:
            what = "streaming tables" if r.accept("streaming", "tables") else "functions" if r.accept("functions") else "tables"
            if what == "tables":
                r.expect("tables")
            out = Show(what)
        r.done()
        return out
    for action in ("start", "stop"):
        if r.accept(action, "function"):
            out = FunctionState(action, r.name())
            r.done()
            return out
    if r.peek() == "insert":
        raise PlanError("INSERT is not supported; use CREATE TABLE for sources and CREATE STREAMING TABLE for continuous queries")
    raise PlanError(f"unsupported statement {r.peek().upper()!r}; use CREATE TABLE or CREATE STREAMING TABLE")


def parse(sql: str) -> list[Statement]:
    """All statements of a script."""
    return [parse_one(s) for s in split(sql)]
