"""A line reader for statements: ``python -m rivulet.repl [catalog.json]``.

A statement may take many lines; it runs once it ends in a semicolon and its
brackets are closed. ``help``, ``clear`` and ``exit`` are words of their own.
"""

from __future__ import annotations

import sys

from rivulet.plans import ddl
from rivulet.streaming.session import Result, Session

HELP = """Statements end with a semicolon: CREATE TABLE, CREATE STREAMING TABLE ... AS SELECT,
DROP, SHOW [CREATE] [STREAMING] TABLE[S], CREATE/START/STOP/DROP FUNCTION, SHOW FUNCTIONS.
help, clear (what has been typed), exit."""
#: Rows shown of a result.
SHOWN = 100


def table(rows: list[tuple], columns: list[str]) -> str:
    """Rows in a frame of characters."""
    cells = [columns, *([("" if v is None else str(v)).replace("\n", " ") for v in r] for r in rows)]
    widths = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {v.ljust(w)} " for v, w in zip(r, widths, strict=True)) + "|"
    return "\n".join([rule, line(cells[0]), rule, *map(line, cells[1:]), rule])


def shown(result: Result) -> str:
    if not result.ok:
        return f"error {result.code}: {result.message}"
    if result.df is None:
        return result.message or "ok"
    rows = [tuple(r) for r in result.df.limit(SHOWN).collect()]
    return f"{table(rows, result.df.columns)}\n{len(rows)} row(s)"


class Repl:
    """Takes lines and gives back what is to be printed."""

    def __init__(self, session: Session) -> None:
        self.session, self.typed, self.open = session, "", True

    @property
    def prompt(self) -> str:
        return "... " if self.typed.strip() else "rivulet> "

    def feed(self, line: str) -> str | None:
        """What a line makes appear; None while a statement is unfinished."""
        word = line.strip().rstrip(";").lower()
        if word == "clear":
            self.typed = ""
            return ""
        if not self.typed.strip():
            if word in ("exit", "quit"):
                self.open = False
                return "bye"
            if word == "help":
                return HELP
            if not word:
                return None
        self.typed += line + "\n"
        found = ddl.tokens(self.typed)
        depth = sum((t.text in "([") - (t.text in ")]") for t in found if len(t.text) == 1)
        if not found or found[-1].text != ";" or depth > 0:
            return None
        text, self.typed = self.typed, ""
        return shown(self.session.sql(text))


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("rivulet").getOrCreate()
    repl = Repl(Session(spark, sys.argv[1] if len(sys.argv) > 1 else None))
    while repl.open:
        try:
            out = repl.feed(input(repl.prompt))
        except EOFError:
            break
        if out:
            print(out)


if __name__ == "__main__":
    main()
