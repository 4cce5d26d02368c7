"""URL filtering by a bit-parallel wildcard automaton.

Every rule is a glob over a canonical url (host, folded, and path): ``*`` is any
run without a slash, ``**`` any run, ``?`` any one character. All globs are
packed, one bit for each character, into words of 64 bits; one Shift-And step a
character moves all of them at once, with a carry between words and masks for
the wildcards' loops, and simulates them for a whole batch of urls side by side.
Of the rules that fit a url the longest decides (of equal ones the one given
first); where none fits, the filter's default.

``host_rule`` makes the globs of a rule "this host and all its subdomains,
paths that start so". A null url, or one without ``://``, has an empty host and
path, fits no host rule and gets the default. Repeated rows get equal results.
Long urls are taken whole; memory is bounded by the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import LOWER, UPPER, bounded_batches

ALLOW, BLOCK = "allow", "block"
#: Urls simulated side by side.
LANES = 4096


@dataclass(frozen=True)
class Rule:
    """A verdict, the globs any of which must fit, and the name to report."""

    verdict: str
    globs: tuple[str, ...]
    name: str
    length: int
    report: bool = True


def host_rule(verdict: str, host: str, path: str) -> Rule:
    return Rule(verdict, (f"{host}{path}**", f"*.{host}{path}**"), host + path, len(host) + len(path))


def glob_rule(verdict: str, glob: str) -> Rule:
    """A rule of the filter itself: it decides where no host rule fits, and is not reported."""
    return Rule(verdict, (glob,), glob, 0, report=False)


#: The production rules.
HOST_RULES = [
    host_rule(BLOCK, "net", "/"),
    host_rule(ALLOW, "example.net", "/en/"),
    host_rule(BLOCK, "example.com", "/de/"),
    host_rule(ALLOW, "org", "/fr/"),
]
#: Paths that lead to no prose.
GLOB_RULES = [glob_rule(BLOCK, g) for g in ("**.jpg", "**.png", "**.gif", "**.zip", "**.exe", "**/cgi-bin/**", "**/wp-admin/**")]


class Automaton:
    """All globs of some rules as masks of W words.

    State bit k says that a prefix of a glob as long as k's position fits. A
    literal at k is entered from k-1 on its character; a star at k is entered
    from k-1 without reading and left alone while its run goes on.
    """

    def __init__(self, rules: list[Rule]) -> None:
        tokens: list[tuple[str, str]] = []  # kind and character of each bit
        self.finals: list[tuple[int, int]] = []  # bit, number of the rule
        starts = []
        for number, rule in enumerate(rules):
            for glob in rule.globs:
                starts.append(len(tokens))
                tokens.append(("start", ""))
                i = 0
                while i < len(glob):
                    if glob.startswith("**", i):
                        tokens.append(("any", ""))
                        i += 2
                        continue
                    c = glob[i]
                    tokens.append(("segment", "") if c == "*" else ("one", "") if c == "?" else ("literal", c))
                    i += 1
                self.finals.append((len(tokens) - 1, number))
        self.words = len(tokens) // 64 + 1
        mask = lambda bits: self._mask(bits)
        self.start = mask(starts)
        self.star = mask(k for k, (kind, _) in enumerate(tokens) if kind in ("any", "segment"))
        self.any = mask(k for k, (kind, _) in enumerate(tokens) if kind == "any")
        ones = [k for k, (kind, _) in enumerate(tokens) if kind == "one"]
        letters = sorted({c for kind, c in tokens if kind == "literal"})
        #: Row 0 is for characters in no glob, the last row for the slash if it is in none.
        self.row = {c: r for r, c in enumerate(letters, 1)}
        self.row.setdefault("/", len(self.row) + 1)
        self.enter = np.stack([mask(ones)] * (len(self.row) + 1))
        for c in letters:
            self.enter[self.row[c]] = mask([*ones, *(k for k, t in enumerate(tokens) if t == ("literal", c))])
        segment = mask(k for k, (kind, _) in enumerate(tokens) if kind == "segment")
        self.loop = np.stack([self.any | segment] * (len(self.row) + 1))
        self.loop[self.row["/"]] = self.any
        self.table = np.zeros(0x110000, np.uint8 if len(self.row) < 255 else np.uint32)
        for c, r in self.row.items():
            self.table[ord(c)] = r

    def _mask(self, bits) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for k in bits:
            out[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        return out

    @staticmethod
    def _shifted(d: np.ndarray) -> np.ndarray:
        out = d << np.uint64(1)
        out[:, 1:] |= d[:, :-1] >> np.uint64(63)
        return out

    def _closed(self, d: np.ndarray) -> np.ndarray:
        """With the stars entered that follow without a character; two stars never adjoin usefully."""
        return d | (self._shifted(d) & self.star)

    def fits(self, texts: list[str]) -> np.ndarray:
        """(text, rule) whether any of the rule's globs fits the whole text."""
        n_rules = 1 + max((r for _, r in self.finals), default=-1)
        out = np.zeros((len(texts), n_rules), bool)
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            lengths = np.array([len(texts[k]) for k in lanes])
            joined = np.frombuffer("".join(texts[k] for k in lanes).encode("utf-32-le", "surrogatepass"), np.uint32)
            rows = self.table[joined]
            begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            state = self._closed(np.tile(self.start, (len(lanes), 1)))
            for k in range(int(lengths[0]) if len(lengths) else 0):
                live = int(np.searchsorted(-lengths, -k, side="left"))  # lanes longer than k come first
                now = state[:live]
                row = rows[begin[:live] + k]
                state[:live] = self._closed((self._shifted(now) & self.enter[row]) | (now & self.loop[row]))
            for bit, rule in self.finals:
                out[lanes, rule] |= (state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(bool)
        return out


def host(url: Column) -> Column:
    """What follows the first ``://``, up to a slash, ``?``, ``#`` or the end; A-Z folded."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def judge(df: DataFrame, rules: list[Rule], default: str = ALLOW, url_col: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (null if no reported rule fits)
    and ``verdict``; columns of those names are replaced."""
    bounded_batches(df.sparkSession, rows=8192)
    automaton = df.sparkSession.sparkContext.broadcast(Automaton(rules))
    rank = sorted(range(len(rules)), key=lambda k: (not rules[k].report, -rules[k].length, k))

    @F.pandas_udf("rule string, verdict string")
    def decided(urls: pd.Series) -> pd.DataFrame:
        fits = automaton.value.fits(urls.tolist())[:, rank]
        best = fits.argmax(axis=1) if fits.size else np.zeros(len(urls), int)
        hit = fits.any(axis=1)
        picked = [rules[rank[b]] if h else None for b, h in zip(best, hit, strict=True)]
        return pd.DataFrame({"rule": [r.name if r and r.report else None for r in picked], "verdict": [r.verdict if r else default for r in picked]})

    url, tmp = F.col(url_col), "_rv_decided"
    parts = df.withColumns({"_rv_host": host(url), "_rv_path": path(url)}).withColumn(tmp, decided(F.concat("_rv_host", "_rv_path")))
    return parts.withColumns({"host": F.col("_rv_host"), "path": F.col("_rv_path"), "rule": F.col(f"{tmp}.rule"), "verdict": F.col(f"{tmp}.verdict")}).drop(tmp, "_rv_host", "_rv_path")


def digest(pages: DataFrame) -> DataFrame:
    """The query's rows: page_id, host, path, rule, verdict."""
    return judge(pages.select("page_id", "url"), HOST_RULES + GLOB_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, '.' || host AS h FROM p),
q AS (SELECT page_id, host, path,
        CASE WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM f)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host || path, '(?s)(\.jpg|\.png|\.gif|\.zip|\.exe)$|/cgi-bin/|/wp-admin/') THEN 'block' ELSE 'allow' END AS verdict
FROM q
"""
