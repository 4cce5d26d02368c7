import fnmatch
import random
import re

from rivulet.llm import urlfilter as U


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [(len(h) + len(p), v, h + p) for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "https://a.net?x=/", "http://evilnet/", "http://example.net/en/1", "http://x.Example.net/EN/1", "http://example.com/de/a?b#c",
    "ftp://b.example.com/de", "http://c.org/fr/", "http://c.org/frx", "x://y://z.net/", "http://user@h.net:80/p", "http://ex.com/a.jpg", "http://ex.com/cgi-bin/x", "http://ex.com/.net/en/", "http://ü.org/fr/é", "http://h#f", "http://" + "a" * 9000 + ".net/", "http://x.net/" + "y/" * 5000,
]


def test_query_rows(spark):
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(5, URLS[5], "x")], "page_id long, url string, host string")
    rows = U.digest(df).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = plain(URLS[r.page_id])
        verdict, rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == (verdict or ("block" if re.search(r"(\.jpg|\.png|\.gif|\.zip|\.exe)$|/cgi-bin/|/wp-admin/", host + path) else "allow"))
    assert U.digest(df.limit(0)).count() == 0


def glob_fits(glob, text):
    pattern, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            pattern, i = pattern + "(?s:.*)", i + 2
        else:
            pattern, i = pattern + {"*": "[^/]*", "?": "(?s:.)"}.get(glob[i], re.escape(glob[i])), i + 1
    return re.fullmatch(pattern, text) is not None


def test_automaton_equals_regular_expressions(monkeypatch):
    monkeypatch.setattr(U, "LANES", 7)
    r = random.Random(4)
    globs = ["".join(r.choice(["a", "b", "/", "*", "?", "c"]) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    globs = [re.sub(r"\*\*+", "**", g) for g in globs] + ["**", "*", "", "a**", "**a", "x" * 130 + "*"]
    rules = [U.glob_rule("block", g) for g in globs]
    texts = ["".join(r.choice("abc/") for _ in range(r.randrange(0, 12))) for _ in range(150)] + ["", "x" * 130, "x" * 130 + "yy", "😀a"]
    fits = U.Automaton(rules).fits(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert fits[i, j] == glob_fits(g, t), (g, t)
    assert fnmatch.fnmatch("ab", "a*")  # the globs here are stricter: one star stays within a segment
