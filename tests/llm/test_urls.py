"""The wildcard automaton against regular expressions, and odd URLs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from boxoffice.llm.urls import ALLOW, BLOCK, Automaton, Rule, Rules, host_and_path, judged


def plain(rules, url):
    fits = []
    for k, rule in enumerate(rules):
        parts = re.findall(r"\*\*|\*|\?|[^*?]", rule.glob)
        regex = "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
        if re.fullmatch(regex, url):
            fits.append((-len(rule.name), k))
    return min(fits)[1] if fits else -1


def test_globs():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab./") for _ in range(rng.randrange(0, 12)))
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    for rules in ([Rule(g, ALLOW, g) for g in globs], [Rule(g, BLOCK, g) for g in globs[:3]], []):
        automaton = Automaton(rules)
        assert automaton.words == max(1, -(-sum(len(re.sub(r"\*", "", r.glob)) + 1 for r in rules) // 64))
        urls = [word() for _ in range(500)] + ["", "a" * 3000, "é/ü"[:2]]
        assert automaton.match([u.encode() for u in urls]).tolist() == [plain(rules, u) for u in urls]


def test_rules_by_the_end_of_the_host(monkeypatch):
    monkeypatch.setattr("boxoffice.llm.urls.CACHE_WORDS", 4)
    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "/", ".", ".", "*.", "*", "**", "?", "a.b/", ".b/"]) for _ in range(rng.randrange(0, 7))) for _ in range(300)]
    rules = [Rule(re.sub(r"\*{3,}", "**", g), rng.choice([ALLOW, BLOCK]), g) for g in globs]
    grouped = Rules(rules)
    assert len(grouped.groups) > 10 and len(grouped.groups["*"]) < 250
    host = lambda: "".join(rng.choice("ab..") for _ in range(rng.randrange(0, 7)))
    path = lambda: "".join(rng.choice("/ab.") for _ in range(rng.randrange(0, 6)))
    urls = [(host(), rng.choice(["", "/" + path()])) for _ in range(800)]
    want = [plain(rules, f".{h}{p}") for h, p in urls]
    assert [r and rules.index(r) for r in grouped.match(urls)] == [rules.index(rules[k]) if k >= 0 else None for k in want]
    assert sum(k >= 0 for k in want) > 300


def test_a_list_of_many_rules():
    """A hundred thousand sites; a URL meets those with the end of its host."""
    rules = Rules([Rule.site(BLOCK, f"site{n}.{'com' if n % 3 else 'co.uk'}/p{n % 7}/") for n in range(100_000)] + [Rule.site(ALLOW, "com/")])
    urls = [(f"www.site{n}.com", f"/p{n % 7}/x") for n in range(1, 40_000, 101)] + [("a.site3.co.uk", "/p3/"), ("site3.co.uk", "/p4/"), ("x.org", "/")]
    found = [r and r.name for r in rules.match(urls)]
    assert found == [f"site{n}.com/p{n % 7}/" if n % 3 else "com/" for n in range(1, 40_000, 101)] + ["site3.co.uk/p3/", None, None]


@pytest.mark.parametrize(
    "url, parts",
    [
        (None, ("", "")),
        ("", ("", "")),
        ("example.com/en/", ("", "")),
        ("http://", ("", "")),
        ("HTTP://WWW.Exämple.COM:80/A/b?q#f", ("www.exämple.com:80", "/A/b")),
        ("x://host?q=/a/", ("host", "")),
        ("x://host#/a/", ("host", "")),
        ("a://b://c/d", ("b:", "//c/d")),
        ("x://h\n/a\nb", ("h\n", "/a\nb")),
    ],
)
def test_parts(url, parts):
    assert host_and_path(url) == parts


def test_odd_rows(spark):
    rules = [Rule.site(ALLOW, "com/"), Rule.site(BLOCK, "example.com/en/"), Rule.site(ALLOW, "www.example.com/en/"), Rule.site(BLOCK, "net/es/")]
    cases = {
        "http://a.example.com/en/x": ("example.com/en/", BLOCK),
        "http://www.example.com/en/x": ("www.example.com/en/", ALLOW),
        "http://m.www.example.com/en/": ("www.example.com/en/", ALLOW),
        "http://badexample.com/en/x": ("com/", ALLOW),
        "http://example.com": (None, BLOCK),
        "http://example.com:80/en/": (None, BLOCK),
        "http://com/": ("com/", ALLOW),
        "http://x.org/a.net/es/": (None, BLOCK),
        "http://x.net/es/" + "y" * 100_000: ("net/es/", BLOCK),
        "http://x.net/es": (None, BLOCK),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(0, next(iter(cases))), (None, None), (99, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit("x"))
    got = judged(df, rules, otherwise=BLOCK).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in range(len(cases)):
            assert (r.rule, r.verdict) == list(cases.values())[r.page_id], r
        else:
            assert (r.host, r.path, r.rule, r.verdict) == ("", "", None, BLOCK)
    assert judged(df.limit(0), rules).count() == 0
    assert {r.verdict for r in judged(df, []).collect()} == {ALLOW}
