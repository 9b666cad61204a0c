import fnmatch
import random
import re

from tidewire.llm.url_filter import ShiftAnd, filter_urls, glob_rule, host_rule


def brute(pattern, text):
    out = ""
    for c in pattern:
        out += {"*": ".*", "^": "[^/]*", "?": "."}.get(c, re.escape(c))
    return re.fullmatch(out, text, re.S) is not None


def test_automaton_equals_regex_over_many_words():
    rng = random.Random(3)
    patterns = ["".join(rng.choice("ab/*?^") for _ in range(rng.randint(1, 9))) for _ in range(70)]
    texts = ["".join(rng.choice("ab/é") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    machine = ShiftAnd(patterns)
    assert machine.words > 1
    got = machine.accepts(texts)
    for i, t in enumerate(texts):
        for k, p in enumerate(patterns):
            assert got[i, k] == brute(p, t), (p, t)


def test_host_rules_longest_wins_and_edges(spark):
    rows = [
        (1, "http://a.example.com/en/7x?q", "x"),
        (2, "http://a.example.com/en/8", None),
        (3, "HTTP://EXAMPLE.NET/de/8", None),
        (4, "https://notexample.net/de/8#f", None),
        (5, None, None),
        (6, "no scheme", None),
        (7, "http://foo.org/x.com/en/", None),
        (8, "http://Casino-win.org", None),
        (8, "http://Casino-win.org", None),
        (9, "http://com?/en/", None),
        (10, "http://é.com/en/" + "x" * 5000, None),
        (None, "", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = sorted((tuple(r) for r in filter_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert by[1][3:] == ("example.com/en/7", "allow")
    assert by[2][3:] == ("com/en/", "block")
    assert by[3][1:] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert by[4][3:] == ("net/de/", "allow")
    assert by[5][1:] == ("", "", None, "allow") == by[6][1:] == by[None][1:]
    assert by[7][3:] == (None, "allow")
    assert by[8][1:] == ("casino-win.org", "", None, "block")
    assert by[9][1:] == ("com", "", None, "allow")
    assert by[10][3] == "com/en/"


def test_empty_table_and_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(df).count() == 0
    one = spark.createDataFrame([(1, "http://x.y/z")], "page_id long, url string")
    assert filter_urls(one, rules=[]).first()["verdict"] == "allow"
    assert filter_urls(one, rules=[glob_rule("block", "*/z")]).first()["verdict"] == "block"
    assert filter_urls(one, rules=[host_rule("block", "y", "")]).first()["rule"] == "y"
