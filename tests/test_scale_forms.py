"""Operators whose plan avoids pairs, unrolled spans or gathered sets: equal to brute force, hot values included."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import aggregates as A
from tidewire.operators import search as S


@pytest.mark.parametrize("common", [1000, 5, 0])
def test_related_items_with_values_of_all_items(spark, common):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        a = ["all"] + [f"r{rng.randrange(25)}" for _ in range(rng.randrange(4))] + (["half"] if i % 2 else [])
        rows.append((i, a if i != 59 else [], [rng.randrange(3) for _ in range(rng.randrange(3))]))
    got = {}
    for r in S.related(spark.createDataFrame(rows, "k int, a array<string>, b array<int>"), "k", [("a", 2), ("b", 1)], 3, common).collect():
        got.setdefault(r["k"], []).append((r["rank"], r["other"], r["score"]))
    for k, a, b in rows:
        score = {o: 2 * len(set(a) & set(x)) + len(set(b) & set(y)) for o, x, y in rows if o != k}
        want = sorted(((-s, o) for o, s in score.items() if s), key=lambda x: x)[:3]
        assert [(o, s) for _, o, s in sorted(got.get(k, []))] == [(o, -s) for s, o in want]


@pytest.mark.parametrize("copies", [1, 6])
def test_related_items_move_no_row_for_each_pair(spark, copies):
    """Rows of a key are one item; equal sets, negative keys and single values agree with brute force."""
    rng = random.Random(copies)
    sets = {}
    for i in range(120):
        a, b = rng.sample(range(-30, 30), rng.randrange(5)), [rng.randrange(20) * 2**33 for _ in range(rng.randrange(4))]
        sets |= {7 * i - 300 + 1000 * c: (a, b) for c in range(copies)}
    rows = [(k, a[h::2], b[h::2] + b[:1] + [None]) for k, (a, b) in sets.items() for h in (0, 1)]
    out = S.related(spark.createDataFrame(rows, "k bigint, a array<bigint>, b array<bigint>").repartition(3), "k", [("b", 1), ("a", 2)])
    if copies == 1:
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r["k"], []).append((r["rank"], r["other"], r["score"]))
    for k, (a, b) in sets.items():
        score = {o: 2 * len(set(a) & set(x)) + len(set(b) & set(y)) for o, (x, y) in sets.items() if o != k}
        want = sorted((-s, o) for o, s in score.items() if s)[:3]
        assert sorted(got.get(k, [])) == [(i + 1, o, -s) for i, (s, o) in enumerate(want)]


def test_alive_weeks_equal_unrolled_spans(spark):
    rng = random.Random(2)
    day = lambda n: datetime.date(2023, 12, 1) + datetime.timedelta(days=n)
    rows = [(i, rng.choice("xy"), day(s), day(s + rng.randrange(40))) for i in range(50) for s in [rng.randrange(120)]] + [(99, "x", None, day(3)), (98, "z", day(300), day(300))]
    want = {}
    for k, g, f, t in rows:
        if f:
            for n in range((t - f).days + 1):
                y, w, _ = (f + datetime.timedelta(days=n)).isocalendar()
                want.setdefault((g, f"{y}-W{w:02d}"), set()).add(k)
    got = {(r["g"], r["week"]): r["n"] for r in A.alive_weeks(spark.createDataFrame(rows, "k int, g string, f date, t date"), "k", "f", "t", "g").collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_verification_counts(spark):
    rows = [("a", "s", True), ("a", "s", False), ("a", "t", False), ("b", "s", None), ("b", None, True), ("c", "s", False), ("c", "t", False), ("d", None, False)]
    got = {r["i"]: (r["official"], r["independent"], r["state"]) for r in A.verification(spark.createDataFrame(rows, "i string, s string, o boolean"), "i", "s", F.col("o")).collect()}
    assert got == {"a": (1, 1, "confirmed"), "b": (0, 1, "single"), "c": (0, 2, "cross_checked"), "d": (0, 0, "unverified")}
