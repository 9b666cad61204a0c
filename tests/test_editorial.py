import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewire.operators import editorial as E


def test_local_vectors_equal_brute_force(spark):
    rows = [(1, "Reactor deal", "signed today", ["smr"]), (2, "Reactor delay", "", []), (3, "", "x", ["smr", "uk"])]
    df = spark.createDataFrame(rows, "k int, t string, s string, g array<string>")
    got = {(r["k"], r["idx"]): r["value"] for r in E.local_vectors(df, "k", "t", "s", "g").collect()}
    feats = {}
    for k, t, s, g in rows:
        f = Counter()
        a, b = (re.sub(r"\W", "", x.lower()) for x in (t, s))
        for n, w in E.TITLE_WEIGHTS.items():
            for i in range(len(a) - n + 1):
                f[f"t{n}:{a[i : i + n]}"] += w
        for i in range(len(b) - 2):
            f[f"s3:{b[i : i + 3]}"] += E.SUMMARY_WEIGHT
        for w in dict.fromkeys(x[:8] for x in f"{t} {s}".lower().split() if len(x) >= 2):
            f[f"w:{w}"] += E.WORD_WEIGHT
        for x in g:
            f[f"tag:{x}"] += E.TAG_WEIGHT
        feats[k] = f
    df_ = Counter(x for f in feats.values() for x in f)
    want = {}
    for k, f in feats.items():
        v = Counter()
        for x, w in f.items():
            v[int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") % E.DIMENSION] += w * (math.log(4 / (1 + df_[x])) + 1)
        norm = math.sqrt(sum(y * y for y in v.values()))
        want |= {(k, i): y / norm for i, y in v.items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    pairs = spark.createDataFrame([(1, 2)], "left int, right int")
    cos = E.sparse_cosine(E.local_vectors(df, "k", "t", "s", "g"), pairs, "k").first()["cosine"]
    assert abs(cos - sum(y * want.get((2, i), 0) for (k, i), y in want.items() if k == 1)) < 1e-5


def test_folds(spark):
    df = spark.createDataFrame([("w", "a", 9.0, ["kr"], ["1", "2"]), ("w", "b", 8.5, ["kr"], ["1", "2"]), ("w", "c", 6.0, ["us"], ["3"]), ("w", "d", 1.0, [], [])], "g string, k string, s double, r array<string>, e array<string>")
    assert {(r["k"], r["rank"]) for r in E.featured(df, "g", "k", "s", "r", "e", n=2).collect()} == {("a", 1), ("c", 2)}
    assert {r["k"]: r["kept_as"] for r in E.fold_insights(df, "g", "k", "e", "s").collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    rows = spark.createDataFrame([("s", "1", 1, "new reactor deal signed"), ("s", "2", 1, "reactor deal signed again"), ("s", "2", 2, "court rules"), ("s", "3", 1, "court rules")], "site string, day string, rank int, title string")
    assert [r["headline"] for r in E.headlines(rows, "site", "day", "rank", "title").orderBy("day").collect()] == ["new reactor deal signed", "court rules", "court rules"]
    lead = spark.createDataFrame([("s", d, k, v) for d in ("1", "2", "3", "4", "5") for k, v in (("a", 3.0), ("b", 2.0))], "site string, day string, k string, v double")
    first = {r["day"]: r["k"] for r in E.cooled_order(lead, "site", "day", "k", "v").where("position = 1").collect()}
    assert first == {"1": "a", "2": "b", "3": "a", "4": "a", "5": "a"}


def test_bodies(spark):
    page = "<nav>menu</nav><article><p>short</p></article><article><script>x</script><h1>Big &amp; long</h1><p>text here</p></article>"
    df = spark.createDataFrame([(page, "Big long text"), ("<p>one</p><p>two</p>", "Other words entirely missing"), (None, "")], "h string, t string").select(E.article_body(F.col("h")).alias("b"), "t")
    got = df.select("b", E.body_fits_title(F.col("b"), F.col("t")).alias("fits")).collect()
    assert [(r["b"], r["fits"]) for r in got] == [("Big & long\ntext here", True), ("one\ntwo", False), ("", True)]
