import os
import random

import numpy as np
import pandas as pd
import pytest

from tidewire.llm import quality as Q

DATA = "/root/testdata/sf0.1"


def test_features_edges():
    x = Q.features([None, "", " ", "A b!", "é" * 50000, "go go go\n| x |"])
    assert x.shape == (6, 16) and np.isfinite(x).all()
    assert np.allclose(x[0], x[1]) and x[5, 8] == 2 / 6 and x[3, 1] == 1 / 5


def test_rates_equal_formula_and_shrink(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.random() * (0.2 if i % 3 else 1)) for i in range(300)] + [(900, "rare", "y", 0.01)]
    df = spark.createDataFrame(rows, "doc_id long, site string, section string, p_doc double")
    got = {(r["site"], r["section"]): r for r in Q.rates(df).collect()}
    pdf = pd.DataFrame(rows, columns=["d", "site", "section", "p"]).fillna("~")
    whole = pdf["p"].mean()

    def strength(n, good, parent):
        m = good / n
        within = (n * m * (1 - m)).sum() / n.sum()
        spread = ((n * (m - parent) ** 2).sum() - (len(n) - 1) * within) / (n.sum() - (n * n).sum() / n.sum())
        return np.clip(within / spread if spread > 0 else Q.MOST_STRENGTH, Q.LEAST_STRENGTH, Q.MOST_STRENGTH)

    s = pdf.groupby("site")["p"].agg(["count", "sum"])
    k = strength(s["count"], s["sum"], whole)
    site = (k * whole + s["sum"]) / (k + s["count"])
    c = pdf.groupby(["site", "section"])["p"].agg(["count", "sum"])
    parent = site.reindex(c.index.get_level_values(0)).to_numpy()
    j = strength(c["count"], c["sum"], parent)
    want = (j * parent + c["sum"]) / (j + c["count"])
    assert len(got) == len(want)
    for (a, b), v in want.items():
        r = got[(None if a == "~" else a, None if b == "~" else b)]
        assert abs(r["section_rate"] - v) < 1e-9 and abs(r["site_rate"] - site[a]) < 1e-9
    assert abs(got[("rare", "y")]["section_rate"] - 0.01) > abs(got[("rare", "y")]["section_rate"] - whole) / 50  # shrunk towards the whole


def test_query_on_odd_tables(spark, tmp_path):
    good = "The river runs down to the sea. It is a calm day."
    rows = [(i, good + f" Number {i}." if i % 2 else "!!! *** $$$ ### " * 9, "en", "s", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", None, None), (None, good, "en", "s", None), (3, rows[3][1], "en", "s", 1), (102, good * 3000, "en", "t", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(7, None, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.op8_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert all(r["keep"] == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = Q.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").limit(0))
    empty = Q.evidence(docs.limit(0).withColumnsRenamed({"source": "site", "lang": "section"}), model)
    assert Q.judge(empty, Q.rates(empty), model).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = Q.train(docs, labels.where("pmod(doc_id, 2) = 0"))
    got = docs.join(labels.where("pmod(doc_id, 2) = 1"), "doc_id").select("text", "quality").toPandas()
    p = model.probability(got["text"].tolist())
    good, bad = p[got["quality"] == 1], p[got["quality"] == 0]
    print((good >= 0.5).mean(), (bad < 0.5).mean())
    assert (good >= 0.5).mean() > 0.98 and (bad < 0.5).mean() > 0.85
