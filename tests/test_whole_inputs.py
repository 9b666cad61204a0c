"""Queries read whole inputs: no prefixes, key blocks or filters that the operator doesn't have."""

import numpy as np
import pytest

from tidewire.operators import dedup as D
from tidewire.plans import contracts, lookups, measures


@pytest.fixture
def tables(monkeypatch):
    held = {}
    for m in (contracts, lookups, measures):
        monkeypatch.setattr(m, "table", lambda spark, d, name: held[name])
    return held


def test_cosine_pairs_equal_brute_force(spark, tables):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 8))
    m[7] = 0
    df = spark.createDataFrame([(int(i), f"l{i % 3}", [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, label string, embedding array<float>").repartition(3)
    unit = m.astype(np.float32).astype(float)
    with np.errstate(invalid="ignore"):
        c = unit @ unit.T / np.outer(*[np.linalg.norm(unit, axis=1)] * 2)
    want = {(i, j): c[i, j] for i in range(90) for j in range(i + 1, 90) if c[i, j] >= 0.15}
    for block in (16, 1024):
        got = {(r["left"], r["right"]): r["cosine"] for r in D.cosine_pairs(df, "vec_id", "embedding", 0.15, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    tables["embeddings"] = df
    assert {(r["vec_id"], r["other"]) for r in lookups.cosine_pairs_threshold(spark, "").collect()} == {k for k, v in want.items() if round(v, 6) >= 0.15}


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 100) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")


def test_topics_of_whole_texts(spark, tables):
    tables["documents"] = docs(spark, ["a b " * 200 + "schule"])
    assert [r["topics"] for r in contracts.topics_by_rule(spark, "").collect()] == ["german"]


def test_titles_are_whole_first_lines(spark, tables):
    tables["documents"] = docs(spark, ["a" * 40 + " one\nx", "a" * 40 + " two\ny", "a" * 40 + " one\nz"])
    assert {r["doc_id"] for r in lookups.or_key_dedup_fold(spark, "").collect() if r["kept"]} == {0, 1}
    tables["documents"] = docs(spark, ["a" * 60 + "0123456789" * 10, "a" * 60 + "ZYXWVUTSRQ" * 10])
    assert {r["doc_id"] for r in lookups.greedy_title_dedup(spark, "").collect() if r["kept"]} == {0, 1}


def test_whole_questions(spark, tables):
    said = ["b" * 30 + " first?", "b" * 30 + " second?", "b" * 30 + " first?"]
    tables["conversations"] = spark.createDataFrame([(i, 1, "user", t) for i, t in enumerate(said)], "conv_id long, turn int, role string, text string")
    assert sorted((r["conv_id"], r["question"]) for r in measures.open_questions_first(spark, "").collect()) == [(0, said[0]), (1, said[1])]


def test_all_tokens_are_aliases(spark, tables):
    tables["benchmark"] = spark.createDataFrame([(1, "station reactor turbine harbour")], "item_id long, text string")
    tables["documents"] = docs(spark, ["a harbour"])
    assert [r["entity_id"] for r in lookups.entity_mentions(spark, "").collect()] == ["e-harbour"]


def test_pair_features_read_all_words(spark, tables):
    opening = "one two three four five six seven eight "
    tables["documents"] = docs(spark, [opening + "transformer harbour", "ein zwei drei vier funf sechs sieben acht transformation harbour"])
    assert [(r["doc_id"], r["shared"], r["jaccard"]) for r in lookups.pair_features(spark, "").collect()] == [(0, 2, round(2 / 18, 6))]


def test_candidate_pairs_of_all_priorities(spark, tables):
    tables["orders"] = spark.sql("select * from values (1, 7, '2020-01-01', '1-URGENT', 'O'), (2, 7, '2020-01-05', '5-LOW', 'O'), (3, 7, '2020-01-09', '5-LOW', 'F') t(o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_orderstatus)")
    assert sorted((r["left"], r["right"]) for r in lookups.candidate_pairs_scored(spark, "").collect()) == [(1, 2), (1, 3), (2, 3)]
