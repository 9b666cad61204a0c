import random
import zlib

import numpy as np
import pytest

from tidewire.llm import language_id as L

ALPHABETS = {"aa": ["ba", "bo", "bi"], "bb": ["kéé", "ku", "kö"], "cc": ["sta", "sto", "str"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, text(rng, lang, rng.choice([1, 5, 80])), lang) for i, lang in enumerate(rng.choice(sorted(ALPHABETS)) for _ in range(400))]


def test_held_out_accuracy_and_edges(spark, rows, tmp_path):
    extra = [(9001, None, "aa"), (9002, "", None), (9003, "123 …", "bb"), (9004, "BA BO bi", None), (None, "ba bo", "aa"), (9005, "ba " * 60000, None), (1, rows[1][1], rows[1][2]), (9006, text(random.Random(1), "aa", 60) + " " + text(random.Random(2), "cc", 30), None)]
    spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op3_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert out and all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([by[i]["lang_pred"] == rows[i][2] for i in out]) > 0.97
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert by[9004]["lang_pred"] == by[9005]["lang_pred"] == by[None]["lang_pred"] == "aa" and not by[None]["held_out"]
    mixed = {x["lang"]: x["share"] for x in by[9006]["langs"]}
    assert set(mixed) == {"aa", "cc"} and abs(mixed["aa"] - 2 / 3) < 0.08
    assert all(0 <= r["score"] <= 1 for r in got)


def test_unlabelled_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab", None)], "doc_id long, text string, lang string")
    assert L.identify(docs, L.train(docs)).first()["lang_pred"] == "und"
    assert L.identify(docs.limit(0), L.train(docs)).count() == 0


def test_word_scores_are_sums_of_ngrams():
    rng = np.random.default_rng(1)
    model = L.Model(["x", "y"], rng.random((len(L.ORDERS) * L.BUCKETS, 2)))
    data, begin, length, doc = L.words(["Abc é", "", "d"])
    assert doc.tolist() == [0, 0, 2]
    codes = L._codes(data)
    for b, n, s in zip(begin, length, model.word_scores(data, begin, length), strict=True):
        want = sum(model.table[codes[k, i]] for k, o in enumerate(L.ORDERS) for i in range(b, b + n - o + 1))
        assert np.allclose(s, want)
