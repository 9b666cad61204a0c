import hashlib
import random
import re

import numpy as np
import pytest

from tidewire.llm import decontaminate as D
from tidewire.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, names = set(), set()
    for name, item in items:
        v = words(item)
        for at in range(max(1, len(v) - 9) if v else 0):
            win = v[at : at + 10]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    if name is not None:
                        names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("seed", range(6))
def test_index_equals_scan(seed):
    rng = np.random.default_rng(seed)
    top = int(rng.integers(1, 5))
    text = np.append(rng.integers(0, top + 1, 400), 0)
    if seed == 0:
        text = np.append(np.ones(300, np.int64), 0)
    sa = suffix_array(text, top)
    key = lambda p: [(1, int(c)) if c else (0, i) for i, c in enumerate(text[p:], p)][: next((i for i, c in enumerate(text[p:]) if not c), 0) + 1]
    assert sa.tolist() == sorted(range(len(text)), key=key)
    index = FMIndex(text, top, step=5)
    patterns = [rng.integers(1, top + 1, rng.integers(1, 6)) for _ in range(60)]
    rows = np.zeros((60, 6), np.int64)
    for i, p in enumerate(patterns):
        rows[i, 6 - len(p) :] = p
    low, high = index.search(rows)
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p.tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def corpus(rng):
    vocab = ["a", "b", "C", "dé", "e1", "ß", "zz"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ".", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 25]) if k else 12)) for k in range(8)] + [(90, None), (91, " .,"), (None, text(4))]
    docs = [(i, text(rng.randint(0, 40)) + "\n" + (rng.choice(items)[1] or "") + " " + text(rng.randint(0, 40))) for i in range(40)]
    return docs + [(100, None), (101, ""), (102, "!!"), (3, docs[3][1]), (None, docs[0][1]), (103, "q " * 30000)], items


@pytest.mark.parametrize("block_words", [2_000_000, 3])
def test_documents_equal_brute_force(spark, block_words):
    docs, items = corpus(random.Random(5))
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(d, b, shard_words=50, block_words=block_words).collect()
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == want
    for r in got:  # spans hold the hit words and nothing else
        assert sum(len(words(r["text"][s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"]


def test_no_benchmark_no_documents(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.find_contamination(d, b.limit(0)).first()["n_hit"] == 0
    assert D.find_contamination(d.limit(0), b).count() == 0


def test_remove_spans(spark):
    d = spark.createDataFrame([(1, "éé Alpha beta gamma ω"), (2, None), (3, "none")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha BETA")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in D.remove_spans(D.find_contamination(d, b)).collect()}
    assert got == {1: "éé  gamma ω", 2: None, 3: "none"}


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "x y"), (2, "z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "x"), (9, "y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in D.op7_decontaminate(spark, str(tmp_path)).collect()}
    assert got[1]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and got[1]["n_items"] == 2
    assert got[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not got[2]["contaminated"]
