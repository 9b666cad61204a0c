import hashlib
import random

import numpy as np
import pytest

from tidewire.llm import ibf


@pytest.mark.parametrize("seed", range(4))
def test_peeling_recovers_set_differences(seed):
    rng = np.random.default_rng(seed)
    left, right = [], []
    for n in (0, 1, 5, 40, 700):
        both = rng.integers(0, 1 << 63, n, np.uint64)
        left.append(np.unique(np.append(both, rng.integers(0, 1 << 63, rng.integers(0, 300), np.uint64))))
        right.append(np.unique(np.append(both, rng.integers(0, 1 << 63, rng.integers(0, 9), np.uint64))))
    for a, b, (x, y) in zip(left, right, ibf.differences(left, right), strict=True):
        assert set(x.tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(y.tolist()) == set(b.tolist()) - set(a.tolist())


def test_fingerprint_is_of_the_text():
    texts = ["", "One. Two.\nThree", "One. Two.\nThree", "One. Two.\nThree. One.", "One. Two. Two.", "é" * 5000]
    prints = ibf.fingerprints([ibf.digests(t) for t in texts])
    assert prints[1] == prints[2] and len(set(prints)) == 5
    own = [ibf.digests(t) for t in texts]
    assert ibf.likeness(own, own) == [1.0] * 6


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, __import__("xxhash").xxh64_intdigest((r[1] or "").encode()) - (1 << 63)))
    out = []
    for i, (key, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        sets = [set(ibf.digests(x).tolist()) for x in (t, edited, nxt)]
        near = lambda a, b: 1 - len(a ^ b) / max(1, len(a) + len(b))
        out.append((key, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(sets[0], sets[1]), 9), round(near(sets[0], sets[2]), 9)))
    return sorted(out, key=str)


def test_documents_equal_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice(["wörd ", "x", ". ", "\n", "so! ", "日本 "]) for _ in range(n))
    rows = [(rng.randrange(10**6) - 5 * 10**5, text(rng.choice([0, 3, 30, 300]))) for _ in range(150)] + [(None, "a b c d"), (None, None), (7, None), (7, ""), (7, text(50)), (10**12, text(40000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = ibf.compare_successors(df).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=str) == brute(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert ibf.compare_successors(df).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert ibf.compare_successors(df.limit(0)).count() == 0
