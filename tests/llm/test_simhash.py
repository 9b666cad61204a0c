import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tidewire.llm import simhash
from tidewire.llm.components import components


def brute_print(text, words=3):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints, max_bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = sorted(prints)
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= max_bits:
                root[find(b)] = find(a)
    return {p: find(p) for p in ps}


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "a B", "A b\x0bC d", "é x É y", "w " * 3000])
def test_fingerprint(text):
    got = simhash.majority(simhash.shingle_hashes(text, 3)) & (1 << 64) - 1
    assert got == brute_print(text)


def test_plan_thresholds_cover():
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**10):
        bits = rng.random((500, 64)) < rng.random(64)
        counts = (bits.T.astype(float) @ bits) * n / 500
        for max_bits in (0, 1, 2, 3):
            parts = simhash.plan(n, counts, max_bits)
            seen = sorted(b for p, _ in parts for b in p)
            assert len(seen) == len(set(seen)) <= 64
            assert sum(t + 1 for _, t in parts) == max_bits + 1  # so more differing bits are needed to miss all parts


@pytest.mark.parametrize("max_bucket", [2, 128])
@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_components_equal_brute_force(spark, max_bits, max_bucket):
    rng = random.Random(max_bits)
    prints = {0}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
            base = x if rng.random() < 0.2 else base
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    got = {r["node"]: r["root"] for r in components(simhash.links(df, max_bits, max_bucket)).collect()}
    want = brute_components([p & (1 << 64) - 1 for p in signed], max_bits)
    a = {}
    for p in signed:
        a.setdefault(got.get(p, p), set()).add(p & (1 << 64) - 1)
    b = {}
    for p, r in want.items():
        b.setdefault(r, set()).add(p)
    assert sorted(map(sorted, a.values())) == sorted(map(sorted, b.values()))


def test_documents(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "x"), (3, text, "x"), (9, text.upper(), None), (4, "other words here now", None), (7, None, None), (8, "  ", None), (None, text, None), (1, "é " * 20000, None), (3, text, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_components(df).collect()]
    assert sorted(got, key=str) == sorted([(i, brute_print(t), {5: 3, 3: 3, 9: 3, None: 3, 4: 4, 7: 7, 8: 7, 1: 1}[i]) for i, t, _ in rows], key=str)
    assert simhash.near_components(df.limit(0)).count() == 0


def test_components_of_shapes(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame([*path, *star, (5, 5), (7, 6), (None, 3)], "a long, b long")
    got = components(df).collect()
    assert len(got) == len({r["node"] for r in got}) == 301 + 300
    assert len({r["root"] for r in got if r["node"] < 1000}) == 1 == len({r["root"] for r in got if r["node"] >= 1000})
