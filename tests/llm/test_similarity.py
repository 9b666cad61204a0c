import random

import numpy as np

from tidewire.llm import simhash


def sets(text, words=5):
    w = text.lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, similarity=0.8):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [sets(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= similarity * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, least.get(find(i), k)) for i, (k, _) in enumerate(rows)), key=str)


def corpus(rng):
    rows = []
    word = lambda: f"w{rng.randrange(5000)}"
    for g in range(12):
        base = [word() for _ in range(rng.choice([8, 60, 300]))]
        for c in range(rng.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2]) * len(base) // 100):
                copy[rng.randrange(len(copy))] = word()
            rows.append((g * 100 + c, " ".join(copy)))
    passage = " ".join(word() for _ in range(60))  # shared by otherwise different texts
    return rows + [(5000 + i, " ".join(word() for _ in range(200)) + " " + passage) for i in range(30)]


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    rows = corpus(rng) + [(9000, None), (9001, ""), (9002, "  "), (9003, "Two words"), (9004, "two WORDS"), (0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string").repartition(4)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar_components(df).collect()), key=str)
    assert got == brute(rows)


def test_keep_one_keeps_columns_nulls_and_clean_documents(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(1, "a b c d e f", "p"), (2, "a b c d e f", "q"), (2, "a b c d e f", "q"), (3, "x y z", None), (None, "a b c d e f", "n"), (4, None, "m"), (5, long, "l"), (6, long + " end", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 3, 4, 5, None]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_partial_prints_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(2)
    agree = 0
    for _ in range(40):
        both = rng.integers(0, 1 << 63, 160, np.uint64)
        a, b = (np.unique(np.append(both, rng.integers(0, 1 << 63, 20, np.uint64))) for _ in range(2))
        agree += sum(x == y for x, y in zip(simhash.partial_prints(a, 12), simhash.partial_prints(b, 12), strict=True))
    assert 0.35 < agree / 480 < 0.65  # about 0.8 cubed


def edited(rng, base, edits):
    """Replaces single words far apart, so that each costs five shingles."""
    out = list(base)
    for at in rng.sample(range(5, len(base) - 5, 6), edits):
        out[at] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def test_star_of_edited_copies_equals_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, edited(rng, base, 5)) for i in range(400)] + [(400, " ".join(base))]  # 0.84 to the original, 0.71 to one another
    passage = " ".join(f"p{i}" for i in range(150))
    for g in range(150):  # documents of one long passage, each with one edited copy
        own = [f"x{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(1000 + 2 * g, passage + " " + " ".join(own)), (1001 + 2 * g, passage + " " + edited(rng, own, 5))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar_components(df).collect()), key=str)
    assert got == brute(rows)
    assert sum(k == c for k, c in got) == 151
