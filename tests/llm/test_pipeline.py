import random

import pytest

import corpus_pipeline as P

LANGS = {"en": ["the", "ing", "on", "er", "and"], "de": ["sch", "ung", "ein", "für", "keit"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    for i in range(160):
        lang = "de" if i % 4 == 0 else "en"
        bad = i % 5 == 4
        text = " ".join(sentence(rng, lang, 12) for _ in range(rng.randint(1, 12)))
        if bad:
            text = " ".join(w + rng.choice(["***", "&&&", "$$$"]) for w in text.split())
        rows.append([i, text, lang, f"src{i % 3}", len(text)])
        labels.append((i, 0 if bad else 1, 0))
    passage = " ".join(sentence(rng, "en", 12) for _ in range(3))
    rows[1][1] += " " + passage
    rows.append([500, rows[2][1], "en", "src2", 9])  # exact copy
    rows.append([501, rows[3][1].replace(" ", "  ", 1), "en", "src0", 9])  # near copy
    rows.append([502, passage, "en", "src0", 9])  # nothing but benchmark
    rows.append([503, "1234 5678", None, None, 9])
    rows.append([504, None, None, None, None])
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, passage


def test_stages_take_effect(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, path), "test")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert len(seen[name]) == docs.count()
    good = {i for i in range(160) if i % 5 != 4}
    assert set(seen["language ID"]) == {r[0] for r in rows} - {503, 504}
    assert set(seen["quality classifier"]) == good | {500, 501, 502}
    assert set(seen["SimHash near-dedup"]) == good | {502}
    assert set(seen["benchmark decontamination"]) == good
    cut = seen["benchmark decontamination"][1]
    assert passage.rstrip(".") not in cut["text"] and cut["n_chars"] == len(cut["text"]) and rows[1][1].startswith(cut["text"].rstrip(" ."))
    assert all(seen["benchmark decontamination"][i]["text"] == rows[i][1] for i in good - {1})
    last = seen["SentencePiece encoding"]
    assert set(last) == good and all(len(r["token_ids"]) == r["n_tokens"] > 0 for r in last.values())


def test_empty_table(spark, folder, tmp_path):
    path = folder[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
