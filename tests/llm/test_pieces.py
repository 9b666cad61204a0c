import hashlib
import itertools
import os
import random

import numpy as np
import pytest

from tidewire.llm import pieces
from tidewire.llm.pieces import SPACE, Vocabulary

MODEL = os.environ.get("TIDEWIRE_PIECES", pieces.MODEL)
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
EDGE = ["", None, " ", "a  b", " a", "a\nb\n\n c", "\t x", "ﬁ Ａ", "日本語", "\x00a", "a▁b", "x" * 3000, " x", "the " * 5000, "éé", "\U0001f600 ok", "    four"]


def small(kind):
    names = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "aa", "cab", "abcabcabc", "abcabcabca", "é", "aé"]
    return Vocabulary({n.encode(): i + 300 for i, n in enumerate(names)}, {i + 300: -float((i * 7) % 11) for i in range(len(names))}, list(range(256)), 299, kind)


def test_edges_are_all_occurrences():
    v = small("bpe")
    names = sorted(v.pieces)
    text = "▁abcabcabcabc\xff".encode() + "aaé".encode() + b"\xff"
    at, piece = pieces.edges(np.frombuffer(text, np.uint8), v)
    got = sorted(zip(at.tolist(), (names[p] for p in piece), strict=True))
    assert got == sorted((i, n) for n in names for i in range(len(text)) if text.startswith(n, i))
    assert at.tolist() == sorted(at.tolist())


def test_unigram_is_the_best_path():
    v = small("unigram")
    rng = random.Random(4)
    lowest = min(v.scores.values())
    for _ in range(60):
        chunk = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
        raw, best = chunk.encode(), -1e9
        chars = list(chunk)
        for cuts in itertools.product([0, 1], repeat=len(chars) - 1):
            parts, now = [], chars[0]
            for c, cut in zip(chars[1:], cuts, strict=True):
                if cut:
                    parts.append(now)
                    now = c
                else:
                    now += c
            parts.append(now)
            if all(p.encode() in v.pieces or len(p) == 1 for p in parts):
                best = max(best, sum(v.scores[v.pieces[p.encode()]] if p.encode() in v.pieces else lowest - 10 for p in parts))
        ids = np.frombuffer(pieces.encode_chunks([chunk], v)[0], "<i4").tolist()
        assert pieces.decode_ids(ids, v) == chunk and raw
        assert sum(v.scores.get(i, 0) for i in ids) >= best - 1e-9 or any(i < 256 for i in ids)


def test_long_and_short_joining_agree():
    v = small("bpe")
    rng = random.Random(1)
    for _ in range(40):
        chunk = "".join(rng.choice("abc") for _ in range(rng.randint(50, 90)))
        raw = chunk.encode()
        at, piece = pieces.edges(np.frombuffer(raw, np.uint8), v)
        t = v.prepare()
        ranks = {int(a) << 32 | int(a + t["length"][p]): int(t["rank"][p]) for a, p in zip(at, piece, strict=True)}
        slow = list(range(len(raw) + 1))
        while pairs := [(r, i) for i in range(len(slow) - 2) if (r := ranks.get(slow[i] << 32 | slow[i + 2])) is not None]:
            del slow[min(pairs)[1] + 1]
        assert pieces.join_pairs(list(range(len(raw) + 1)), ranks) == slow


@needs_model
def test_ids_equal_the_library():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    v = Vocabulary.load(MODEL)
    rng = random.Random(7)
    texts = EDGE + ["".join(rng.choice(["the", "on", "é", " ", "  ", "\n", "ing", "日", "!", "tion", "Z", "ß", "0"]) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    encoder = pieces.Encoder(v, kept=500)
    for at in range(0, len(texts), 40):
        for t, ids in zip(texts[at : at + 40], encoder(texts[at : at + 40]), strict=True):
            assert ids.tolist() == m.encode(t or ""), t
            assert pieces.decode_ids(ids.tolist(), v) == (t or "").replace(SPACE, " ")


@needs_model
def test_query_round_trip(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(EDGE)] + [(None, "null id", None), (1, None, None), (1, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, token_ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pieces.op10_sentencepiece(spark, str(tmp_path), MODEL).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert {r["decoded_sha256"] for r in got if r["doc_id"] == 3} == {hashlib.sha256(b"a  b").hexdigest()}
    assert pieces.encode(spark.createDataFrame([], "text string, token_ids int"), Vocabulary.load(MODEL)).count() == 0
