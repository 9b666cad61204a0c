"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut into chunks that no piece crosses (a run of spaces with the word behind it). The new chunks of a batch are
written one after another and their suffixes sorted; binary search gives every piece's range of occurrences, and the
occurrences sorted by position are the edges over each chunk. Relaxing the edges gives the encoding: for BPE models the
adjacent pair with the best edge is joined until none is left (leftmost first among equals), for unigram models the
best path is kept at each position. Characters without a piece become byte pieces, or the unknown piece.

Normalisation: spaces become U+2581 and one is put in front. Null and empty texts have no tokens. U+2581 itself decodes
to a space.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SHIFT = 32


@dataclass
class Vocabulary:
    """pieces: UTF-8 of the ordinary pieces -> id; scores by id; byte_ids: id of each byte piece, or empty."""

    pieces: dict[bytes, int]
    scores: dict[int, float]
    byte_ids: list[int]
    unknown: int
    kind: str = "bpe"
    tables: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Vocabulary:
        """From a model file, read on the driver; the vocabulary's size bounds what tasks get."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        plain = {m.id_to_piece(i).encode(): i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        return cls(plain, {i: m.get_score(i) for i in plain.values()}, [i for i in ids if m.is_byte(i)], m.unk_id(), kind)

    def prepare(self) -> dict:
        if not self.tables:
            names = sorted(self.pieces)
            order = sorted({-s for s in self.scores.values()})
            place = {s: k for k, s in enumerate(order)}
            loose = "".join(c for c in "\n\t\r" if not any(c.encode() in p for p in names))
            if any(re.search(f"[^{SPACE}]{SPACE}", p.decode()) for p in names):
                raise ValueError("a piece goes on behind a space, so chunks can't be cut there")
            # no piece goes on from a letter into these, so a chunk ends there
            into = {b for p in names for a, b in zip(p.decode(), p.decode()[1:], strict=False) if a.isalpha()}
            stops = re.escape("".join(sorted(set(".,;:!?*&$%#\"|") - into)) or "\0")
            run = rf"(?:[^{SPACE}{loose}{stops}]+|(?<![^\W\d_])[{stops}])"
            levels = -(-max(map(len, names), default=1) // 8)
            width = levels * 8
            pad = lambda c: np.frombuffer(b"".join(p.ljust(width, c) for p in names), ">u8").astype(np.uint64).reshape(-1, levels)
            show = {i: p.replace(SPACE.encode(), b" ") for p, i in self.pieces.items()}
            show |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
            listed = [show.get(i, b"") for i in range(max(show, default=-1) + 1)] + [b""]
            sizes = np.array([len(x) for x in listed])
            self.tables = {
                "rank": np.array([place[-self.scores[self.pieces[p]]] for p in names], np.int64),
                "score": np.array([self.scores[self.pieces[p]] for p in names]),
                "id": np.array([self.pieces[p] for p in names], np.int64),
                "length": np.array([len(p) for p in names], np.int64),
                "low": pad(b"\x00"),
                "high": pad(b"\xff"),
                "levels": levels,
                "chunk": re.compile(rf"{SPACE}*{run}+|(?<=[^\W\d_])[{stops}]{run}*|{SPACE}+" + (f"|[{loose}]" if loose else "")),
                "show_size": sizes,
                "show_start": np.cumsum(sizes) - sizes,
                "show_bytes": np.frombuffer(b"".join(listed), np.uint8),
            }
        return self.tables


def suffixes(text: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by the first 8 * levels bytes, and the 8 bytes (big-endian) at each position of the padded text."""
    n = len(text)
    padded = np.zeros(n + 8 * levels + 8, np.uint64)
    padded[:n] = text
    keys = np.zeros(n + 8 * levels, np.uint64)
    for j in range(8):
        keys = (keys << np.uint64(8)) | padded[j : j + len(keys)]
    order = np.argsort(keys[:n])
    group = np.cumsum(np.concatenate([[0], keys[order[1:]] != keys[order[:-1]]])) if n else order
    for level in range(1, levels):
        same = np.zeros(n, bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        rows = np.flatnonzero(same)
        if not len(rows):
            break
        at = order[rows]
        by = np.lexsort((keys[at + 8 * level], group[rows]))
        order[rows] = at[by]
        change = np.zeros(n, bool)
        change[1:] = group[1:] != group[:-1]
        change[1:] |= keys[order[1:] + 8 * level] != keys[order[:-1] + 8 * level]
        group = np.cumsum(change)
    return order, keys


def edges(text: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Position and piece (its place in the sorted pieces) of all occurrences, by position and then length."""
    t = v.prepare()
    order, keys = suffixes(text, t["levels"])
    first = keys[order]
    low = np.searchsorted(first, t["low"][:, 0], "left")
    high = np.searchsorted(first, t["high"][:, 0], "right")
    for k in np.flatnonzero((t["length"] > 8) & (high > low)):
        for level in range(1, -(-int(t["length"][k]) // 8)):
            part = keys[order[low[k] : high[k]] + 8 * level]
            low[k], high[k] = low[k] + np.searchsorted(part, t["low"][k, level], "left"), low[k] + np.searchsorted(part, t["high"][k, level], "right")
    count = np.maximum(high - low, 0)
    piece = np.repeat(np.arange(len(count)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = order[rows]
    by = np.argsort(at * (int(t["length"].max(initial=0)) + 1) + t["length"][piece])
    return at[by], piece[by]


def join_pairs(bounds: list[int], ranks: dict[int, int]) -> list[int]:
    """BPE: joins the adjacent pair of least rank, then the leftmost, until no pair has an edge."""
    if len(bounds) < 48:
        while True:
            best, place = None, 0
            for i in range(len(bounds) - 2):
                r = ranks.get(bounds[i] << _SHIFT | bounds[i + 2])
                if r is not None and (best is None or r < best):
                    best, place = r, i
            if best is None:
                return bounds
            del bounds[place + 1]
    after, before = dict(zip(bounds, bounds[1:], strict=False)), dict(zip(bounds[1:], bounds, strict=False))
    heap = [(r, a, m, e) for a, m, e in zip(bounds, bounds[1:], bounds[2:], strict=False) if (r := ranks.get(a << _SHIFT | e)) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, m, e = heapq.heappop(heap)
        if after.get(a) != m or after.get(m) != e:
            continue
        after[a], before[e] = e, a
        del after[m]
        for x, y, z in ((before.get(a), a, e), (a, e, after.get(e))):
            if x is not None and z is not None and (r := ranks.get(x << _SHIFT | z)) is not None:
                heapq.heappush(heap, (r, x, y, z))
    out = [bounds[0]]
    while out[-1] in after:
        out.append(after[out[-1]])
    return out


def best_path(bounds: list[int], scores: dict[int, float], lowest: float) -> list[int]:
    """Unigram: relaxes the edges by position; a character without a piece costs the lowest score less 10."""
    by_start: dict[int, list[tuple[int, float]]] = {}
    for k, s in scores.items():
        by_start.setdefault(k >> _SHIFT, []).append((k & (1 << _SHIFT) - 1, s))
    best, back = {bounds[0]: 0.0}, {}
    for a, e in zip(bounds, bounds[1:], strict=False):
        for to, s in [*by_start.get(a, []), *([] if (a << _SHIFT | e) in scores else [(e, lowest - 10)])]:
            if to not in best or best[a] + s > best[to]:
                best[to], back[to] = best[a] + s, a
    out = [bounds[-1]]
    while out[-1] != bounds[0]:
        out.append(back[out[-1]])
    return out[::-1]


def join_all(text: np.ndarray, keys: np.ndarray, ranks: np.ndarray, width: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """join_pairs over many chunks [begin, end) at once, a pair of each chunk a round: starts and stops of the tokens, by position.

    keys: position * width + length of each edge, sorted; ranks: their ranks.
    """
    none = np.iinfo(np.int64).max

    def rank(a: np.ndarray, e: np.ndarray) -> np.ndarray:
        size = e - a
        at = np.searchsorted(keys, a * width + size)
        at[at == len(keys)] = 0
        return np.where((size < width) & (keys[at] == a * width + size), ranks[at], none) if len(keys) else np.full(len(a), none)

    inside = np.zeros(len(text) + 1, np.int64)
    inside[begin] += 1
    inside[end] -= 1
    start = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & (text & 0xC0 != 0x80))
    chunk = np.searchsorted(begin, start, side="right") - 1
    stop = np.append(start[1:], 0)
    last = np.append(chunk[1:] != chunk[:-1], True) if len(chunk) else np.empty(0, bool)
    stop[last] = end[chunk[last]]
    best = np.full(len(start), none)
    best[~last] = rank(start[~last], stop[np.flatnonzero(~last) + 1])
    starts, stops = [], []
    while len(start):
        first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        size = np.diff(np.append(first, len(start)))
        least = np.repeat(np.minimum.reduceat(best, first), size)
        done = least == none
        if done.any():
            starts.append(start[done])
            stops.append(stop[done])
            start, stop, chunk, best, least = start[~done], stop[~done], chunk[~done], best[~done], least[~done]
            if not len(start):
                break
        here = np.flatnonzero(best == least)
        here = here[np.append(True, chunk[here[1:]] != chunk[here[:-1]])]  # the leftmost of each chunk
        stop[here] = stop[here + 1]
        keep = np.ones(len(start), bool)
        keep[here + 1] = False
        moved = here - np.arange(len(here))  # places after the joined halves are gone
        start, stop, chunk, best = start[keep], stop[keep], chunk[keep], best[keep]
        touched = np.zeros(len(start), bool)
        touched[moved] = True
        touched[moved[moved > 0] - 1] = True
        again = np.flatnonzero(touched)
        inner = again[again + 1 < len(start)]
        inner = inner[chunk[inner] == chunk[inner + 1]]
        best[again] = none
        best[inner] = rank(start[inner], stop[inner + 1])
    a, e = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, stops))
    order = np.argsort(a, kind="stable")
    return a[order], e[order]


def encode_chunks(chunks: list[str], v: Vocabulary) -> list[bytes]:
    """The ids of each chunk, as little-endian 32-bit integers."""
    if not chunks:
        return []
    t = v.prepare()
    raw = [c.encode() for c in chunks]
    text = np.frombuffer(b"\xff".join(raw), np.uint8)  # no piece has the byte FF
    at, piece = edges(text, v)
    size = np.array([len(r) for r in raw])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    width = int(t["length"].max(initial=0)) + 1
    keys = at * width + t["length"][piece]
    short = size < 64 if v.kind == "bpe" else np.zeros(len(raw), bool)
    starts, stops = join_all(text, keys, t["rank"][piece], width, begin[short], (begin + size)[short])
    for k in np.flatnonzero(~short).tolist():
        lo, hi = np.searchsorted(keys, [begin[k] * width, (begin[k] + size[k]) * width])
        a = keys[lo:hi] // width - begin[k]
        own = (a << _SHIFT | (a + keys[lo:hi] % width)).tolist()
        bounds = [i for i, b in enumerate(raw[k]) if b & 0xC0 != 0x80] + [len(raw[k])]
        if v.kind == "bpe":
            bounds = join_pairs(bounds, dict(zip(own, t["rank"][piece[lo:hi]].tolist(), strict=True)))
        else:
            bounds = best_path(bounds, dict(zip(own, t["score"][piece[lo:hi]].tolist(), strict=True)), float(t["score"].min()))
        starts, stops = np.append(starts, np.array(bounds[:-1], np.int64) + begin[k]), np.append(stops, np.array(bounds[1:], np.int64) + begin[k])
    if not short.all():
        order = np.argsort(starts, kind="stable")
        starts, stops = starts[order], stops[order]
    # the id of each token; one without a piece gives the ids of its bytes, or the unknown id
    place = np.searchsorted(keys, starts * width + stops - starts)
    place[place == len(keys)] = 0
    known = (stops - starts < width) & (keys[place] == starts * width + stops - starts) if len(keys) else np.zeros(len(starts), bool)
    count = np.where(known | (not v.byte_ids), 1, stops - starts)
    ids = np.repeat(np.where(known, t["id"][piece[place]], v.unknown) if len(keys) else np.full(len(starts), v.unknown), count)
    if v.byte_ids:
        lost = np.repeat(~known, count)
        source = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
        ids[lost] = np.array(v.byte_ids)[text[source[lost]]]
    cuts = np.append(0, np.cumsum(count))[np.searchsorted(starts, np.append(begin, len(text) + 1))] * 4
    flat = ids.astype("<i4").tobytes()
    return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Encoder:
    """Keeps the encodings of up to `kept` short chunks."""

    def __init__(self, v: Vocabulary, kept: int = 300_000):
        self.v, self.kept, self.cache = v, kept, {}

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        find = self.v.prepare()["chunk"].findall
        split = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        seen: set[str] = set().union(*split)
        new = [c for c in seen if c not in self.cache]
        if len(self.cache) + len(new) > self.kept:
            self.cache.clear()
            new = list(seen)
        self.cache.update(zip(new, encode_chunks(new, self.v), strict=True))
        got = [np.frombuffer(b"".join(map(self.cache.__getitem__, cs)), "<i4") for cs in split]
        for c in new:
            if len(c) > 64:
                del self.cache[c]
        return got


_ENCODER: list[Encoder] = []


def worker_encoder(v: Vocabulary) -> Encoder:
    """The worker process's encoder: tasks that run in it one after another share what it keeps."""
    if not _ENCODER or _ENCODER[0].v != v:
        _ENCODER[:] = [Encoder(v)]
    return _ENCODER[0]


def decode_flat(flat: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> list[str]:
    """The text of each range of ids. Ids that are no piece (control ids, or out of range) give nothing, bytes that are no UTF-8 give U+FFFD."""
    t = v.prepare()
    top = len(t["show_size"]) - 1  # its last row is empty
    ids = np.where((flat >= 0) & (flat < top), flat, top)
    size = t["show_size"][ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = t["show_bytes"][np.arange(int(ends[-1])) - np.repeat(ends[:-1] - t["show_start"][ids], size)].tobytes()
    cuts = ends[offsets].tolist()
    texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [x[1:] if x[:1] == " " else x for x in texts]


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    return decode_flat(np.array(ids, np.int64), np.array([0, len(ids)]), v)[0]


def _with(docs: DataFrame, name: str, kind: str) -> tuple[DataFrame, T.StructType]:
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != name))
    return docs, T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"{name} {kind}").fields])


def encode(docs: DataFrame, v: Vocabulary, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds the ids of every row's whole text; a column of that name is replaced.

    Null and empty texts have no ids. Rows, repeated ones too, and other columns are kept. Long texts are encoded in
    chunks that end at spaces, with ids as if in one. Equal merges go to the leftmost. An empty table gives no rows.
    """
    docs, schema = _with(docs, out, "array<int>")
    place, names = docs.columns.index(text), schema.names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(v)
        for batch in it:
            at, texts = 0, batch.column(place).to_pylist()
            while at < len(texts):  # about half a million characters at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") < 1 << 19):
                    size += len(texts[to] or "")
                    to += 1
                ids = encoder(texts[at:to])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.int32())
                values = pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, pa.ListArray.from_arrays(offsets, values)], names=names)
                at = to

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, v: Vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the text of every row's ids; null ids give an empty text."""
    docs, schema = _with(docs, out, "string")
    place, names = docs.columns.index(ids), schema.names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                column = batch.column(place)
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                flat = pc.fill_null(pc.list_flatten(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = decode_flat(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), v)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return docs.mapInArrow(run, schema)


def op10_sentencepiece(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document's ids and what they decode to; see encode and decode for nulls, repeated rows and long texts."""
    v = Vocabulary.load(model)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs, v), v)
    return both.select("doc_id", F.size("token_ids").alias("n_tokens"), F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), SPACE, " ")).alias("round_trip"))
