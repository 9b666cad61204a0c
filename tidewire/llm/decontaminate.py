"""Benchmark decontamination by an FM-index over each shard of the training documents.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of all code points from U+0080. A benchmark item gives
all windows of 10 consecutive words, or one window of all its words if it has fewer. A shard is the next million words
of a task's rows: words that no window has become separators, runs of the others that are shorter than the shortest
window are left out (no window fits them), the rest is indexed, and all windows are searched backwards at once. Each
occurrence is located and its words are marked; marked neighbours merge into removal spans.

Words are compared by 64-bit hash and length. Whole texts are used. The benchmark is taken in blocks of bounded size: one
goes to the tasks with the plan, more are files in the shared folder that a task reads one after another for each shard,
so neither what is sent to a task nor what it holds grows, and the documents are read once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import scratch, without
from tidewire.llm.fm_index import FMIndex

WINDOW = 10
_CLASS = np.array([0 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """64-bit hashes of the words of a byte string; block bounds the memory."""

    def __init__(self, size: int = 1 << 20):
        self.size = size
        self.up, self.down = _powers(_BASE, size + 1), _powers(pow(_BASE, -1, 1 << 64), size + 1)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, begin and end (in bytes) of each word."""
        if len(data) > self.size:
            self.__init__(1 << (len(data) - 1).bit_length())
        cls = _CLASS[np.frombuffer(data, np.uint8)]
        edge = np.diff(np.concatenate([[False], cls > 0, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(cls) + 1, np.uint64)
        np.cumsum(_BYTE[cls] * self.up[: len(cls)], out=sums[1:])
        value = (sums[end] - sums[begin]) * self.down[begin]
        return value ^ ((end - begin).astype(np.uint64) << np.uint64(48)), begin, end


class Windows:
    """The windows of a block of items, as rows of word numbers (1 up; the vocabulary is this block's)."""

    def __init__(self, items: list[tuple[str, str]]):
        hasher = _Hasher()
        words = [hasher((text or "").encode())[0] for _, text in items]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *words]))
        rows, self.item, self.length = [], [], []
        for k, w in enumerate(words):
            number = np.searchsorted(self.vocabulary, w).astype(np.int64) + 1
            for at in range(max(1, len(w) - WINDOW + 1) if len(w) else 0):
                row = np.zeros(WINDOW, np.int64)
                part = number[at : at + WINDOW]
                row[WINDOW - len(part) :] = part
                rows.append(row)
                self.item.append(k)
                self.length.append(len(part))
        self.rows = np.array(rows, np.int64).reshape(-1, WINDOW)
        self.item, self.length = np.array(self.item, np.int64), np.array(self.length, np.int64)
        self.names = [i for i, _ in items]
        self.shortest = int(self.length.min()) if len(rows) else 0


def match_shard(numbers: np.ndarray, doc: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """numbers: word numbers of a shard (0: in no window), doc: their documents -> mask of hit words, distinct (doc, item) pairs."""
    n = len(numbers)
    hit, pairs = np.zeros(n, bool), np.empty((0, 2), np.int64)
    if not n or not windows.shortest:
        return hit, pairs
    cut = np.ones(n, bool)  # a run begins here, or a word that is in no window stands here
    cut[1:] = (numbers[1:] == 0) | (numbers[:-1] == 0) | (doc[1:] != doc[:-1])
    begins = np.flatnonzero(cut)
    lengths = np.diff(np.append(begins, n))
    keep = (numbers[begins] > 0) & (lengths >= windows.shortest)
    begins, lengths = begins[keep], lengths[keep]
    if not len(begins):
        return hit, pairs
    # the runs one after another, a separator behind each
    total = int((lengths + 1).sum())
    at = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    source = np.arange(total) - np.repeat(at, lengths + 1) + np.repeat(begins, lengths + 1)
    text = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[at + lengths] = False
    text[inside] = numbers[source[inside]]
    index = FMIndex(text, len(windows.vocabulary))
    low, high = index.search(windows.rows)
    found = np.flatnonzero(high > low)
    counts = high[found] - low[found]
    which = np.repeat(found, counts)
    rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[found], counts)
    first = source[index.locate(rows)]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + windows.length[which], -1)
    hit = np.cumsum(change[:-1]) > 0
    if len(first):
        pairs = np.unique(np.stack([doc[first], windows.item[which]], axis=1), axis=0)
    return hit, pairs


def _answers(texts: list[str | None], blocks: Iterable[Windows], hasher: _Hasher) -> list[tuple[int, int, list[str], list[dict]]]:
    """A row of RESULT for each text; the words are hashed once and meet one block of windows after another."""
    data = [(t or "").encode() for t in texts]
    values, begin, end, doc = [], [], [], []
    at = 0
    while at < len(data):  # words are hashed by groups of about a million bytes
        to, size = at, 0
        while to < len(data) and (to == at or size + len(data[to]) < 1 << 20):
            size += len(data[to]) + 1
            to += 1
        value, b, e = hasher(b"\x00".join(data[at:to]))
        offset = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data[at:to]])])
        d = np.searchsorted(offset, b, side="right") - 1
        values.append(value)
        begin.append(b - offset[d])
        end.append(e - offset[d])
        doc.append(d + at)
        at = to
    value = np.concatenate(values) if values else np.empty(0, np.uint64)
    begin, end, doc = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (begin, end, doc))
    hit = np.zeros(len(value), bool)
    items: dict[int, list[str]] = {}
    for windows in blocks:
        if not len(windows.vocabulary):
            continue
        place = np.searchsorted(windows.vocabulary, value)
        place[place == len(windows.vocabulary)] = 0
        found, pairs = match_shard(np.where(windows.vocabulary[place] == value, place + 1, 0).astype(np.int64), doc, windows)
        hit |= found
        for d, i in pairs.tolist():
            if windows.names[i] is not None:
                items.setdefault(d, []).append(windows.names[i])
    n_words = np.bincount(doc, minlength=len(data))
    n_hit = np.bincount(doc[hit], minlength=len(data))
    last = np.cumsum(n_words)
    out = []
    for d in range(len(data)):
        spans = []
        if n_hit[d]:
            lo, hi = int(last[d] - n_words[d]), int(last[d])
            edge = np.diff(np.concatenate([[False], hit[lo:hi], [False]]).astype(np.int8))
            chars = np.cumsum((np.frombuffer(data[d], np.uint8) & 0xC0) != 0x80)  # code points up to and with a byte
            for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                spans.append({"start": int(chars[begin[lo + s]]) - 1, "end": int(chars[end[lo + e - 1] - 1])})
        out.append((int(n_words[d]), int(n_hit[d]), sorted(set(items.get(d, []))), spans))
    return out


def _pass(docs: DataFrame, text: str, blocks: Callable[[], Iterable[Windows]], shard_words: int) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(RESULT).fields])
    place = docs.columns.index(text)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        names = schema.names
        for batch in it:
            at = 0
            texts = batch.column(place)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            while at < len(texts):  # a shard: about six bytes a word
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + 6 * shard_words, side="right")))
                got = list(zip(*_answers(texts.slice(at, to - at).to_pylist(), blocks(), hasher), strict=True))
                piece = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(c, k) for c, k in zip(got, kinds, strict=True))], names=names)
                at = to

    return docs.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", shard_words: int = 1_000_000, block_words: int = 2_000_000) -> DataFrame:
    """Adds n_words, n_hit, items (ids of the items with an occurring window, as sorted strings) and spans to every document.

    spans are ranges of code points [start, end) of the text. Null and empty texts have no words; null and empty items
    have no window; an item with a null id hits words but is not listed. Rows are kept, repeated ones too. Columns of
    the added names are replaced, others may have any names and types. A long text is a shard of its own; empty tables
    give no rows or no hits.
    """
    docs = without(docs, "n_words", "n_hit", "items", "spans")
    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))
    if n == 1:
        only = [Windows([(r["i"], r["t"]) for r in items.collect()])]
        return _pass(docs, text, lambda: only, shard_words)
    folder = scratch(docs.sparkSession, "windows")
    files = [f"{folder}/{b:06d}" for b in range(n)]
    for b, file in enumerate(files):  # a block of bounded size at a time
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        _write(file, pickle.dumps(Windows([(r["i"], r["t"]) for r in rows])))
    return _pass(docs, text, lambda: (pickle.loads(_read(file)) for file in files), shard_words)


def _write(path: str, data: bytes) -> None:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(data)


def _read(path: str) -> bytes:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner) as f:
        return f.read()


def remove_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Cuts the spans out of the text and drops the column; runs in the JVM."""
    kept = F.aggregate(
        F.col(spans), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])).alias("out"), s["end"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    return docs.withColumn(text, F.when(F.size(spans) > 0, kept).otherwise(F.col(text))).drop(spans)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document's words, hits and items; see find_contamination for nulls, repeated rows and long texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
