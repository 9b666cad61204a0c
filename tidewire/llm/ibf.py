"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into pieces (sentences and lines, long ones further every 12 words and 200 code points); the digest of a
piece also counts its repeats, so a text is a set of 64-bit digests. A sketch has three subtables; each digest
enters one cell of each (count, XOR of digests, XOR of checksums). The difference of two sketches is that of the sets:
cells with one digest are peeled until nothing is left, which recovers the differing digests. A sketch that doesn't
peel is built again four times as large with other hashes, until it does; the base size is the printed fingerprint.

Likeness is 1 - differing / all digests of both sides; two texts without pieces are alike (1.0).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import partitions

BASE_CELLS = 9
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")
_LOWEST = -(1 << 63)


def digests(text: str) -> np.ndarray:
    """The set of a text's piece digests, sorted."""
    from xxhash import xxh64_intdigest

    seen: dict[str, int] = {}
    out = []
    for sentence in _BREAK.split(text):
        words = sentence.split(" ") if len(sentence) > 40 else [sentence]
        for at in range(0, len(words), 12):
            long = " ".join(words[at : at + 12])
            for begin in range(0, len(long), 200):
                piece = long[begin : begin + 200] if len(long) > 200 else long
                k = seen.get(piece, 0)
                seen[piece] = k + 1
                out.append(xxh64_intdigest(piece, k))
    return np.unique(np.array(out, np.uint64))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tables:
    """Many sketches side by side: sketch i has cells[i] cells (a multiple of 3)."""

    def __init__(self, cells: np.ndarray, attempt: int = 0):
        self.third, self.attempt = cells // 3, attempt
        self.offset = np.concatenate([[0], np.cumsum(cells)])
        total = int(self.offset[-1])
        self.count, self.keys, self.checks = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)

    def check(self, keys: np.ndarray) -> np.ndarray:
        return _mix(keys, 97) >> np.uint64(32)

    def add(self, which: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Enters digests (or with sign -1 takes them out); gives the cells that changed."""
        check, touched = self.check(keys), []
        for j in range(3):
            at = self.offset[which] + j * self.third[which] + (_mix(keys, 3 * self.attempt + j) % self.third[which].astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)
            touched.append(at)
        return np.concatenate(touched)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which sketches peeled wholly; sketch, digest and sign of each recovered digest."""
        which, keys, signs = [], [], []
        look = np.flatnonzero(self.count)
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1)]
            pure = pure[self.check(self.keys[pure]) == self.checks[pure]]
            if not len(pure):
                break
            w = np.searchsorted(self.offset, pure, side="right") - 1
            _, first = np.unique(np.stack([w.astype(np.uint64), self.keys[pure]]), axis=1, return_index=True) if len(pure) > 1 else (None, np.zeros(1, np.int64))
            w, k, s = w[first], self.keys[pure[first]], self.count[pure[first]]
            which.append(w)
            keys.append(k)
            signs.append(s)
            look = np.unique(self.add(w, k, -s))
        left = np.flatnonzero((self.count != 0) | (self.keys != 0) | (self.checks != 0))
        done = np.ones(len(self.third), bool)
        done[np.searchsorted(self.offset, left, side="right") - 1] = False
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return done, join(which, np.int64), join(keys, np.uint64), join(signs, np.int64)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) if sets else np.empty(0, np.uint64)


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """The base sketches, printed; equal texts give equal strings."""
    t = Tables(np.full(len(sets), BASE_CELLS))
    which, keys = _flat(sets)
    t.add(which, keys, np.ones(len(keys), np.int64))
    body = np.concatenate([t.keys.reshape(-1, BASE_CELLS).astype("<u8").view(np.uint8), t.checks.reshape(-1, BASE_CELLS).astype("<u4").view(np.uint8), t.count.reshape(-1, BASE_CELLS).astype("<u4").view(np.uint8)], axis=1) if sets else []
    return [base64.b64encode(x.tobytes()).decode() for x in body]


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the digests only left has, and those only right has, by subtracting and peeling."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64),) * 2 for _ in left]
    todo, cells, attempt = np.arange(len(left)), BASE_CELLS, 0
    while len(todo):
        t = Tables(np.full(len(todo), cells), attempt)
        for sets, sign in ((left, 1), (right, -1)):
            which, keys = _flat([sets[i] for i in todo])
            t.add(which, keys, np.full(len(keys), sign))
        done, which, keys, signs = t.peel()
        order = np.argsort(which, kind="stable")
        which, keys, signs = which[order], keys[order], signs[order]
        ends = np.searchsorted(which, np.arange(len(todo) + 1))
        for k in np.flatnonzero(done):
            got, s = keys[ends[k] : ends[k + 1]], signs[ends[k] : ends[k + 1]]
            out[todo[k]] = (got[s > 0], got[s < 0])
        todo, cells, attempt = todo[~done], cells * 4, attempt + 1
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    return [1.0 - (len(a) + len(b)) / max(1, len(x) + len(y)) for x, y, (a, b) in zip(left, right, differences(left, right), strict=True)]


# ---- each document with its edited text and its successor


def _key(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(_LOWEST).to_numpy(zero_copy_only=False).astype(np.int64)


def compare_successors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's. Documents are ordered by key, rows of one key by the hash of their text; null keys come first; after
    the last comes the first, and a lone document follows itself. Null texts are empty. Texts of any length are held
    whole, two at a time. Other columns of docs are not returned, whatever their names; an empty table gives no rows.

    Keys are dealt into ranges by quantiles. A row goes to its range, the first row of a range also to the range before
    it: the texts are shuffled once, compressed, and each range is read in order with one row held back.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = partitions(spark)
    at = [i / (4 * n) for i in range(1, 4 * n)]
    cuts = narrow.agg(F.percentile_approx(F.coalesce("k", F.lit(_LOWEST)), at, 100 * n).alias("q")).first()["q"]
    bounds = np.unique(np.array(cuts or [], np.int64))

    def lowest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            k = _key(batch)
            part = np.searchsorted(bounds, k, side="right")
            order = np.lexsort((k, part))
            part, first = np.unique(part[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(k[order][first], pa.int64())], names=["part", "k"])

    firsts = {r["part"]: r["k"] for r in narrow.select("k").mapInArrow(lowest, "part int, k long").groupBy("part").agg(F.min("k").alias("k")).collect()}
    used = sorted(firsts)
    before = {p: used[i - 1] for i, p in enumerate(used)}

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in it:
            for begin in range(0, len(whole), 1000):
                batch = whole.slice(begin, 1000)
                k = _key(batch)
                part = np.searchsorted(bounds, k, side="right").tolist()
                rows = []
                for p, key_, id_, t in zip(part, k.tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = t.encode()
                    row = (key_, xxh64_intdigest(raw) - (1 << 63), id_, zlib.compress(raw, 1))
                    rows.append((p, False, *row))
                    if key_ == firsts[p]:
                        rows.append((before[p], True, *row))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "ahead", "k", "h", "id", "body"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # part, id, text, digests
        rows: list[tuple] = []
        size = 0
        for batch in it:
            for p, ahead, _, _, id_, body in zip(*(c.to_pylist() if c.type != pa.binary() else c for c in batch.columns), strict=True):
                if ahead and (held is None or held[0] != p):
                    continue  # only the first of the rows ahead follows the range's last
                t = zlib.decompress(body.as_py()).decode()
                now = (p, id_, t, digests(t))
                if held is not None and held[0] == p:
                    k = len(held[2]) // 4
                    edited = held[2][: len(held[2]) - k] + t[:k]
                    rows.append((held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), held[3], digests(edited), now[3]))
                    size += 16 + len(held[3]) + len(now[3])
                held = None if ahead else now
                if size > 60_000:
                    yield answer(rows)
                    rows, size = [], 0
        if rows:
            yield answer(rows)

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, shas, own, edited, after = map(list, zip(*rows, strict=True))
        columns = [ids, sizes, shas, fingerprints(own), fingerprints(edited), likeness(own, edited), likeness(own, after)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = narrow.mapInArrow(deal, "part int, ahead boolean, k long, h long, id long, body binary")
    ordered = dealt.repartition(n, "part").sortWithinPartitions("part", "ahead", "k", "h")
    return ordered.mapInArrow(compare, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", key)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document with its edited text and successor; see compare_successors for nulls, ties and repeated rows."""
    return compare_successors(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
