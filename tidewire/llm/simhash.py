"""SimHash near-duplicates by the generalised pigeonhole.

A fingerprint has 64 bits: bit k is 1 if it is set in over half of the 64-bit hashes of the text's word shingles.
Fingerprints that differ in at most max_bits bits are linked, and documents joined by links form a component.

The bits are grouped into parts so that correlated bits share a part; a dynamic program then gives each part its own
threshold t >= -1, the sum being max_bits - parts + 1, at least cost of probes and estimated candidates. Two
fingerprints within max_bits must agree on some part within its threshold, so each fingerprint is stored under its own
value of a part and probes all values within the threshold. Each bucket's candidates are verified.

A bucket above max_bucket rows is never paired: its fingerprints go to a second exact route, where each is listed under
all values within half of max_bits flips of it. Linked fingerprints share such a value, and one value is within reach of
a fixed number of fingerprints (65 for max_bits 2), so no group grows with the data. Only spanning links leave a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import cut, free, small_batches
from tidewire.llm.components import components

BITS = 64
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; A-Z is lower-cased, words are split at ASCII white space.

    A text of fewer words is one shingle; null and blank texts have none.
    """
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate((len(x) + 1 for x in w), initial=-1))
    return np.array([xxh64_intdigest(joined[s + 1 : e], SEED) for s, e in zip(ends, ends[words:])], np.uint64)  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit value; no hashes give 0."""
    n = len(hashes)
    if not n:
        return 0
    sums = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        sums += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    @F.pandas_udf("long")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([majority(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return run(text)


# ---- the parts and their thresholds


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each two bits the number that have both: 64 rows whatever the input."""

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for pdf in it:
            bits = np.unpackbits(pdf["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pd.DataFrame({"i": range(BITS), "n": n, "c": list(total.astype(np.int64))})

    rows = prints.select("fp").mapInPandas(part, "i int, n long, c array<long>").groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(BITS))).collect()
    counts = np.zeros((BITS, BITS))
    for r in rows:
        counts[r["i"]] = [r[f"c{j}"] for j in range(BITS)]
    return (rows[0]["n"] if rows else 0), counts


def correlated_parts(n: int, counts: np.ndarray, m: int) -> list[list[int]]:
    """m parts of at most ceil(64 / m) bits; the most correlated pairs of bits are put together first."""
    width = -(-BITS // m)
    p = np.diag(counts) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    group = {i: [i] for i in range(BITS)}
    where = list(range(BITS))
    for i, j in sorted(combinations(range(BITS), 2), key=lambda x: (-round(float(corr[x]), 6), x)):
        a, b = where[i], where[j]
        if a != b and len(group[a]) + len(group[b]) <= width:
            group[a] += group.pop(b)
            for k in group[a]:
                where[k] = a
    parts: list[list[int]] = [[] for _ in range(m)]
    for g in sorted(group.values(), key=lambda g: (-len(g), g)):
        for bit in g if len(min(parts, key=len)) + len(g) > width else [None]:
            min(parts, key=len).extend(g if bit is None else [bit])
    return [sorted(x) for x in parts if x]


def estimates(n: int, counts: np.ndarray, part: list[int], most: int) -> list[float]:
    """Estimated candidates of one fingerprint in this part for thresholds 0..most.

    Each bit is conditioned on the bit before it that it is most correlated with, from the two bits' joint counts.
    """
    f = counts / max(n, 1)
    p = np.diag(f)
    same = lambda i: p[i] ** 2 + (1 - p[i]) ** 2
    both = lambda i, j: f[i, j] ** 2 + (p[i] - f[i, j]) ** 2 + (p[j] - f[i, j]) ** 2 + (1 - p[i] - p[j] + f[i, j]) ** 2
    agree, ratios = 1.0, []
    for k, bit in enumerate(part):
        a = max((both(bit, j) / same(j) for j in part[:k]), default=same(bit))
        a = min(max(a, 1e-6), 1.0)
        agree *= a
        ratios.append((1 - a) / a)
    sums = [1.0] + [0.0] * most
    for r in ratios:  # elementary symmetric sums: which bits differ
        for k in range(most, 0, -1):
            sums[k] += sums[k - 1] * r
    return [n * agree * x for x in accumulate(sums)]


def probes(width: int, t: int) -> int:
    return sum(_choose(width, k) for k in range(t + 1))


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def plan(n: int, counts: np.ndarray, max_bits: int, probe_cost: float = 8.0) -> list[tuple[list[int], int]]:
    """The parts with their thresholds: for each number of parts a dynamic program over the sum of thresholds, then the cheapest."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, max_bits + 2):
        parts = correlated_parts(n, counts, m)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            guess = estimates(n, counts, part, max_bits)
            step: dict[int, tuple[float, list[int]]] = {}
            for have, (cost, ts) in table.items():
                for t in range(-1, max_bits + 1):
                    c = cost + (0.0 if t < 0 else guess[t] + probe_cost * probes(len(part), t))
                    if have + t not in step or c < step[have + t][0]:
                        step[have + t] = (c, [*ts, t])
            table = step
        cost, ts = table[max_bits - len(parts) + 1]
        if best is None or cost < best[0]:
            best = (cost, [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0])
    return best[1]


# ---- buckets


def _pack(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The part's bits, moved together."""
    out = np.zeros(len(prints), np.uint64)
    for k, b in enumerate(bits):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _flips(width: int, t: int, at_least: int = 0) -> np.ndarray:
    return np.array([sum(1 << b for b in bs) for k in range(at_least, t + 1) for bs in combinations(range(width), k)], np.uint64)


def bucket_rows(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, own): own rows are stored fingerprints, the others only probe."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            all_fp = pdf["fp"].to_numpy(np.int64)
            for at in range(0, len(all_fp), 4096):
                fp = all_fp[at : at + 4096]
                for k, (bits, t) in enumerate(parts):
                    key, flips = _pack(fp.view(np.uint64), bits), _flips(len(bits), t)
                    yield pd.DataFrame({"part": np.int32(k), "value": (key[:, None] ^ flips[None, :]).ravel().view(np.int64), "fp": np.repeat(fp, len(flips)), "own": np.tile(flips == 0, len(fp))})

    return prints.select("fp").mapInPandas(rows, "part int, value long, fp long, own boolean")


def spanning_links(groups: DataFrame, max_bits: int) -> DataFrame:
    """(stored array<long>, probing array<long>) -> (a, b): links within max_bits bits, enough of them to join what is linked in the group."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            a_out, b_out = [], []
            for stored, probing in zip(pdf["stored"], pdf["probing"], strict=True):
                s = np.asarray(stored, np.int64)
                q = np.concatenate([s, np.asarray(probing, np.int64)])
                near = np.bitwise_count((s[:, None] ^ q[None, :]).view(np.uint64)) <= max_bits
                root = list(range(len(q)))

                def find(x, root=root):
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for i, j in np.argwhere(near).tolist():
                    x, y = find(i), find(j)
                    if x != y:
                        root[y] = x
                        a_out.append(int(s[i]))
                        b_out.append(int(q[j]))
            if a_out:
                yield pd.DataFrame({"a": a_out, "b": b_out})

    return groups.mapInPandas(rows, "a long, b long")


def links(prints: DataFrame, max_bits: int = 2, max_bucket: int = 128) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose closure is that of all pairs within max_bits bits."""
    n, counts = bit_counts(prints)
    empty = prints.sparkSession.createDataFrame([], "a long, b long")
    if n < 2:
        return empty
    keyed = bucket_rows(prints, plan(n, counts, max_bits))
    sizes = keyed.groupBy("part", "value").agg(F.count("*").alias("rows"), F.count_if("own").alias("stored")).where("rows > 1 and stored > 0")
    buckets = cut(keyed.join(sizes, ["part", "value"]), "buckets")
    cold = buckets.where(F.col("rows") <= max_bucket).groupBy("part", "value").agg(F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("stored"), F.collect_list(F.when(~F.col("own"), F.col("fp"))).alias("probing"))
    found = spanning_links(cold.select("stored", "probing"), max_bits)
    hot = buckets.where(F.col("rows") > max_bucket).select("fp").distinct()
    return found.unionAll(dense_links(hot, max_bits))


def dense_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """The second route: every value within ceil(max_bits / 2) flips gathers the few fingerprints that can reach it."""
    flips = _flips(BITS, -(-max_bits // 2))

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            all_fp = pdf["fp"].to_numpy(np.int64)
            for at in range(0, len(all_fp), 1024):
                fp = all_fp[at : at + 1024]
                yield pd.DataFrame({"value": (fp.view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64), "fp": np.repeat(fp, len(flips))})

    near = prints.mapInPandas(rows, "value long, fp long").groupBy("value").agg(F.collect_list("fp").alias("stored")).where(F.size("stored") > 1)
    return spanning_links(near.select("stored", F.array().cast("array<long>").alias("probing")), max_bits)


def near_components(docs: DataFrame, words: int = 3, max_bits: int = 2, max_bucket: int = 128, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) for every row of docs; component_id is the least key that links reach.

    Texts without words have fingerprint 0 and link like any other. Null texts count as empty. Rows with a null key
    link too but never name a component, so it is null where all keys are. Repeated rows come out repeatedly. Long texts
    are hashed whole in bounded pieces; other columns are not returned, whatever their names; no rows give no rows.
    """
    prints = cut(docs.select(F.col(f"`{key}`").alias("__k"), fingerprint(F.col(f"`{text}`"), words).alias("fp")), "prints")
    each = cut(prints.groupBy("fp").agg(F.min("__k").alias("least")), "distinct")
    roots = components(links(each, max_bits, max_bucket)).withColumnRenamed("node", "fp")
    rooted = cut(each.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut(rooted.join(named, "root").select("fp", "component_id"), "named")
    return prints.join(by_print, "fp").select(F.col("__k").alias(key), "fp", "component_id")


# ---- similarity of shingle sets

#: Tables of keys up to this number of rows (24 bytes each) are broadcast; larger ones join by shuffle.
BROADCAST_KEYS = 1_000_000
#: How many of a set's shared prefix shingles go along with each, to name a pair at the first common one only.
NAMED = 8
#: Shingles that so many of the sampled sets have are salted.
HOT_SHINGLE = 64
#: Groups of a shingle up to this size are paired by a join, larger ones in blocks of BLOCK rows that meet in Python.
JOINED_GROUP = 64
#: Before all pairs of a large group are tried, its members meet one hub, and then one in so many of the pairs is tried.
ONE_IN = 8
BLOCK = 2048


def partial_prints(distinct: np.ndarray, bands: int) -> list[int]:
    """SimHashes of three shingles each: those least under the band's own order. Fewer than three shingles: of all."""
    if len(distinct) <= 3:
        return [majority(distinct)] * bands
    seeds = np.array([(0x9E3779B97F4A7C15 * (b + 1)) & (1 << 64) - 1 for b in range(bands)], np.uint64)
    out = np.zeros(bands, np.int64)
    kept: np.ndarray | None = None
    for at in range(0, len(distinct), 1 << 15):  # bounded memory for very long texts
        own = np.broadcast_to(distinct[None, at : at + (1 << 15)], (bands, min(1 << 15, len(distinct) - at)))
        own = own if kept is None else np.concatenate([kept, own], axis=1)
        order = (own ^ seeds[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        order ^= order >> np.uint64(32)
        kept = np.take_along_axis(own, np.argpartition(order, min(2, own.shape[1] - 1), axis=1)[:, :3], axis=1)
    for b in range(bands):
        x, y, z = kept[b]
        out[b] = ((x & y) | (x & z) | (y & z)).view(np.int64)  # the majority of three
    return out.tolist()


def shingle_sets(docs: DataFrame, words: int, bands: int, text: str, key: str) -> DataFrame:
    """(k, row, fp, th, prints, shingles): key, hash of the row, SimHash, hash of the set of shingles, partial SimHashes, sorted 32-bit hashes of the set."""
    from xxhash import xxh64_intdigest

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                fps, ths, prints, sets = [], [], [], []
                for t in batch.column(2).to_pylist():
                    hashes = shingle_hashes(t, words)
                    distinct = np.unique(hashes)
                    fps.append(majority(hashes))
                    ths.append(xxh64_intdigest(distinct.tobytes()) - (1 << 63))
                    prints.append(partial_prints(distinct, bands))
                    sets.append(np.unique((distinct >> np.uint64(32)).astype("<u4")).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(ths, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["k", "row", "fp", "th", "prints", "shingles"])

    return docs.select(F.col(f"`{key}`").alias("k"), row_hash(docs).alias("row"), F.col(f"`{text}`").alias("t")).mapInArrow(rows, "k long, row long, fp long, th long, prints array<long>, shingles binary")


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row; columns that hold maps, which have no hash, are left out."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of set hashes those whose sets have a Jaccard similarity of at least `similarity`."""
    first = pairs.join(sets.select(F.col("th").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("th").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                if len(small) < similarity * len(large):
                    good.append(False)
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                same = int((large[at] == small).sum()) if len(large) else 0
                good.append(same >= similarity * (len(p) + len(q) - same))
            kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            if len(kept):
                yield kept

    return both.mapInArrow(keep, "a long, b long")


def bitmap(shingles: np.ndarray) -> bytes:
    """Four to eight bits for each shingle of a set, as a power of two; a shingle sets the bit that its low end names."""
    bits = np.zeros(max(8, 1 << (4 * len(shingles) - 1).bit_length()), bool)
    bits[shingles & np.uint32(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_match(x: bytes, n: int, y: bytes, m: int, similarity: float) -> bool:
    """Whether sets of n and m shingles with these bitmaps can have the similarity: a bit of one that the other lacks stands for a shingle that it lacks."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] | p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] | q[len(q) // 2 :]
    most = min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))
    return most >= similarity * (n + m - most)


def sketched(sets: DataFrame) -> DataFrame:
    """(th, shingles) -> (th, n, bits)."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = [np.frombuffer(x.as_py(), "<u4") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int32()), pa.array([bitmap(x) for x in own], pa.binary())], names=["th", "n", "bits"])

    return sets.select("th", "shingles").mapInArrow(rows, "th long, n int, bits binary")


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those that the bitmaps don't rule out; an eighth or less of the bytes of whole sets is moved."""
    first = pairs.join(sketches.select(F.col("th").alias("a"), F.col("n").alias("p"), F.col("bits").alias("x")), "a")
    both = first.join(sketches.select(F.col("th").alias("b"), F.col("n").alias("q"), F.col("bits").alias("y")), "b").select("a", "b", "p", "x", "q", "y")

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            good = [may_match(x.as_py(), p, y.as_py(), q, similarity) for p, x, q, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5), strict=True)]
            kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            if len(kept):
                yield kept

    return both.mapInArrow(keep, "a long, b long")


def common_shingles(sets: DataFrame, texts: int, sample: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """32-bit shingles that at least two of about `sample` sets have, sorted, and in how many: only the order of prefixes depends on them."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in batch.column(0)]))], names=["s"])

    some = sets.where(F.pmod("th", F.lit(max(1, texts // sample))) == 0).dropDuplicates(["th"]).select("shingles")
    found = some.mapInArrow(rows, "s int").groupBy("s").agg(F.count("*").alias("n")).where("n > 1").toPandas()
    shingles = found["s"].to_numpy(np.int32).view(np.uint32)
    order = np.argsort(shingles)
    return shingles[order], found["n"].to_numpy(np.uint64)[order]


def prefixes(sets: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """(th, root, shingles) -> (s, salt, th, root, place): a row for each of a set's rarest shingles, of which two sets of the similarity share at least one.

    place is the size of the set, shifted by 32 bits, and the shingle's position; salt is -1 but for hot shingles.
    """
    held = sets.sparkSession.sparkContext.broadcast(common)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = held.value
        for whole in it:
            for begin in range(0, len(whole), 500):
                batch = whole.slice(begin, 500)
                out, sizes = [], []
                for x in batch.column(2):
                    own = np.frombuffer(x.as_py(), "<u4")
                    rank = np.zeros(len(own), np.uint64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        rank = np.where(known[at] == own, counts[at], np.uint64(0))
                    keys = np.sort(rank << np.uint64(32) | own.astype(np.uint64))
                    sizes.append(len(own))
                    out.append(keys[: len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1])
                n = np.array([len(o) for o in out])
                keys = np.concatenate(out)
                each = np.repeat(np.arange(len(out)), n)
                place = np.repeat(np.array(sizes, np.int64), n) << 32 | (np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n))
                th, root = (batch.column(c).to_numpy()[each] for c in (0, 1))
                salt = np.where(keys >> np.uint64(32) >= HOT_SHINGLE, th & 63, -1).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.uint32).view(np.int32)), pa.array(salt), pa.array(th), pa.array(root), pa.array(place)], names=["s", "salt", "th", "root", "place"])

    return sets.select("th", "root", "shingles").mapInArrow(rows, "s int, salt byte, th long, root long, place long")


def shared_rows(listed: DataFrame) -> DataFrame:
    """Of prefix rows those whose shingle stands in sets of different roots, with the group's size c.

    One shuffle brings the rows of a shingle together; hot shingles are spread over 64 salts, and judged afterwards.
    """
    group = Window.partitionBy("s", "salt")
    wide = listed.select("*", F.min("root").over(group).alias("r0"), F.max("root").over(group).alias("r1"), F.count("*").over(group).alias("c"))
    met = cut(wide.where((F.col("r0") != F.col("r1")) | (F.col("salt") >= 0)).drop("r0", "r1"), "prefix-groups")
    # at most the words of the sample / HOT_SHINGLE shingles are hot
    hot = met.where("salt >= 0").groupBy("s").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("hot_c")).where("r0 <> r1").select("s", "hot_c")
    hot_rows = met.where("salt >= 0").drop("c").join(F.broadcast(hot), "s").withColumnRenamed("hot_c", "c")
    return met.where("salt < 0").unionByName(hot_rows).drop("salt")


def named_rows(met: DataFrame) -> DataFrame:
    """(s, th, root, place, c) -> (s, th, root, n, pos, named, c): named are the first NAMED shared shingles of the set, in the one order of all prefixes."""
    one = F.array_sort(F.collect_set(F.struct(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), "s", "c"))).alias("all")
    by_set = met.groupBy("th").agg(F.min("root").alias("root"), F.min(F.shiftright("place", 32).cast("int")).alias("n"), one)
    rows = by_set.select("th", "root", "n", F.slice("all.s", 1, NAMED).alias("named"), F.explode("all").alias("x")).select("x.s", "th", "root", "n", "x.pos", "named", "x.c")
    return cut(rows, "prefix-rows")


def hub_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """In each large group all members with one: the set that shares most of its prefix, as the origin of edited copies does. Linear in the rows."""
    large = rows.where(F.col("c") > JOINED_GROUP)
    shared = large.join(large.groupBy("th").agg(F.count("*").alias("shared")), "th")
    hubs = shared.groupBy("s").agg(F.max(F.struct("shared", "th", "root", "n")).alias("hub"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("s", "hub")
    met = large.join(hubs, "s").where((F.col("root") != F.col("hub.root")) & (F.least("n", "hub.n") >= similarity * F.greatest("n", "hub.n") - 1e-6))
    return cut(met.select(F.least("th", "hub.th").alias("a"), F.greatest("th", "hub.th").alias("b")).distinct(), "hub-pairs")


def prefix_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """named_rows -> (a, b): all pairs of different roots that can have the similarity.

    The lesser set needs only the shorter prefix of sets that meet no smaller ones. At the first common shingle nothing
    before it is shared, so what is left of both must hold the least overlap. Pairs whose named shingles meet come out
    at their first common shingle only, others at each that they share.
    """
    few = rows.where(F.col("c") <= JOINED_GROUP).drop("c")
    lesser = few.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - 1e-6))
    other = lesser.select(*(F.col(c).alias(f"{c}2") for c in few.columns))
    fits = (F.col("root") != F.col("root2")) & (F.col("n2") <= F.col("n")) & (F.col("n2") >= similarity * F.col("n") - 1e-6)
    fits &= F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= similarity / (1 + similarity) * (F.col("n") + F.col("n2")) - 1e-6
    fits &= F.coalesce(F.get(F.array_intersect("named", "named2"), 0), "s") == F.col("s")
    small = few.join(other, (F.col("s") == F.col("s2")) & fits).select("th", "th2")
    many = block_pairs(rows, similarity, 1)
    return cut(small.unionAll(many).select(F.least("th", "th2").alias("a"), F.greatest("th", "th2").alias("b")).distinct(), "prefix-pairs")


def part_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    part = block_pairs(rows, similarity, ONE_IN)
    return cut(part.select(F.least("th", "th2").alias("a"), F.greatest("th", "th2").alias("b")).distinct(), "part-pairs")


def block_pairs(rows: DataFrame, similarity: float, one_in: int) -> DataFrame:
    """The pairs of prefix_pairs in large groups: each block of a group meets each other, and itself, in a call of its own.

    one_in takes a random part of the pairs: sets that have many links then join at a part of the cost of all pairs.
    """
    large = rows.where(F.col("c") > JOINED_GROUP)
    mixed = large.groupBy("s").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("s")
    rows = large.join(mixed, "s", "left_semi")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = rows.withColumn("b", F.pmod(F.xxhash64("th"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    both = own.select("s", F.least("b", "with").alias("lo"), F.greatest("b", "with").alias("hi"), "b", "th", "root", "n", "pos", "named")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        s, lo, hi = (int(pdf[c].iloc[0]) for c in ("s", "lo", "hi"))
        n, pos, root, th = (pdf[c].to_numpy(np.int64) for c in ("n", "pos", "root", "th"))
        named = np.zeros((len(pdf), NAMED), np.int64)
        for i, x in enumerate(pdf["named"]):
            named[i] = np.pad(np.asarray(x, np.int64), (0, NAMED - len(x)), constant_values=1 << 40)
        short = pos <= n - np.ceil(n * (2 * similarity / (1 + similarity)) - 1e-6)
        roots, of_root, sizes = np.unique(root, return_inverse=True, return_counts=True)
        most = of_root == sizes.argmax()  # rows of the commonest root needn't meet one another
        of = pdf["b"].to_numpy()
        one, two = of == lo, of == hi
        a_out, b_out = [], []
        for left, right in ((np.flatnonzero(one & ~most), np.flatnonzero(two)), (np.flatnonzero(one & most), np.flatnonzero(two & ~most)))[: 1 if lo == hi else 2]:
            for at in range(0, len(left), 256):
                i = left[at : at + 256, None]
                j = right[None, :]
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                ok = (root[i] != root[j]) & (small >= similarity * large - 1e-6)
                ok &= np.where(n[i] == n[j], short[i] | short[j], np.where(n[i] < n[j], short[i], short[j]))
                ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6
                if lo == hi:
                    ok &= (i < j) | most[j]
                if one_in > 1:
                    ok &= ((th[i] ^ th[j]).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(one_in) == 0
                x, y = np.nonzero(ok)
                x, y = left[at + x], right[y]
                for k in range(0, len(x), 65536):
                    p, q = x[k : k + 65536], y[k : k + 65536]
                    same = (named[p][:, :, None] == named[q][:, None, :]).any(axis=2) & (named[p] < 1 << 40)
                    first = same.argmax(axis=1)
                    here = ~same.any(axis=1) | (named[p, first] == s)
                    a_out.append(th[p[here]])
                    b_out.append(th[q[here]])
        return pd.DataFrame({"th": np.concatenate(a_out or [th[:0]]), "th2": np.concatenate(b_out or [th[:0]])})

    return both.groupBy("s", "lo", "hi").applyInPandas(meet, "th long, th2 long")


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast a table of keys whose counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def joined_texts(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """See _joined_texts; sets and texts are large, so few go to Python at once."""
    with small_batches(docs.sparkSession, 500):
        return _joined_texts(docs, **how)


def _joined_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 6, max_bits: int = 3, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows (k, row, th) of docs, and (th, root) for each set of shingles that isn't empty.

    First most copies are joined at linear cost: candidates are the pigeonhole links of whole fingerprints (within
    max_bits) and, in each group that agrees on a partial fingerprint, all members with two hubs, the least of two random
    orders of the band. Then an exact route: sets that can be similar share a shingle of their prefixes of rarest
    shingles, and all such pairs that aren't joined yet are candidates. All candidates are verified on whole sets, so the
    components are those of all pairs.
    """
    table = cut(shingle_sets(docs, words, bands, text, key), "shingle-sets")
    # one row speaks for each set: that of the least key, then of the least row hash
    each = cut(table.where(F.length("shingles") > 0).groupBy("th").agg(F.min(F.struct(F.col("k").isNull(), "k", "row")).alias("o"), F.first("fp").alias("fp"), F.first("prints").alias("prints")).select("th", "o.k", "o.row", "fp", "prints"), "texts")
    count = each.count()
    ranks = [F.struct(F.xxhash64("th", "band", F.lit(s)).alias("h"), "th") for s in (1, 2)]
    listed = each.select("th", F.posexplode("prints").alias("band", "print"))
    groups = listed.groupBy("band", "print").agg(F.count("*").alias("n"), *(F.min(r).alias(f"h{i}") for i, r in enumerate(ranks))).where("n > 1")
    met = cut(listed.join(groups.select("band", "print", F.col("h0.th").alias("p"), F.col("h1.th").alias("q")), ["band", "print"]).select("th", "p", "q"), "met")
    hubs = met.select("th", F.col("p").alias("hub")).unionAll(met.select("th", F.col("q").alias("hub")))
    # whole fingerprints: each link of fingerprints stands for the least texts that have them, and texts of one fingerprint meet its least
    by_print = cut(each.groupBy("fp").agg(F.min("th").alias("th"), F.count("*").alias("n")), "prints")
    # a link is found once in each part that it agrees on
    ends = cut(links(by_print.select("fp"), max_bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    of = by_print.select("fp", "th")
    wide = cut(ends.join(of.withColumnsRenamed({"fp": "a", "th": "x"}), "a").join(of.withColumnsRenamed({"fp": "b", "th": "y"}), "b").select(F.col("x").alias("th"), F.col("y").alias("hub")), "wide")
    same = each.join(by_print.where("n > 1").select("fp", F.col("th").alias("hub")), "fp").select("th", "hub")
    all_pairs = hubs.unionAll(wide).unionAll(same).where("th <> hub")
    pairs = cut(all_pairs.select(F.least("th", "hub").alias("a"), F.greatest("th", "hub").alias("b")).distinct(), "pairs")
    free(met, ends, wide, by_print)

    def of_pairs(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        wanted = pairs.select(F.col("a").alias("th")).unionAll(pairs.select(F.col("b").alias("th"))).distinct()
        owners = cut(each.join(wanted, "th").select("th", "k", "row"), f"owners-{name}")
        return owners, one_row(table, owners, owners.count())

    def judged(pairs: DataFrame, name: str, sketch: bool = True) -> DataFrame:
        likely = pairs
        if sketch:
            owners, sets = of_pairs(pairs, name)
            sketches = cut(sketched(sets).dropDuplicates(["th"]), f"sketches-{name}")
            likely = cut(possible(pairs, sketches, similarity), f"likely-{name}")
            free(owners, sketches, pairs)
        owners, sets = of_pairs(likely, name)
        sets = cut(sets.dropDuplicates(["th"]).select("th", "shingles"), f"sets-{name}")
        good = cut(verified(likely, sets, similarity), f"verified-{name}")
        free(owners, sets, likely)
        return good

    first = judged(pairs, "hubs", sketch=False)
    near = pointed(first)
    rooted = cut(each.join(near, each["th"] == near["node"], "left").select("th", "k", "row", F.coalesce("root", "th").alias("root")), "rooted")
    own = one_row(table, rooted, count)
    rows = named_rows(shared_rows(prefixes(own, common_shingles(own, count), similarity)))
    linked = first
    for some_pairs in (hub_pairs, part_pairs):  # contract large groups, so that few pairs are left in them
        tried = some_pairs(rows, similarity)
        if tried.isEmpty():
            break
        good = judged(tried, "round", sketch=False)
        if not good.isEmpty():
            linked = linked.unionAll(good)
            rows = rerooted(rows, good)
    linked = linked.unionAll(judged(prefix_pairs(rows, similarity), "prefixes"))
    roots = components(linked).withColumnRenamed("node", "th")
    named = cut(each.join(roots, "th", "left").select("th", F.coalesce("root", "th").alias("root")), "roots")
    keys = cut(table.select("k", "row", "th"), "rows")
    free(table, each, first, near, rows, rooted)
    return keys, named


def pointed(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): each node with the most linked node of its neighbourhood, two steps far.

    Nodes of one root are joined, but one component may keep several roots: this only saves pairs, components are found at the end.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    degree = both.groupBy("x").agg(F.count("*").alias("n"))
    ends = both.join(degree.select(F.col("x").alias("y"), F.col("n").alias("m")), "y").groupBy("x").agg(F.max(F.struct("m", "y")).alias("best"))
    step = cut(ends.join(degree, "x").select("x", F.when(F.col("best") > F.struct(F.col("n").alias("m"), F.col("x").alias("y")), F.col("best.y")).otherwise(F.col("x")).alias("y")), "pointers")
    out = cut(step.join(step.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select(F.col("x").alias("node"), F.col("z").alias("root")), "pointed")
    free(step)
    return out


def rerooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with the roots that they have once links (a, b) of sets join the roots they had."""
    sets = rows.select("th", "root").distinct()
    ends = links.join(sets.select(F.col("th").alias("a"), F.col("root").alias("x")), "a").join(sets.select(F.col("th").alias("b"), F.col("root").alias("y")), "b")
    to = pointed(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b"))
    moved = to.withColumnRenamed("root", "to")
    out = cut(rows.join(narrow(moved, moved.count()), rows["root"] == moved["node"], "left").withColumn("root", F.coalesce("to", "root")).drop("node", "to"), "prefix-rows")
    free(rows, to)
    return out


def one_row(table: DataFrame, owners: DataFrame, count: int) -> DataFrame:
    """Of the table's rows those of owners (th, k, row, ...), with the owners' other columns; equal rows may repeat.

    th is the one key of the join, as a table of single longs is small in memory; k and row are compared as a difference.
    """
    rows = table.select("th", "k", "row", "shingles")
    mine = narrow(owners, count)
    zero = lambda a, b: a.bitwiseXOR(b) == 0
    same = zero(rows["row"], owners["row"]) & zero(F.coalesce(rows["k"], F.lit(0)), F.coalesce(owners["k"], F.lit(0))) & zero(rows["k"].isNull().cast("int"), owners["k"].isNull().cast("int"))
    return rows.join(mine, (rows["th"] == owners["th"]) & same).select(rows["th"], "shingles", *(owners[c] for c in owners.columns if c not in ("th", "k", "row")))


def similar_components(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """(key, component_id) for every row of docs: the least key among documents joined by links of Jaccard similarity.

    Texts without words (null, empty or blank) are no copies of anything. Null keys and repeated rows are kept; a null
    key never names a component. Other columns may have any names. An empty table gives no rows.
    """
    rows, roots = joined_texts(docs, text=text, key=key, **how)
    placed = cut(rows.join(roots, "th", "left").select("k", "root"), "placed")
    named = placed.where("root is not null").groupBy("root").agg(F.min("k").alias("component_id"))
    return placed.join(named, "root", "left").select(F.col("k").alias(key), F.coalesce("component_id", "k").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """One document of each component stays: that of the least key, of equal keys that of the least row hash.

    A key that repeats with another text is no copy, so texts of other components stay. Of rows that are equal in all
    columns one stays. Rows with a null key and rows without words all stay. Only keys and hashes are shuffled to
    decide; the documents meet the decision in one semi-join. Columns stay as they are, whatever their names.
    """
    rows, roots = joined_texts(docs, text=text, key=key, **how)
    counted = rows.where("k is not null").join(roots, "th").groupBy("root", "k", "row").agg(F.count("*").alias("n"))
    kept = cut(counted.groupBy("root").agg(F.min(F.struct("k", "row", "n")).alias("best")).select("best.k", "best.row", "best.n"), "kept")
    free(rows, roots)
    k, words = F.col(f"`{key}`"), F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x09-\x0D]", " ")) != ""
    hashed = docs.withColumn("__row", row_hash(docs))
    few = narrow(kept.select(F.col("k").alias("__k"), F.col("row").alias("__r"), F.col("n").alias("__n")), kept.count())
    # the row's hash is the one key of the join, as a table of single longs is small in memory; the key is compared beside it
    met = hashed.join(few, (F.col("__row") == F.col("__r")) & (F.xxhash64(k).bitwiseXOR(F.xxhash64("__k")) == 0) & words, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = met.where((F.col("__n") == 1) | k.isNull() | ~words).select(*columns)
    if kept.where("n > 1").isEmpty():
        return out
    return out.unionAll(met.where(F.col("__n") > 1).dropDuplicates(["__k", "__r"]).select(*columns))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of 3-word shingles and component of links within 2 bits; see near_components."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
