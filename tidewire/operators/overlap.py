"""Best others by weighed overlap of sets, without a row for each pair: packed rows, sorted in numpy.

Rows are dealt three times, by item, by value and by item again, as blobs without the bits that are zero throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.session import checkpointed

#: Groups that rows are dealt into; a task holds one group at once.
GROUPS = 1024
#: Values that are packed together before they are dealt.
BUFFER = 800_000
SCHEMA = "p int, body binary"
_EMPTY = np.zeros(0, np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Each array as its length, the mask of bits that any of its numbers has, and those bits of each number."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<i8")
        mask = int(np.bitwise_or.reduce(a)) & (2**64 - 1) if len(a) else 0
        out += [len(a).to_bytes(4, "little"), mask.to_bytes(8, "little")]
        if mask:
            used, bits = _bits(mask)
            out.append(np.packbits(np.unpackbits(a.view(np.uint8).reshape(-1, 8)[:, used], axis=1, bitorder="little")[:, bits]).tobytes())
    return b"".join(out)


def _bits(mask: int) -> tuple[list[int], list[int]]:
    """The bytes that a mask uses, and its bits counted over these bytes only."""
    used = [j for j in range(8) if mask >> (8 * j) & 255]
    return used, [8 * i + k for i, j in enumerate(used) for k in range(8) if mask >> (8 * j + k) & 1]


def _unpack(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        n, mask = int.from_bytes(body[at:at + 4], "little"), int.from_bytes(body[at + 4:at + 12], "little")
        at += 12
        a = np.zeros((n, 8), np.uint8)
        if mask:
            used, bits = _bits(mask)
            size = (n * len(bits) + 7) // 8
            wide = np.zeros((n, 8 * len(used)), np.uint8)
            wide[:, bits] = np.unpackbits(np.frombuffer(body, np.uint8, size, at), count=n * len(bits)).reshape(n, -1)
            a[:, used] = np.packbits(wide, axis=1, bitorder="little")
            at += size
        out.append(a.view("<i8").reshape(-1))
    return out


def _steps(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as the first of them and the steps between them."""
    return a[:1], np.diff(a)


def _sum(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate((first, steps)))


def _group(v: np.ndarray, tag: np.ndarray | int = 0) -> np.ndarray:
    mixed = (v.astype(np.uint64) + np.asarray(tag).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(GROUPS)).astype(np.int64)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, … (counts[i] of them) for each i."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _where(per: np.ndarray) -> np.ndarray:
    """The column of each later value: per[i, c] of column c for each row i."""
    return np.repeat(np.tile(np.arange(per.shape[1]), len(per)), per.ravel())


def _new(*keys: np.ndarray) -> np.ndarray:
    """Whether a sorted row differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _slices(sorted_groups: np.ndarray) -> Iterator[tuple[int, int, int]]:
    at = np.flatnonzero(_new(sorted_groups))
    yield from zip(sorted_groups[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_groups)], strict=True)


def _batch(bodies: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in bodies], pa.int32()), pa.array([b for _, b in bodies], pa.binary())], ["p", "body"])


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
    """The unpacked blobs of one group after another, of batches sorted by group."""
    now, held = None, []
    for batch in batches:
        groups = batch.column(0).to_pylist()
        for p, body in zip(groups, batch.column(1), strict=True):
            if p != now and held:
                yield held
                held = []
            now = p
            held.append(_unpack(body.as_py()))
    if held:
        yield held


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("p").sortWithinPartitions("p")


def _items(blobs: list[list[np.ndarray]], wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, value and column of each distinct value of a group's items, sorted by key, column and value."""
    parts, gone = [(_EMPTY,) * 3], [_EMPTY]
    for blob in blobs:
        keys = _sum(*blob[:2])
        if len(blob) == 2:
            gone.append(keys)
        else:
            parts += [(np.repeat(keys, blob[2 + 2 * c]), blob[3 + 2 * c], np.full(len(blob[3 + 2 * c]), c)) for c in range(wide)]
    keys, values, at = (np.concatenate([x[i] for x in parts]) for i in range(3))
    order = np.lexsort((values, at, keys))
    keys, values, at = keys[order], values[order], at[order]
    own = _new(keys, at, values)
    if len(drop := np.concatenate(gone)):
        own &= ~np.isin(keys, drop)
    return keys[own], values[own], at[own]


def best_others(rows: DataFrame, key: str, columns: list[tuple[str, int]], n: int, thick: np.ndarray, twins: bool = False) -> DataFrame:
    """key, other, score, rank of the n best others of each item; of equals the lesser key.

    Each column is a bigint or an array<bigint>; the rows of a key are one item, and its sets are those of all of them. Weights are
    positive. An other that shares one value only is beaten by n lesser ones with that value unless it is among the
    first n there, so each value sends its first n to its items. Others that share two values or more meet at the first
    of these: there an item brings its later values. `thick` are values of the greatest weight (in the first column
    that has it) known to have more than n items: whoever has one needs no single values of less weight. With `twins`,
    items that have n + 1 lesser ones of equal sets are set aside, as they are nobody's best, and get what the greatest
    of those gets; this is worth its cost where many sets are equal, and changes no result.
    """
    columns = sorted(columns, key=lambda x: -x[1])
    weight = np.array([w for _, w in columns], np.int64)
    wide = len(columns)
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(thick))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([h[0] for h in held])
            p = _group(keys)
            order = np.lexsort((keys, p))
            counts = [np.concatenate([h[1][c][0] for h in held]) for c in range(wide)]
            values = [np.concatenate([h[1][c][1] for h in held]) for c in range(wide)]
            moved = [v[_ragged((np.cumsum(m) - m)[order], m[order])] for v, m in zip(values, counts, strict=True)]
            counts = [m[order] for m in counts]
            ends = [np.concatenate(([0], np.cumsum(m))) for m in counts]
            keys = keys[order]
            return _batch([(g, _pack(*_steps(keys[a:b]), *(x for c in range(wide) for x in (counts[c][a:b], moved[c][ends[c][a]:ends[c][b]])))) for g, a, b in _slices(p[order])])

        for batch in batches:
            sets = []
            for c in range(wide):
                array = batch.column(c + 1)
                listed = pa.types.is_list(array.type)
                m = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64) if listed else np.ones(len(array), np.int64)
                flat = array.flatten() if listed else array
                if flat.null_count:
                    some = flat.is_valid().to_numpy(zero_copy_only=False)
                    m = np.bincount(np.repeat(np.arange(len(m)), m)[some], minlength=len(m)).astype(np.int64)
                    flat = flat.drop_null()
                sets.append((m, flat.to_numpy(zero_copy_only=False).astype(np.int64)))
                size += len(flat)
            held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sets))
            if size >= BUFFER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_group(batches):
            keys, values, at = _items(blobs, wide)
            if len(keys):
                begin = np.flatnonzero(_new(keys))
                sums = []
                for a in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
                    x = values.astype(np.uint64) * np.uint64(a) + (at + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                    for _ in range(2):
                        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    sums.append(np.add.reduceat(x ^ (x >> np.uint64(29)), begin).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys[begin]), *map(pa.array, sums)], ["k", "s1", "s2"])

    def aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.sort(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            if len(keys):
                p = _group(keys)
                order = np.lexsort((keys, p))
                yield _batch([(g, _pack(*_steps(keys[order][a:b]))) for g, a, b in _slices(p[order])])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, values, tags, later = (np.concatenate([h[i] for h in held]) for i in range(4))
            per = np.concatenate([h[4] for h in held])
            p = _group(values, tags >> 1)
            order = np.lexsort((keys, p))
            total = per.sum(axis=1)
            moved = later[_ragged((np.cumsum(total) - total)[order], total[order])]
            keys, values, tags, per, p = keys[order], values[order], tags[order], per[order], p[order]
            ends = np.concatenate(([0], np.cumsum(total[order])))
            where = _where(per)

            def body(a: int, b: int) -> bytes:
                """Values by column, as those of one column have bits in common."""
                v, at, x, of = values[a:b], tags[a:b] >> 1, moved[ends[a]:ends[b]], where[ends[a]:ends[b]]
                return _pack(*_steps(keys[a:b]), tags[a:b], *per[a:b].T, *(v[at == c] for c in range(wide)), *(x[of == c] for c in range(wide)))

            return _batch([(g, body(a, b)) for g, a, b in _slices(p)])

        for blobs in _by_group(batches):
            keys, values, at = _items(blobs, wide)
            item = np.cumsum(_new(keys)) - 1
            code = item * wide + at
            here = np.arange(len(keys))
            per = np.stack([np.maximum(np.searchsorted(code, item * wide + c, "right") - np.maximum(np.searchsorted(code, item * wide + c, "left"), here + 1), 0) for c in range(wide)], axis=1)
            strong = np.zeros(int(item[-1]) + 1 if len(item) else 0, bool)
            if len(known):
                first = at == 0
                found = np.minimum(np.searchsorted(known, values[first]), len(known) - 1)
                strong[item[first][known[found] == values[first]]] = True
            asks = (weight[at] == weight[0]) | ~strong[item]
            later = values[_ragged(here + 1, per.sum(axis=1))]
            held.append((keys, values, at * 2 + asks, later, per))
            size += len(keys)
            if size >= BUFFER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            x, w, m, first, a, b, s = (np.concatenate([h[i] for h in held]) for i in range(7))
            p, q = _group(x), _group(a)
            order, order2 = np.lexsort((x, p)), np.lexsort((a, q))
            first = first[_ragged((np.cumsum(m) - m)[order], m[order])]
            x, w, m, p = x[order], w[order], m[order], p[order]
            a, b, s, q = a[order2], b[order2], s[order2], q[order2]
            ends = np.concatenate(([0], np.cumsum(m)))
            bodies = {g: [*_steps(x[i:j]), w[i:j], m[i:j], first[ends[i]:ends[j]], _EMPTY, _EMPTY, _EMPTY, _EMPTY] for g, i, j in _slices(p)} if len(p) else {}
            for g, i, j in _slices(q) if len(q) else ():
                bodies.setdefault(g, [_EMPTY] * 9)[5:] = [*_steps(a[i:j]), b[i:j], s[i:j]]
            return _batch([(g, _pack(*arrays)) for g, arrays in bodies.items()])

        for blobs in _by_group(batches):
            keys = np.concatenate([_sum(*b[:2]) for b in blobs])
            tags = np.concatenate([b[2] for b in blobs])
            per = np.concatenate([np.stack(b[3:3 + wide], axis=1) for b in blobs])
            where = _where(per)
            values, later = np.empty(len(tags), np.int64), np.empty(len(where), np.int64)
            for c in range(wide):
                values[tags >> 1 == c] = np.concatenate([b[3 + wide + c] for b in blobs])
                later[where == c] = np.concatenate([b[3 + 2 * wide + c] for b in blobs])
            order = np.lexsort((keys, values, tags >> 1))
            total = per.sum(axis=1)
            later = later[_ragged((np.cumsum(total) - total)[order], total[order])]
            keys, values, tags, per, total = keys[order], values[order], tags[order], per[order], total[order]
            at = tags >> 1
            fresh = _new(at, values)
            g = np.cumsum(fresh) - 1
            begin = np.flatnonzero(fresh)
            end = np.append(begin[1:], len(keys))[g]
            begin = begin[g]
            rank = np.arange(len(keys)) - begin
            # the first n others of the value, without the item itself
            asking = np.flatnonzero((tags & 1 == 1) & (end - begin > 1))
            m = np.minimum(n, (end - begin - 1)[asking])
            j = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            first = keys[np.repeat(begin[asking], m) + j + (np.repeat(rank[asking], m) <= j)]
            # pairs with a later value in common: few rows once those are left out whose mixed value is single
            e = np.repeat(np.arange(len(keys)), total)
            where = _where(per)
            mixed = (later.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((g[e] * wide + where).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            ordered = np.sort(mixed)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            keep = np.flatnonzero(np.isin(mixed, twice))
            e, where, later = e[keep], where[keep], later[keep]
            order = np.lexsort((later, g[e] * wide + where))
            e, where, later = e[order], where[order], later[order]
            run = np.cumsum(_new(g[e], where, later)) if len(e) else e
            ones, others, ws = [_EMPTY], [_EMPTY], [_EMPTY]
            for lag in range(1, len(e)):
                i = np.flatnonzero(run[lag:] == run[:-lag])
                if not len(i):
                    break
                ones.append(e[i])
                others.append(e[i + lag])
                ws.append(weight[where[i]])
            one, other, w = np.concatenate(ones), np.concatenate(others), np.concatenate(ws)
            pair, inverse = np.unique(np.minimum(one, other) * len(keys) + np.maximum(one, other), return_inverse=True)
            score = np.bincount(inverse, w, minlength=len(pair)).astype(np.int64)
            one, other = pair // max(len(keys), 1), pair % max(len(keys), 1)
            score = score + weight[at[one]]
            held.append((keys[asking], weight[at[asking]], m, first, np.concatenate((keys[one], keys[other])), np.concatenate((keys[other], keys[one])), np.concatenate((score, score))))
            size += len(asking) + 2 * len(pair)
            if size >= BUFFER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_group(batches):
            x = np.concatenate([part for b in blobs for part in (np.repeat(_sum(*b[:2]), b[3]), _sum(*b[5:7]))])
            other = np.concatenate([part for b in blobs for part in (b[4], b[7])])
            score = np.concatenate([part for b in blobs for part in (np.repeat(b[2], b[3]), b[8])])
            order = np.lexsort((-score, other, x))
            x, other, score = x[order], other[order], score[order]
            best = _new(x, other)
            x, other, score = x[best], other[best], score[best]
            order = np.lexsort((other, -score, x))
            x, other, score = x[order], other[order], score[order]
            fresh = _new(x)
            rank = np.arange(len(x)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] + 1
            few = rank <= n
            yield pa.RecordBatch.from_arrays([pa.array(x[few]), pa.array(other[few]), pa.array(score[few]), pa.array(rank[few].astype(np.int32))], [key, "other", "score", "rank"])

    packed = rows.selectExpr(f"cast(`{key}` as bigint) as k", *(f"`{c}`" for c, _ in columns)).where("k is not null").mapInArrow(deal, SCHEMA)
    if twins:
        signed = _dealt(packed).mapInArrow(signs, "k bigint, s1 bigint, s2 bigint")
        last = signed.withColumn("r", F.row_number().over(W.partitionBy("s1", "s2").orderBy("k"))).where(F.col("r") == n + 1).select("s1", "s2", F.col("k").alias("last"))
        rest = checkpointed(signed.join(last, ["s1", "s2"]).where("k > last").select("k", "last"))
        packed = packed.unionByName(rest.select("k").mapInArrow(aside, SCHEMA))
    met = _dealt(_dealt(packed).mapInArrow(spread, SCHEMA)).mapInArrow(meet, SCHEMA)
    out = _dealt(met).mapInArrow(choose, f"`{key}` bigint, other bigint, score bigint, rank int")
    if twins:
        out = checkpointed(out)
        out = out.unionByName(rest.join(out.withColumnRenamed(key, "last"), "last").select(F.col("k").alias(key), "other", "score", "rank"))
    return out
