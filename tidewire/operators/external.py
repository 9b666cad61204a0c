"""Batch functions supplied by the caller (models, services): run in partitions, matched back by key, failures bounded.

A function takes a list of rows (dicts) and returns {key: result}. It is called with at most `size` rows. A batch that
raises is halved until single rows remain; what still fails gets no result. Rows whose cached result is current aren't
sent. Results are matched by key, never by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BatchFunction = Callable[[list[dict]], dict]


def call_halving(f: BatchFunction, rows: list[dict], key: str, depth: int = 6) -> dict:
    try:
        known = {r[key] for r in rows}
        return {k: v for k, v in f(rows).items() if k in known}
    except Exception:  # noqa: BLE001  the caller's function may fail in any way
        if len(rows) <= 1 or depth == 0:
            return {}
        half = len(rows) // 2
        return call_halving(f, rows[:half], key, depth - 1) | call_halving(f, rows[half:], key, depth - 1)


def apply_batches(rows: DataFrame, f: BatchFunction, key: str, result: str, size: int = 15) -> DataFrame:
    """(key, result columns) for each row that the function answered. result: a DDL schema."""
    kind = T.StructType([rows.schema[key], *T._parse_datatype_string(result).fields])
    names = kind.names[1:]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            todo = pdf.to_dict("records")
            out = []
            for at in range(0, len(todo), size):
                got = call_halving(f, todo[at : at + size], key)
                out += [(k, *(v.get(n) for n in names)) for k, v in got.items()]
            yield pd.DataFrame(out, columns=[key, *names])

    return rows.mapInPandas(run, kind)


def due(rows: DataFrame, cache: DataFrame, key: str, digest: str, version: str, current: str, order: str, most: int = 40) -> DataFrame:
    """Rows without a cached result of this digest and prompt version, at most `most` by order."""
    fresh = cache.where(F.col(version) == current).select(key, F.col(digest).alias("__d"))
    return rows.join(fresh, key, "left").where(F.col("__d").isNull() | (F.col("__d") != F.col(digest))).drop("__d").orderBy(F.desc(order), key).limit(most)


def reopen(cache: DataFrame, overlaps: DataFrame, key: str, step: float = 0.10) -> DataFrame:
    """Cached rejections whose title overlap has since grown by at least `step`."""
    return cache.where("verdict = false").join(overlaps, key).where(F.col("overlap") - F.col("overlap_then") >= step)


def head_groups(rows: DataFrame, order: list, key: str, k: int, groups: Callable[[list[dict]], list[list]]) -> DataFrame:
    """A grouping function on the head of a ranking only (max(3k, 12) rows): the first of each group stays, the tail is untouched."""
    n = max(3 * k, 12)
    head = [r.asDict() for r in rows.orderBy(*order).limit(n).collect()]
    drop: list = []
    try:
        seen: set = set()
        for g in groups(head):
            g = [x for x in g if x not in seen]
            seen.update(g)
            drop += g[1:]
    except Exception:  # noqa: BLE001  a failed grouping keeps all rows
        drop = []
    return rows.where(~F.col(key).isin(drop)) if drop else rows
