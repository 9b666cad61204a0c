"""From a queue to a briefing: scores with a fallback, prior coverage, duplicate folding with vetoes, floor, cap and diverse choice."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidewire.functions.gates import bracketless_key
from tidewire.operators import dedup as D
from tidewire.operators import issues as I
from tidewire.operators import ranking as R

#: Hosts that count as primary where a record has no features.
LEGACY_PRIMARY = ("iaea.org", "world-nuclear-news", "khnp.co.kr", "nssc.go.kr", "motie.go.kr", "nrc.gov")
#: How far down the kept rows a semantic check looks, as a multiple of the cap and at least.
HEAD_TIMES, HEAD_LEAST = 3, 12


def grade(importance: Column, category: Column) -> Column:
    """The importance, also where older records keep it in the category; nice_to_know without either."""
    return F.coalesce(importance, F.when(category.isin("must_read", "nice_to_know", "market", "noise"), category), F.lit("nice_to_know"))


def legacy_parts(grade_: Column, section: Column, host: Column, related: Column) -> Column:
    """The score's parts of a record without features: 10 or 5, 2 for the home section, 2 for a primary host, 1 for a related report."""
    h = F.coalesce(host, F.lit(""))
    parts = [
        (F.lit("importance"), F.when(grade_ == "must_read", 10.0).otherwise(5.0)), (F.lit("khnp_section"), F.when(section == "khnp", 2.0).otherwise(0.0)),
        (F.lit("primary_domain"), F.when(F.exists(F.array(*map(F.lit, LEGACY_PRIMARY)), lambda d: F.contains(h, d)), 2.0).otherwise(0.0)), (F.lit("related_reports"), F.when(F.coalesce(related, F.lit(False)), 1.0).otherwise(0.0)),
    ]
    return F.map_filter(F.map_from_arrays(F.array(*(k for k, _ in parts)), F.array(*(v for _, v in parts))), lambda k, v: v != 0)


def title_heads(title: Column) -> Column:
    """The first two characters of each word, so that endings don't count."""
    return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1)), lambda w: F.length(w) >= 2), lambda w: F.substring(w, 1, 2)))


def heads_alike(a: Column, b: Column) -> Column:
    """At least SHARED heads in common, by Jaccard or by containment in the shorter."""
    both = F.size(F.array_intersect(a, b))
    return (both >= D.SHARED) & ((both >= D.JACCARD * F.size(F.array_union(a, b))) | (both >= D.CONTAINMENT * F.least(F.size(a), F.size(b))))


#: How many archived and how many new titles meet in one group.
OLD_BLOCK, NEW_BLOCK = 4096, 2048


def prior_coverage(rows: DataFrame, key: str, title: str, archive: DataFrame, archive_title: str, ratio: float = D.TITLE_RATIO) -> DataFrame:
    """(key, prior): how many archived titles tell the same event, by heads or by difflib's ratio of the bare titles.

    Every distinct new title meets every distinct archived one in blocks, inside a task: heads in common are a product of
    matrices, and lengths, letters and common subsequences leave few pairs to difflib. Only counts leave the task.
    """
    def side(df: DataFrame, *more: Column) -> DataFrame:
        return df.select("raw", title_heads(F.col("raw")).alias("h"), bracketless_key(F.col("raw")).alias("t"), *more)

    told = archive.where(F.coalesce(F.col(archive_title), F.lit("")) != "").select(F.col(archive_title).alias("raw"))
    asked = rows.where(F.coalesce(F.col(title), F.lit("")) != "").select(F.col(title).alias("raw")).distinct()
    parts, blocks = max(1, -(-told.count() // OLD_BLOCK)), max(1, -(-asked.count() // NEW_BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("raw"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    old = side(told.groupBy("raw").agg(F.count("*").alias("n")), "n").withColumn("part", dealt(parts)).withColumn("block", every(blocks))
    new = side(asked).withColumn("block", dealt(blocks)).withColumn("part", every(parts))

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"raw": pd.Series(dtype=str), "prior": pd.Series(dtype="int64")})
        place = {h: i for i, h in enumerate(sorted({h for hs in a["h"] for h in hs}))}
        both = heads(a["h"], place) @ heads(b["h"], place).T
        x, y = a["h"].map(len).to_numpy()[:, None], b["h"].map(len).to_numpy()[None, :]
        same = (both >= D.SHARED) & ((both >= D.JACCARD * (x + y - both)) | (both >= D.CONTAINMENT * np.minimum(x, y)))
        same |= D.close_titles(a["t"].tolist(), b["t"].tolist(), ratio)
        return pd.DataFrame({"raw": a["raw"], "prior": same @ b["n"].to_numpy()})

    def heads(lists: pd.Series, place: dict[str, int]) -> np.ndarray:
        out = np.zeros((len(lists), len(place)), np.float32)
        for row, hs in zip(out, lists, strict=True):
            row[[place[h] for h in hs if h in place]] = 1
        return out

    same = new.groupBy("part", "block").cogroup(old.groupBy("part", "block")).applyInPandas(count, "raw string, prior long").groupBy("raw").agg(F.sum("prior").alias("prior"))
    return rows.select(key, F.col(title).alias("raw")).join(same, "raw", "left").select(key, F.coalesce("prior", F.lit(0)).alias("prior"))


def fold_duplicates(rows: DataFrame, group: list[str], key: str, title: str, tags: str, score: str, order: str, ratio: float = D.TITLE_RATIO) -> DataFrame:
    """(group, key, kept, dup_of): best score first (then `order`), a row folds into the first kept one that tells the same event.

    The same event by title, or by a unit and a tag in common; units in conflict veto both. A group is one pool of one run.
    """
    kind = rows.schema[key].dataType
    schema = T.StructType([*(rows.schema[g] for g in group), T.StructField(key, kind), T.StructField("kept", T.BooleanType()), T.StructField("dup_of", kind)])
    fed = rows.select(*group, key, score, order, F.col(title).alias("__title"), bracketless_key(F.col(title)).alias("__bare"), title_heads(F.col(title)).alias("__heads"), I.title_units(F.col(title)).alias("__units"), I.plain_tags(F.col(tags)).alias("__tags"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values([score, order, key], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        signs = [(b, set(h), set(u), set(t)) for b, h, u, t in zip(ordered["__bare"], ordered["__heads"], ordered["__units"], ordered["__tags"], strict=True)]
        kept: list[int] = []
        into: list[int | None] = []
        for i, sign in enumerate(signs):
            hit = next((k for k in kept if alike(sign, signs[k])), None)
            into.append(hit)
            if hit is None:
                kept.append(i)
        out = ordered[[*group, key]].copy()
        out["kept"] = [x is None for x in into]
        out["dup_of"] = pd.Series([None if x is None else ordered[key].iloc[x] for x in into], dtype=object)
        return out

    def alike(a: tuple, b: tuple) -> bool:
        if a[2] and b[2] and not a[2] & b[2]:
            return False
        both = len(a[1] & b[1])
        by_heads = both >= D.SHARED and (both >= D.JACCARD * len(a[1] | b[1]) or both >= D.CONTAINMENT * min(len(a[1]), len(b[1])))
        if by_heads or (a[2] & b[2] and a[3] & b[3]):
            return True
        x, y = a[0], b[0]
        return bool(x and y) and 2 * min(len(x), len(y)) >= ratio * (len(x) + len(y)) and difflib.SequenceMatcher(None, x, y).ratio() >= ratio

    return fed.groupBy(*group).applyInPandas(fold, schema)


def rank_and_select(rows: DataFrame, group: list[str], key: str, title: str, tags: str, score: str, grade_: str, has_features: str, topic: str, queued: str, floor: dict[str, float] | None = None, cap: dict[str, int] | None = None, k: int = 10, surge: int = 0, semantic: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(group, key, outcome, dup_of, adjusted, rank) for every row: selected, duplicate, semantic_duplicate, below_floor or not_selected.

    In order: duplicates are folded, the head of what is kept may be checked by meaning (semantic: head rows -> keys to
    drop), the floor cuts, the cap follows from what is left, and a diverse choice fills it. The floor comes before
    diversity, so that no topic's penalty counts against it.
    """
    folded = fold_duplicates(rows, group, key, title, tags, score, queued)
    pool = rows.join(folded.select(*group, key, "kept", "dup_of"), [*group, key])
    kept = pool.where("kept")
    dropped = None
    if semantic is not None:
        first = W.partitionBy(*group).orderBy(F.desc(score), F.asc(queued), F.asc(key))
        most = max(HEAD_TIMES * k, HEAD_LEAST)
        dropped = semantic(kept.withColumn("__head", F.row_number().over(first)).where(F.col("__head") <= most).drop("__head")).select(key).distinct()
        kept = kept.join(dropped, key, "left_anti")
    passes = R.floor_verdict(F.col(score), F.col(grade_), F.col(has_features), floor or {})["passes"]
    passing = kept.where(passes)
    if cap:
        counted = passing.groupBy(*group).agg(F.count("*").alias("__eligible"), F.count_if(F.col(grade_) == "must_read").alias("__must"))
        size = R.adaptive_cap(F.col("__eligible"), F.col("__must"), cap["base"], cap["max"], surge=surge)
        passing = passing.join(counted.select(*group, size.alias("__k")), group)
    else:
        passing = passing.withColumn("__k", F.lit(k))
    chosen = R.select_diverse(passing, group, topic, score, [queued, key], F.col("__k")).select(*group, key, F.round("adjusted", 6).alias("adjusted"), "rank")
    out = pool.join(chosen, [*group, key], "left").join(passing.select(*group, key, F.lit(True).alias("__passed")), [*group, key], "left")
    if dropped is not None:
        out = out.join(dropped.withColumn("__meant", F.lit(True)), key, "left")
    else:
        out = out.withColumn("__meant", F.lit(None).cast("boolean"))
    outcome = F.when(~F.col("kept"), "duplicate").when(F.col("__meant"), "semantic_duplicate").when(F.col("__passed").isNull(), "below_floor").when(F.col("rank").isNotNull(), "selected").otherwise("not_selected")
    return out.select(*group, key, outcome.alias("outcome"), "dup_of", "adjusted", "rank")


def region_stats(outcomes: DataFrame, rows: DataFrame, group: list[str], key: str, has_features: str) -> DataFrame:
    """Diagnostics of a run: candidates, selected, below the floor, without features."""
    j = outcomes.join(rows.select(*group, key, has_features), [*group, key])
    return j.groupBy(*group).agg(F.count("*").alias("candidate_count"), F.count_if(F.col("outcome") == "selected").alias("selected_count"), F.count_if(F.col("outcome") == "below_floor").alias("below_floor_count"), F.count_if(~F.col(has_features)).alias("features_missing"))


def floors(config: dict, region: str) -> dict[str, float]:
    """Limits per grade of a region from a configuration; keys that begin with _ and values that are no numbers are left out."""
    raw = config.get("selection_floor")
    picked = {g: v.get(region) if isinstance(v, dict) else v for g, v in raw.items() if not g.startswith("_")} if isinstance(raw, dict) else {}
    return {g: float(v) for g, v in picked.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and np.isfinite(v)}
