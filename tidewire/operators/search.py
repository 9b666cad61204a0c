"""The query layer: faceted filters, token search, scored search, facets, related items, trend rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, ShortType
from pyspark.sql.window import Window as W

from tidewire.operators import overlap as O

INTEGRAL = (ByteType, ShortType, IntegerType, LongType)


def fold(c: Column) -> Column:
    """Lower case without white space, hyphens, dots and slashes."""
    return F.regexp_replace(F.lower(c), r"[\s\-./]+", "")


def matches_all(text: Column, query: str) -> Column:
    """Every token of the query occurs in the text, both folded; an empty query matches all."""
    tokens = [t for t in query.lower().split() if t]
    out = F.lit(True)
    for t in tokens:
        out = out & F.contains(fold(text), fold(F.lit(t)))
    return out


def facets(rows: DataFrame, equal: dict[str, object], day: str | None = None, today: Column | None = None, days: int | None = None, text: str | None = None, query: str = "") -> DataFrame:
    """Conjunction of equality facets (None: any), age below days and a token query; equality reaches the scan."""
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == F.lit(v))
    if days is not None:
        rows = rows.where(F.datediff(today, F.col(day)) < days)
    return rows.where(matches_all(F.col(text), query)) if query else rows


def scored_search(rows: DataFrame, query: str, fields: list[tuple[str, int]], order: list[Column], n: int = 10, extra: Column | None = None) -> DataFrame:
    """The sum of the weights of all matching fields (plus extra on hits), best first."""
    score = sum((F.when(matches_all(F.col(c), query), w).otherwise(0) for c, w in fields), F.lit(0))
    hit = rows.withColumn("score", score).where("score > 0")
    if extra is not None:
        hit = hit.withColumn("score", F.col("score") + extra)
    return hit.orderBy(F.desc("score"), *order).limit(n)


def ladder_search(rows: DataFrame, query: str, fields: list[tuple[str, int]], order: list[Column], n: int = 10) -> DataFrame:
    """The weight of the first field that matches."""
    case = F.lit(0)
    for c, w in reversed(fields):
        case = F.when(matches_all(F.col(c), query), w).otherwise(case)
    return rows.withColumn("score", case).where("score > 0").orderBy(F.desc("score"), *order).limit(n)


#: A value that more items carry than this is common: items meet over it by signature, not one by one.
COMMON_VALUE = 1000
#: Values of which it is noted that many items carry them, at most about this many.
THICK_VALUES = 2_000_000


def _whole(rows: DataFrame, c: str) -> Column:
    """Whole numbers, one or a set, as they are; any others by the XXH64 of their text."""
    kind = rows.schema[c].dataType
    if not isinstance(kind, ArrayType):
        return F.col(c).cast("bigint") if isinstance(kind, INTEGRAL) else F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string")))
    return F.col(c).cast("array<bigint>") if isinstance(kind.elementType, INTEGRAL) else F.transform(F.filter(c, lambda v: v.isNotNull()), lambda v: F.xxhash64(v.cast("string")))


def _sets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with an array of one value where a column holds single values."""
    return rows.withColumns({c: F.array(c) for c in columns if not isinstance(rows.schema[c].dataType, ArrayType)})


def related(items: DataFrame, key: str, parts: list[tuple[str, int]], n: int = 3, common: int = COMMON_VALUE) -> DataFrame:
    """For each item the n others with the greatest weighed overlap of its sets; of equals the lesser key.

    A part is a set or a single value; the rows of a key are one item. What a sample of the items shows (values that are common, sets that many items
    share) decides on the way only, not on the result: without common values it is overlap.best_others, else pairs
    over rare values and signatures of the common ones.
    """
    if not isinstance(items.schema[key].dataType, INTEGRAL) or any(w <= 0 for _, w in parts):
        return _related_by_pairs(items, key, parts, n, common)
    rows = items.select(key, *(_whole(items, c).alias(c) for c, _ in parts))
    every = 64 if common >= 1000 else 1
    columns = [c for c, _ in parts]
    part = _sets(rows.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0), columns)
    sets = part.groupBy(key).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c, _ in parts)).groupBy(*columns).agg(F.count("*").alias("n")).persist()
    seen = sets.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("equal"), F.max("n").alias("most")).first()
    twins = (seen["equal"] or 0) * 4 > (seen["items"] or 0) or (seen["most"] or 0) * every > common
    met = [sets.select(F.explode(c).alias("v")).groupBy("v").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("values")).first() for c in columns]
    sets.unpersist()
    if any((m["most"] or 0) * every > common for m in met):
        return _related_by_pairs(items, key, parts, n, common)
    first = max(range(len(parts)), key=lambda i: parts[i][1])
    some = -(-met[first]["values"] // THICK_VALUES) or 1
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(7, `{key}`), 64) as int))")
    held = _sets(rows.where(F.pmod(F.xxhash64(key), F.lit(min(every, 4))) == 0), columns).select(F.explode(parts[first][0]).alias("v"), bit.alias("b")).where(F.pmod(F.xxhash64("v"), F.lit(some)) == 0)
    thick = held.groupBy("v").agg(F.bit_count(F.bit_or("b")).alias("n")).where(F.col("n") > n).select("v").where("v is not null").toArrow().column(0).to_numpy()
    out = O.best_others(rows, key, parts, n, thick, twins)
    kind = items.schema[key].dataType
    return out.select(F.col(key).cast(kind), F.col("other").cast(kind), "score", "rank")


def _related_by_pairs(items: DataFrame, key: str, parts: list[tuple[str, int]], n: int, common: int) -> DataFrame:
    """related where values are common or keys no whole numbers.

    Items meet over rare values pair by pair. Common ones would make pairs of all that carry them; there each set of
    common values is a signature, signatures meet, and an item gets the n + 1 best others by its signature alone. No
    other can be among its first n without a rare value in common, so the result is that of all pairs.
    """
    items = _sets(items, [c for c, _ in parts])

    def tagged(c: str, w: int) -> Column:
        return F.transform(F.array_distinct(c), lambda v: F.struct(F.concat(F.lit(f"{c}:"), v.cast("string")).alias("v"), F.lit(w).alias("w")))

    long = items.select(key, F.explode(F.flatten(F.array(*(tagged(c, w) for c, w in parts)))).alias("x")).select(key, "x.v", "x.w").where("v is not null").dropDuplicates([key, "v"])
    frequent = long.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > common).select("v")
    few = frequent.limit(1).count() == 0
    rare = long if few else long.join(frequent, "v", "left_anti")
    light = rare.join(rare.select(F.col(key).alias("other"), "v"), "v").where(F.col(key) != F.col("other")).groupBy(key, "other").agg(F.sum("w").alias("s"))
    if few:
        total = light.withColumnRenamed("s", "score")
    else:
        heavy = long.join(frequent, "v").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("v", "w"))).alias("values")).withColumn("sign", F.xxhash64(F.col("values").cast("string")))
        signs = heavy.groupBy("sign").agg(F.first("values").alias("values")).select("sign", F.explode("values").alias("x")).select("sign", "x.v", "x.w")
        met = signs.join(signs.select(F.col("sign").alias("sign2"), "v"), "v").groupBy("sign", "sign2").agg(F.sum("w").alias("h"))
        own = heavy.select(key, "sign")
        first = own.withColumn("__r", F.row_number().over(W.partitionBy("sign").orderBy(key))).where(F.col("__r") <= n + 1).select(F.col("sign").alias("sign2"), F.col(key).alias("other"))
        best = met.join(first, "sign2").withColumn("__r", F.row_number().over(W.partitionBy("sign").orderBy(F.desc("h"), "other"))).where(F.col("__r") <= n + 1).select("sign", "other", "h")
        alone = own.join(best, "sign").where(F.col(key) != F.col("other")).select(key, "other", F.col("h").alias("score"))
        named = light.join(own, key, "left").join(own.select(F.col(key).alias("other"), F.col("sign").alias("sign2")), "other", "left").join(met, ["sign", "sign2"], "left")
        both = named.select(key, "other", (F.col("s") + F.coalesce("h", F.lit(0))).alias("score"))
        total = both.unionByName(alone).groupBy(key, "other").agg(F.max("score").alias("score"))
    return total.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "other"))).where(F.col("rank") <= n)


def facet_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))


def briefing_week(day: Column) -> Column:
    """The Saturday that opens a day's Saturday-to-Friday week."""
    return F.date_sub(F.next_day(day, "Sat"), 7)


def share_trend(counts: DataFrame, topic: str, week: str, n: str, least_points: float = 8.0, least_sample: int = 8) -> DataFrame:
    """First and last week's share of each topic in percent; directional if they differ enough on enough data."""
    total = W.partitionBy(week)
    shared = counts.withColumn("total", F.sum(n).over(total)).withColumn("share", F.round(100 * F.col(n) / F.col("total"), 6))
    a = shared.groupBy(topic).agg(F.min_by("share", week).alias("first_share"), F.max_by("share", week).alias("last_share"), F.sum(n).alias("n"))
    change = F.round(F.col("last_share") - F.col("first_share"), 6)
    return a.withColumns({"change": change, "direction": F.when((F.abs(change) >= least_points) & (F.col("n") >= least_sample), F.when(change > 0, "up").otherwise("down")).otherwise("flat")})


def keyword_rows(now: DataFrame, before: DataFrame, key: str, n: str) -> DataFrame:
    """Full outer join of two counts; rows with neither are dropped."""
    a, b = now.select(key, F.col(n).alias("now")), before.select(key, F.col(n).alias("before"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, key, "full").select(key, zero("now").alias("now"), zero("before").alias("before")).where("now + before > 0")


def rollup_to_parent(counts: DataFrame, child: str, n: str, dim: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """Sums to every parent of the dimension, zeros kept, with the share of what is mapped."""
    a = counts.join(F.broadcast(dim), child).groupBy(parent).agg(F.sum(n).alias("n"))
    out = parents.join(a, parent, "left").select(parent, F.coalesce("n", F.lit(0)).alias("n"))
    total = out.agg(F.sum("n").alias("__t"))
    return out.crossJoin(F.broadcast(total)).select(parent, "n", F.when(F.col("__t") > 0, F.round(F.col("n") / F.col("__t"), 6)).alias("share"))
