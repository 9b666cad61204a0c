"""Grouped measures: tag windows, period fan-out, timelines, weekly series, verification and rollups.

Each function takes DataFrames and column names and returns a DataFrame; nothing is collected. Only groups and
dimensions are joined, so the fact table is read once. Comparisons that can't be made stay null, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The lengths of the trend periods and the bucket size of each.
PERIODS = ((7, 1), (30, 7), (90, 15), (180, 30), (365, 30))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def tag_windows(rows: DataFrame, tag: str, day: str, today: Column) -> DataFrame:
    """Occurrences per tag: now7 (today and the 7 days before), prev7 (the 7 days before those), last30, before7."""
    d, d7, d14, d30 = F.col(day), F.date_sub(today, 7), F.date_sub(today, 14), F.date_sub(today, 30)
    return rows.groupBy(tag).agg(_count(d >= d7).alias("now7"), _count((d >= d14) & (d < d7)).alias("prev7"), _count(d >= d30).alias("last30"), _count(d < d7).alias("before7"))


def rising_tags(windows: DataFrame, tag: str, least: int = 3, n: int = 10) -> DataFrame:
    """Tags seen at least `least` times lately and more than before, by gain, then count, then name."""
    w = windows.where((F.col("now7") >= least) & (F.col("now7") > F.col("prev7"))).withColumn("delta", F.col("now7") - F.col("prev7"))
    return w.orderBy(F.desc("delta"), F.desc("now7"), F.asc(tag)).limit(n).select(tag, "now7", "prev7", "delta")


def new_tags(windows: DataFrame, tag: str, least: int = 2) -> DataFrame:
    """Tags never seen before the last 7 days that occur at least `least` times since."""
    return windows.where((F.col("before7") == 0) & (F.col("now7") >= least)).select(tag, "now7")


def period_fanout(rows: DataFrame, day: str, end: DataFrame, item: str, source: str, periods: tuple = PERIODS) -> DataFrame:
    """Measures for each period that ends on end.last, and for the period before it.

    end is one row (first, last): the days covered. A period is clamped to the first day; the previous one has measures
    only if it is wholly covered, else nulls. One pass over the rows: each joins the few periods that it belongs to.
    """
    spec = end.select("first", "last", F.explode(F.array(*(F.lit(p) for p, _ in periods))).alias("days"))
    spec = spec.withColumns({"from": F.greatest("first", F.date_sub("last", F.col("days") - 1)), "prev_from": F.date_sub("last", 2 * F.col("days") - 1), "prev_to": F.date_sub("last", F.col("days"))})
    spec = spec.withColumn("covered", F.col("prev_from") >= F.col("first"))
    hit = rows.join(F.broadcast(spec), F.col(day).between(F.least("from", "prev_from"), F.col("last")))
    now, prev = F.col(day) >= F.col("from"), F.col("covered") & F.col(day).between(F.col("prev_from"), F.col("prev_to"))
    agg = hit.groupBy("days").agg(
        _count(now).alias("n"), F.countDistinct(F.when(now, F.col(item))).alias("items"), F.countDistinct(F.when(now, F.col(source))).alias("sources"),
        F.when(F.max("covered"), _count(prev)).alias("prev_n"), F.when(F.max("covered"), F.countDistinct(F.when(prev, F.col(item)))).alias("prev_items"),
    )
    out = spec.join(agg, "days", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("days", "from", F.col("last").alias("to"), zero("n").alias("n"), zero("items").alias("items"), zero("sources").alias("sources"), F.when(F.col("covered"), zero("prev_n")).alias("prev_n"), F.when(F.col("covered"), zero("prev_items")).alias("prev_items"), F.when(F.col("covered"), zero("n") - zero("prev_n")).alias("delta"))


def bucket_timeline(rows: DataFrame, day: str, last: Column, size: int, days: int) -> DataFrame:
    """Counts by buckets of `size` days that walk back from last; empty buckets are left out."""
    back = F.floor(F.datediff(last, F.col(day)) / size).cast("int")
    inside = rows.where(F.datediff(last, F.col(day)).between(0, days - 1)).withColumn("bucket", back)
    return inside.groupBy("bucket").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


def top_in_group(counts: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group."""
    return counts.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def alive_weeks(spans: DataFrame, key: str, first: str, last: str, group: str | None = None) -> DataFrame:
    """(group, week, n): keys alive in each ISO week from their first to their last day, each once.

    Two rows for each span (one enters, one leaves), summed by week and added up over the weeks: spans aren't unrolled. Spans
    of one key and group are united first, so each key needs spans without gaps.
    """
    monday = lambda c: F.date_trunc("week", c).cast("date")
    groups = [group] if group else []
    each = spans.groupBy(*groups, key).agg(F.min(first).alias("__f"), F.max(last).alias("__l")).where("__f is not null and __l is not null")
    steps = each.select(*groups, F.explode(F.array(F.struct(monday(F.col("__f")).alias("w"), F.lit(1).alias("d")), F.struct(F.date_add(monday(F.col("__l")), 7).alias("w"), F.lit(-1).alias("d")))).alias("x"))
    summed = steps.groupBy(*groups, F.col("x.w").alias("__w")).agg(F.sum("x.d").alias("__d"))
    over = W.partitionBy(*groups).orderBy("__w")  # a row a week at most
    level = summed.select(*groups, "__w", F.sum("__d").over(over).alias("n"), F.lead("__w").over(over).alias("__to")).where("n > 0")
    weeks = level.select(*groups, F.explode(F.sequence("__w", F.date_sub("__to", 7), F.expr("INTERVAL 7 DAYS"))).alias("monday"), "n")
    return weeks.select(*groups, iso_week(F.col("monday")).alias("week"), "n")


def iso_week(day: Column) -> Column:
    """YYYY-Www by ISO 8601."""
    return F.concat(F.date_format(F.date_add(F.date_trunc("week", day).cast("date"), 3), "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in order. With a unique order the result doesn't depend on the input's."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def verification(rows: DataFrame, issue: str, source: str, official: Column) -> DataFrame:
    """confirmed by an official source; else cross_checked by two or more independent sources, single with one, else unverified.

    A source that is official once is so for the issue. Two levels of counts: an issue's sources are never gathered.
    """
    per = rows.groupBy(issue, source).agg(F.max(F.coalesce(official, F.lit(False)).cast("int")).alias("__o"))
    named = F.col(source).isNotNull()
    counted = per.groupBy(issue).agg(F.count_if(named & (F.col("__o") == 1)).alias("official"), F.count_if(named & (F.col("__o") == 0)).alias("independent"))
    state = F.when(F.col("official") > 0, "confirmed").when(F.col("independent") >= 2, "cross_checked").when(F.col("independent") == 1, "single").otherwise("unverified")
    return counted.select(issue, "official", "independent", state.alias("state"))


def guarded_rates(rows: DataFrame, group: str, flags: dict[str, Column], least: int = 20) -> DataFrame:
    """Share of each flag by group, null with status insufficient_data below `least` rows."""
    n = F.count("*")
    rates = [F.when(n >= least, F.round(F.avg(c.cast("double")), 6)).alias(k) for k, c in flags.items()]
    return rows.groupBy(group).agg(n.alias("n"), *rates, F.when(n >= least, "ok").otherwise("insufficient_data").alias("status"))


def mode_by_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the alphabetically first of equals."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return first_by(counts, [group], [F.desc("n"), F.asc(value)])


def movers(rows: DataFrame, item: str, day: str, source: str, start: Column, n: int = 4) -> DataFrame:
    """Items since start by occurrences, distinct days and sources; the top n, ties by name."""
    a = rows.where(F.col(day) >= start).groupBy(item).agg(F.count("*").alias("n"), F.countDistinct(day).alias("days"), F.countDistinct(source).alias("sources"), F.max(day).alias("last_seen"))
    return a.orderBy(F.desc("n"), F.desc("days"), F.desc("sources"), F.asc(item)).limit(n)


def lifecycle(rows: DataFrame, issue: str, day: str, today: Column, active_days: int = 7) -> DataFrame:
    """first_seen, last_seen, count, distinct days; active if seen lately, ongoing if seen on more than one day."""
    a = rows.groupBy(issue).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.count("*").alias("n"), F.countDistinct(day).alias("days"))
    return a.withColumns({"lifecycle": F.when(F.datediff(today, "last_seen") <= active_days, "active").otherwise("dormant"), "status": F.when(F.col("days") > 1, "ongoing").otherwise("new")})


def registry_rollup(registry: DataFrame, mentions: DataFrame, key: str, item: str, day: str) -> DataFrame:
    """Distinct items and the latest day for every registry row, with zero counts kept."""
    a = mentions.groupBy(key).agg(F.countDistinct(item).alias("item_count"), F.max(day).alias("latest"))
    return registry.join(a, key, "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def heartbeat(rows: DataFrame, at: str, now: Column, hours: float) -> DataFrame:
    """Latest time, its age in hours and whether it is stale."""
    a = rows.agg(F.max(at).alias("latest"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("latest")) / 3600
    return a.select("latest", F.round(age, 6).alias("age_hours"), F.coalesce(age > hours, F.lit(True)).alias("stale"))


def peak_in_window(rows: DataFrame, group: str, at: str, seconds: int = 60) -> DataFrame:
    """Most rows of a group within any window of `seconds` that ends at a row; the groups' rows are split by time.

    A row counts in its own slot of `seconds` and as a predecessor of the next slot, so that no group is one task.
    """
    micro = F.unix_micros(F.col(at).cast("timestamp"))
    slot = F.floor(micro / F.lit(seconds * 1_000_000))
    base = rows.select(group, micro.alias("__t"), slot.alias("__s"))
    spread = base.select(group, "__t", F.explode(F.array(F.struct(F.col("__s").alias("slot"), F.lit(True).alias("own")), F.struct((F.col("__s") + 1).alias("slot"), F.lit(False).alias("own")))).alias("x")).select(group, "__t", "x.slot", "x.own")
    w = W.partitionBy(group, "slot").orderBy("__t").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    peaks = spread.withColumn("n", F.count("*").over(w)).where("own")
    return peaks.groupBy(group).agg(F.count("*").alias("calls"), F.max("n").alias("peak"))


def daily_share(rows: DataFrame, week: Column, topic: str, item: str) -> DataFrame:
    """Share of each topic in its week's distinct items."""
    a = rows.groupBy(week.alias("week"), topic).agg(F.countDistinct(item).alias("n"))
    total = a.groupBy("week").agg(F.sum("n").alias("total"))
    return a.join(total, "week").withColumn("share", F.round(F.col("n") / F.col("total"), 6))
