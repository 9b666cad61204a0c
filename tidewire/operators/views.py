"""What readers ask for: orders, filters, tracks, resolutions, candidates, and settings with the console's edits laid over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidewire.functions import text as X
from tidewire.operators import search as S

#: Orders by name; later columns break ties.
ORDERS = {
    "catalog": ("-last_seen", "-must_read", "-score", "-card_count"), "visible": ("-article_date", "-briefing_date"), "timeline": ("-article_date", "-briefing_date", "-hash"),
    "recent": ("-last_seen", "-article_count"), "tracked": ("-briefing_count", "-last_seen"), "sources": ("-article_count", "-last_seen"), "fifo": ("pub",),
}
COMMON = "common"


def ordered(rows: DataFrame, order: str, key: str) -> DataFrame:
    """rows in a named order, equal ones by key; nulls last."""
    by = [F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in ORDERS[order]]
    return rows.orderBy(*by, F.asc(key))


def positions(rows: DataFrame, order: str, key: str, group: list[str], n: int | None = None) -> DataFrame:
    """Adds position in a named order within each group; the first n where n is given."""
    by = [F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in ORDERS[order]]
    out = rows.withColumn("position", F.row_number().over(W.partitionBy(*group).orderBy(*by, F.asc(key))))
    return out.where(F.col("position") <= n) if n else out


def fifo_cap(rows: DataFrame, key: str, n: int = 80) -> DataFrame:
    """The n oldest of a queue; the others wait for the next run."""
    return ordered(rows, "fifo", key).limit(n)


def changed_issues(rows: DataFrame, status: str, previous: str, order: str, n: int = 5) -> DataFrame:
    """A briefing's first n issues that go on or have earlier articles, in its own order."""
    return rows.where((F.col(status) == "ongoing") | (F.coalesce(F.col(previous), F.lit(0)) > 0)).orderBy(order).limit(n)


def weekly_changed(rows: DataFrame, key: str, change: str, last_seen: str, cards: str, day: Column, n: int = 5) -> DataFrame:
    """Issues with a line of change whose last article is in the week of `day`, the newest first, then those of most cards."""
    start = S.briefing_week(day)
    wanted = rows.where((F.coalesce(F.col(change), F.lit("")) != "") & F.col(last_seen).between(start, F.date_add(start, 6)))
    return wanted.orderBy(F.desc(last_seen), F.desc(F.coalesce(F.col(cards), F.lit(0))), F.asc(key)).limit(n)


def archive_filter(rows: DataFrame, entity: str | None = None, region: str | None = None, topic: str | None = None, verified: bool | None = None, days: int | None = None, latest: Column | None = None, query: str | None = None, texts: tuple[str, ...] = ("title", "summary")) -> DataFrame:
    """Rows (entities, regions, topics, verification, last_seen, and the texts) that meet every condition that is given."""
    out = rows
    for column, value in (("entities", entity), ("regions", region), ("topics", topic)):
        if value is not None:
            out = out.where(F.array_contains(column, value))
    if verified is not None:
        sure = F.coalesce(F.col("verification").isin("official", "corroborated"), F.lit(False))
        out = out.where(sure if verified else ~sure)
    if days is not None:
        out = out.where(F.datediff(latest, "last_seen") < days)
    return out.where(S.matches_all(F.concat_ws(" ", *texts), query)) if query else out


def entity_counts(issues: DataFrame, issue: str, entities: str, topics: str, last_seen: str, seen: DataFrame, least: int = 3, n: int = 3) -> DataFrame:
    """(entity, issues, new_issues, topics): issues of an entity, those later than the reader has seen, and its commonest topics from `least` issues on."""
    each = issues.select(issue, F.explode(F.array_distinct(entities)).alias("entity"), topics, last_seen)
    marked = each.join(F.broadcast(seen.select("entity", F.col("seen").alias("__seen"))), "entity", "left")
    counts = marked.groupBy("entity").agg(F.count("*").alias("issues"), F.count_if(F.col("__seen").isNull() | (F.col(last_seen) > F.col("__seen"))).alias("new_issues"))
    by_topic = each.select("entity", F.explode(topics).alias("topic")).groupBy("entity", "topic").agg(F.count("*").alias("n"))
    top = by_topic.withColumn("__r", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("n"), F.asc("topic")))).where(F.col("__r") <= n)
    named = top.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "topic"))), lambda x: x["topic"]).alias("topics"))
    none = F.array().cast("array<string>")
    return counts.join(named, "entity", "left").withColumn("topics", F.when(F.col("issues") >= least, F.coalesce("topics", none)).otherwise(none))


def span_track(first: Column, last: Column, start: Column, end: Column) -> Column:
    """struct(left, width, days): where a flow lies on a range in percent, and its days, both ends counted; a flow of a day has no width."""
    to = F.greatest(first, F.coalesce(last, first))
    span = F.greatest(F.datediff(end, start), F.lit(1))
    at = lambda d: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.datediff(d, start) * 100.0 / span))
    days = F.datediff(to, first) + 1
    return F.struct(F.round(at(first), 2).alias("left"), F.round(F.when(days <= 1, 0.0).otherwise(at(to) - at(first)), 2).alias("width"), days.alias("days"))


def resolve_issue(requests: DataFrame, day: str, issue: str, catalog: DataFrame, snapshots: DataFrame, value: str, latest: Column) -> DataFrame:
    """The issue that a reader of a day's briefing sees: of the latest day the catalog's, of older days the briefing's own; the other where one is missing."""
    j = requests.join(catalog.select(issue, F.col(value).alias("__now")), issue, "left").join(snapshots.select(issue, day, F.col(value).alias("__then")), [issue, day], "left")
    return j.withColumn(value, F.when(F.col(day) == latest, F.coalesce("__now", "__then")).otherwise(F.coalesce("__then", "__now"))).drop("__now", "__then")


def publication_shelf(rows: DataFrame, title: str, url: str, organisation: str, technical: str, day: str, key: str, only: str | None = None) -> DataFrame:
    """Publications with a title and a link, of one organisation where it is given; technical ones last, then the newest first."""
    good = rows.where((F.coalesce(F.col(title), F.lit("")) != "") & (F.coalesce(F.col(url), F.lit("")) != ""))
    return (good.where(F.col(organisation) == only) if only else good).orderBy(F.coalesce(F.col(technical), F.lit(False)), F.desc_nulls_last(day), F.asc(key))


def report_candidates(rows: DataFrame, pick: str, why: list[str], order: str, n: int = 6) -> DataFrame:
    """The first n issues with a report topic, each with the first of its reasons that isn't blank."""
    reason = F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in why), F.lit(""))
    return rows.where(F.trim(F.coalesce(F.col(pick), F.lit(""))) != "").orderBy(order).limit(n).withColumn("why", reason)


def material_pack(issues: DataFrame, articles: DataFrame, issue: str, title: str, text: str, source: str, order: str, n: int = 10) -> DataFrame:
    """(issue, pack): an issue's text with numbered notes of its articles and their sources below."""
    ranked = articles.withColumn("__r", F.row_number().over(W.partitionBy(issue).orderBy(order))).where(F.col("__r") <= n)
    notes = ranked.groupBy(issue).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(text).alias("t"), F.col(source).alias("s")))), lambda x: F.format_string("[%d] %s (%s)", x["__r"], x["t"], x["s"])), "\n").alias("notes"))
    return issues.join(notes, issue, "left").select(issue, F.concat_ws("\n\n", title, "notes").alias("pack"))


def overlay(settings: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feed, field, value) with the console's edits (id, at, group, field, action, value, disabled) laid over, and the ids that changed anything.

    Edits apply in order of `at`; those of the group COMMON to every feed. Adding what is there or removing what isn't
    changes nothing and isn't counted. A value's state after the edits before it is a lag over its own history.
    """
    feeds = settings.select("feed").distinct()
    live = edits.where(~F.coalesce("disabled", F.lit(False)) & F.col("action").isin("add", "remove") & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    every = live.where(F.col("group") == COMMON).crossJoin(F.broadcast(feeds))
    own = live.where(F.col("group") != COMMON).join(feeds, live["group"] == feeds["feed"])
    steps = every.unionByName(own).select("feed", "field", F.trim("value").alias("value"), "id", "at", (F.col("action") == "add").alias("present"))
    start = settings.select("feed", "field", "value", F.lit(None).cast(steps.schema["id"].dataType).alias("id"), F.lit(None).cast(steps.schema["at"].dataType).alias("at"), F.lit(True).alias("present"))
    history = W.partitionBy("feed", "field", "value").orderBy(F.asc_nulls_first("at"), F.asc_nulls_first("id"))
    told = start.unionByName(steps).withColumn("before", F.coalesce(F.lag("present").over(history), F.lit(False))).withColumn("last", F.lead("present").over(history).isNull())
    applied = told.where(F.col("id").isNotNull() & (F.col("present") != F.col("before"))).select("id").distinct()
    return told.where("last and present").select("feed", "field", "value"), applied


def briefing_guard(state: DataFrame, job: str, day: Column) -> DataFrame:
    """Jobs (job, last_day) that haven't run on this day yet: decided by state, not by the clock."""
    return state.where(F.col("last_day").isNull() | (F.col("last_day") < day)).select(job)


def article_view(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A projection for serving: text columns are '' and lists empty where the record has none."""
    kinds = rows.select(*(c.alias(n) for n, c in columns.items())).schema
    blank = lambda f: F.lit("") if isinstance(f.dataType, T.StringType) else F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None)
    return rows.select(*(F.coalesce(columns[f.name], blank(f)).alias(f.name) for f in kinds))


def fitted(headline: Column, most: int = 70) -> Column:
    return X.clip(headline, most)
