"""What models are asked and what is believed of their answers: salvage, range and type checks, reject reasons, fallbacks, pacing.

Requests are rows (batch, idx, ...), answers rows (batch, payload). An answer is read in the JVM; what is out of range, of
another type or says nothing gives no row, so a failed batch changes nothing. Calls themselves are the caller's
(operators/external.py).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions import fields as P
from tidewire.functions import gates as G
from tidewire.functions import text as X

#: Limits of texts, the least score of a cluster, copies of a member, seconds between calls and of all waits.
LEAD_LIMIT, INSIGHT_LIMIT, LEAST_SCORE, COPY_RATIO = 90, 120, 6.0, 0.75
SPACING, WAITS, WAIT_MOST, WAIT_MORE, DAILY_DELAY = 4.0, 300.0, 90.0, 2.0, 300.0
DAILY = ("PerDay", "per day", "daily")
RELEVANCE = ("core", "adjacent", "off")


# ---- answers


def salvaged(payload: Column) -> Column:
    """The JSON object of an answer: without code fences and words around it; raw line breaks in strings become blanks where that mends it. Null if nothing does."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(payload, F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    flat = F.regexp_replace(body, r"[\r\n]", " ")
    return F.when(F.try_parse_json(body).isNotNull(), body).when(F.try_parse_json(flat).isNotNull(), flat)


def items(answers: DataFrame, requests: DataFrame, name: str, schema: str) -> DataFrame:
    """Requests with the item that answers them: by batch and idx (a whole number, as text too); the last of several. Others give no row."""
    rows = answers.select("batch", F.posexplode(F.from_json(salvaged(F.col("payload")), f"{name} array<struct<idx:string,{schema}>>")[name]).alias("at", "item"))
    numbered = rows.where("item is not null").select("batch", F.col("item.idx").try_cast("int").alias("idx"), "at", "item").where("idx is not null")
    last = numbered.groupBy("batch", "idx").agg(F.max_by("item", "at").alias("item"))
    return requests.join(last, ["batch", "idx"])


def one_line(c: Column, most: int | None = None) -> Column:
    line = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.substring(line, 1, most) if most else line


def curations(answers: DataFrame, requests: DataFrame, schema: str) -> DataFrame:
    """Curated items by the hash that each carries, not by their place; items of unknown hashes are nobody's."""
    rows = answers.select(F.explode(F.from_json(salvaged(F.col("payload")), f"items array<struct<hash:string,{schema}>>")["items"]).alias("item")).where("item.hash is not null")
    return requests.join(rows.groupBy(F.col("item.hash").alias("hash")).agg(F.first("item").alias("item")), "hash")


def fallback_curation(articles: DataFrame) -> DataFrame:
    """What stands for a curation that failed: the article's own title and section, graded nice_to_know, without a summary. Titles that aren't Korean are not published so."""
    return articles.where(F.col("title").rlike("[가-힣]")).select("hash", F.lit("nice_to_know").alias("importance"), P.default_section(F.col("domain"), F.col("title")).alias("section"), F.col("title").alias("title_kr"), F.lit("").alias("summary"), F.lit(True).alias("fallback"))


def cluster_scores(answers: DataFrame, requests: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """All requests with ai_score (clamped to 0-10), ai_reason, ai_tags and kept: a missing score passes, as all do when the call failed."""
    got = items(answers, requests, "scores", "score:double,reason:string,tags:array<string>").where("item.score is not null")
    scored = got.select("batch", "idx", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("item.score"))).alias("ai_score"), F.substring(F.coalesce("item.reason", F.lit("")), 1, 200).alias("ai_reason"), F.slice(F.transform(F.coalesce("item.tags", F.array().cast("array<string>")), lambda t: F.substring(t, 1, 30)), 1, 3).alias("ai_tags"))
    return requests.join(scored, ["batch", "idx"], "left").withColumn("kept", F.col("ai_score").isNull() | (F.col("ai_score") >= least))


def verdicts(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """(..., same, reason) of pairs; only a JSON boolean is a verdict."""
    got = items(answers, requests, "items", "same_event:boolean,reason:string").where("item.same_event is not null")
    return got.select(*requests.columns, F.col("item.same_event").alias("same"), F.substring(F.coalesce("item.reason", F.lit("")), 1, 60).alias("reason"))


def groups(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds group: the least idx of the group that an answer puts a request in; one of its own where it is in none. The first group counts."""
    rows = answers.select("batch", F.posexplode(F.from_json(salvaged(F.col("payload")), "groups array<array<int>>")["groups"]).alias("g", "members"))
    each = rows.select("batch", "g", F.explode("members").alias("idx")).join(requests.select("batch", "idx"), ["batch", "idx"])
    first = each.groupBy("batch", "idx").agg(F.min("g").alias("g"))
    named = first.withColumn("group", F.min("idx").over(W.partitionBy("batch", "g"))).select("batch", "idx", "group")
    return requests.join(named, ["batch", "idx"], "left").withColumn("group", F.coalesce("group", "idx"))


def insights(answers: DataFrame, requests: DataFrame, title: str, members: str) -> DataFrame:
    """(..., insight, rejected): an insight, or why it isn't used: too_long, hollow, restates_title, copies_member. Blank ones give no row."""
    got = items(answers, requests, "items", "insight:string").withColumn("insight", one_line(F.col("item.insight"))).where("insight <> ''")
    told = F.transform(F.coalesce(F.col(members), F.array().cast("array<string>")), lambda m: X.words(m))
    got = got.withColumn("__mine", X.words(F.col("insight"))).withColumn("__copies", F.exists(told, lambda t: X.containment(F.col("__mine"), t) >= COPY_RATIO))
    why = F.when(F.length("insight") > INSIGHT_LIMIT, "too_long").when(G.hollow(F.col("insight")), "hollow")
    judged = got.withColumn("rejected", why).withColumn("__again", G.restates_title(F.col("insight"), F.col(title)))
    rejected = F.coalesce("rejected", F.when(F.col("__again"), "restates_title").when(F.col("__copies"), "copies_member"), F.lit(""))
    return judged.select(*requests.columns, F.when(rejected == "", F.col("insight")).otherwise("").alias("insight"), rejected.alias("rejected"))


def translations(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """(..., title_kr, gist, off_topic, off_topic_reason, relevance) where a title came back; only a JSON true is off topic, unknown relevance is the mildest."""
    got = items(answers, requests, "items", "title_kr:string,gist:string,off_topic:boolean,off_topic_reason:string,relevance:string")
    rel = F.lower(F.trim(F.coalesce("item.relevance", F.lit(""))))
    off = F.coalesce("item.off_topic", F.lit(False))
    return got.where(one_line(F.col("item.title_kr")) != "").select(*requests.columns, one_line(F.col("item.title_kr"), 160).alias("title_kr"), one_line(F.col("item.gist"), 80).alias("gist"), off.alias("off_topic"), F.when(off, one_line(F.col("item.off_topic_reason"), 60)).alias("off_topic_reason"), F.when(rel.isin(*RELEVANCE), rel).otherwise(RELEVANCE[0]).alias("relevance"))


def investments(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """All requests with theme, direction and horizon; unknown words are none, a failed call leaves all three null."""
    got = items(answers, requests, "items", "theme:string,direction:string,horizon:string")
    word = lambda c, allowed: F.when(F.lower(F.trim(F.col(c))).isin(*allowed), F.lower(F.trim(F.col(c)))).otherwise("none")
    named = got.select("batch", "idx", F.coalesce(F.nullif(one_line(F.col("item.theme"), 40), F.lit("")), F.lit("none")).alias("theme"), word("item.direction", ("positive", "negative", "neutral", "mixed")).alias("direction"), word("item.horizon", ("short", "mid", "long")).alias("horizon"))
    return requests.join(named, ["batch", "idx"], "left")


def recommendations(answers: DataFrame, requests: DataFrame, most: int = 2) -> DataFrame:
    """At most `most` recommended reports of each batch, in the answer's order, with a topic; candidates were gated before they were asked."""
    rows = answers.select("batch", F.posexplode(F.from_json(salvaged(F.col("payload")), "recommendations array<struct<idx:string,topic:string,angles:array<string>>>")["recommendations"]).alias("at", "item"))
    good = rows.select("batch", F.col("item.idx").try_cast("int").alias("idx"), "at", one_line(F.col("item.topic")).alias("topic"), F.slice(F.coalesce("item.angles", F.array().cast("array<string>")), 1, 3).alias("angles")).where("topic <> ''")
    once = good.groupBy("batch", "idx").agg(F.min(F.struct("at", "topic", "angles")).alias("f")).join(requests.select("batch", "idx"), ["batch", "idx"])
    ranked = once.withColumn("__r", F.row_number().over(W.partitionBy("batch").orderBy("f.at"))).where(F.col("__r") <= most)
    return ranked.select("batch", "idx", "f.topic", "f.angles")


def weekly_synthesis(answers: DataFrame) -> DataFrame:
    """(batch, headline, key_events, policy_shifts, theme_moves): lists are lists whatever came back, at most five events; a failed call is an empty report."""
    row = "array<struct<text:string,evidence_hashes:array<string>>>"
    got = answers.select("batch", F.from_json(salvaged(F.col("payload")), f"headline string, key_events array<string>, policy_shifts {row}, theme_moves {row}").alias("r"))
    some = lambda c, kind: F.coalesce(F.filter(F.col(f"r.{c}"), lambda x: x.isNotNull()), F.array().cast(kind))
    return got.select("batch", one_line(F.col("r.headline")).alias("headline"), F.slice(some("key_events", "array<string>"), 1, 5).alias("key_events"), some("policy_shifts", row).alias("policy_shifts"), some("theme_moves", row).alias("theme_moves"))


def directions(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """Keywords with the direction that the answer gives them, by keyword where it is named and by place else; blank ones give no row."""
    got = items(answers, requests, "items", "keyword:string,direction:string").where(one_line(F.col("item.direction")) != "")
    return got.where(F.col("item.keyword").isNull() | (F.lower(F.trim("item.keyword")) == F.lower(F.trim("keyword")))).select(*requests.columns, one_line(F.col("item.direction")).alias("direction"))


def checked_cards(cards: DataFrame, answers: DataFrame) -> DataFrame:
    """Cards (batch, idx, why, investment, kr_takeaway) without the fields that a check found unsupported; a failed check changes nothing."""
    rows = answers.select("batch", F.explode(F.from_json(salvaged(F.col("payload")), "unsupported array<struct<idx:int,fields:array<string>>>")["unsupported"]).alias("u"))
    bad = rows.select("batch", "u.idx", F.explode("u.fields").alias("f")).groupBy("batch", "idx").agg(F.collect_set(F.lower(F.trim("f"))).alias("__bad"))
    j = cards.join(bad, ["batch", "idx"], "left")
    drop = lambda c, name: F.when(~F.coalesce(F.array_contains("__bad", name), F.lit(False)), F.col(c)).alias(c)
    named = {"why": "why", "investment": "invest", "kr_takeaway": "kr"}
    return j.select(*(drop(c, named[c]) if c in named else F.col(c) for c in cards.columns))


def lead(ask: Callable[[str], str], message: str, names_facts: Callable[[str], bool], limit: int = LEAD_LIMIT) -> tuple[str, bool]:
    """(lead, cut): asks once; again if the lead names no facts, and none is better than a vague one; again shorter if it is too long; then cuts it at a clause."""
    def tried(extra: str) -> str:
        try:
            return " ".join((ask(f"{message}\n\n{extra}") or "").split())
        except Exception:  # noqa: BLE001  the caller's model may fail in any way
            return ""

    first = " ".join((ask(message) or "").split())
    if first and not names_facts(first):
        first = tried(f"Name the facts of the two largest items instead of: {first}")
        if not first or not names_facts(first):
            return "", False
    if len(first) <= limit:
        return first, False
    short = tried(f"Say this in at most {limit} characters: {first}")
    if short and len(short) <= limit:
        return short, False
    head = first[: limit - 1]
    at = max(head.rfind(","), head.rfind(" ") if head.rfind(",") < limit // 2 else -1)
    return (head[:at] if at > 0 else head).rstrip(" ,") + "…", True


# ---- requests


def messages(rows: DataFrame, batch: str, order: str, line: Column, size: int = 15) -> DataFrame:
    """(batch, part, message): the lines of each batch, numbered from 0 in chunks of `size`, as one text."""
    placed = rows.withColumn("__n", F.row_number().over(W.partitionBy(batch).orderBy(order)) - 1)
    placed = placed.withColumns({"part": F.floor(F.col("__n") / size).cast("int"), "__i": F.col("__n") % size})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", line.alias("t")))), lambda x: F.format_string("[%d] %s", x["__i"], x["t"])), "\n")
    return placed.groupBy(batch, "part").agg(text.alias("message"))


def failure_label(message: Column) -> Column:
    """quota (don't call again), timeout and truncated (call again with less), other."""
    m = F.coalesce(message, F.lit(""))
    return F.when(m.rlike("RESOURCE_EXHAUSTED|HTTP 429"), "quota").when(m.rlike("(?i)timed out") | F.contains(m, F.lit("TimeoutError")), "timeout").when(m.rlike("(?i)truncated|MAX_TOKENS"), "truncated").otherwise("other")


def retry_delay(body: Column) -> Column:
    """Seconds that a server asks for, with some more, at most WAIT_MOST; null where it asks for none."""
    raw = F.coalesce(*(F.nullif(F.regexp_extract(body, p, 1), F.lit("")).try_cast("double") for p in (r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"', r"(?i)retry in (\d+(?:\.\d+)?)\s*s")))
    return F.when(raw > 0, F.least(raw + WAIT_MORE, F.lit(WAIT_MOST)))


def daily_quota(body: Column) -> Column:
    """Whether a refusal is for the day: its marks, unless the server asks for a short wait."""
    raw = F.coalesce(*(F.nullif(F.regexp_extract(body, p, 1), F.lit("")).try_cast("double") for p in (r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"', r"(?i)retry in (\d+(?:\.\d+)?)\s*s")))
    return ~F.coalesce((raw > 0) & (raw <= DAILY_DELAY), F.lit(False)) & F.exists(F.array(*map(F.lit, DAILY)), lambda m: F.contains(body, m))


@dataclass
class Pacer:
    """Spaces the driver's calls and bounds all its waits together; clock and sleep can be replaced in tests."""

    spacing: float = SPACING
    budget: float = WAITS
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = field(default=None, init=False)

    def before_call(self) -> None:
        if self.last is not None and (left := self.spacing - (self.clock() - self.last)) > 0:
            self.sleep(left)
        self.last = self.clock()

    def wait(self, seconds: float) -> bool:
        """Sleeps if the budget allows it; False means that the call is given up."""
        if seconds > self.budget:
            return False
        self.budget -= seconds
        self.sleep(seconds)
        return True


# ---- social clusters and the outbox


def boosted(score: Column, meta: Column, handles: list[str], subs: list[str], tier: Column) -> Column:
    """A cluster's score with 25 for a credible handle, 15 for a policy forum, 40 or 20 for a source of tier 1 or 2."""
    m = F.lower(F.coalesce(meta, F.lit("")))
    has = lambda values, prefix: F.exists(F.array(*(F.lit(prefix + v.lower()) for v in values)), lambda v: F.contains(m, v)) if values else F.lit(False)
    return score + F.when(has(handles, "@"), 25).otherwise(0) + F.when(has(subs, "r/"), 15).otherwise(0) + F.when(tier == 1, 40).when(tier == 2, 20).otherwise(0)


def outbox_results(briefs: DataFrame, results: DataFrame) -> DataFrame:
    """Briefs (day, idx, status, sent_at) with the last result of each merged in; merging the same results again changes nothing."""
    last = results.groupBy("day", "idx").agg(F.max(F.struct("at", "status", "sent_at")).alias("r"))
    j = briefs.join(last, ["day", "idx"], "left")
    return j.select("day", "idx", F.coalesce("r.status", "status").alias("status"), F.coalesce("r.sent_at", "sent_at").alias("sent_at"))


def outbox_status(briefs: DataFrame) -> DataFrame:
    """(day, status): sent when all are sent or stale, partial when some are sent, else pending."""
    done = F.count_if(F.col("status").isin("sent", "stale_skipped"))
    return briefs.groupBy("day").agg(F.when(done == F.count("*"), "sent").when(F.count_if(F.col("status") == "sent") > 0, "partial").otherwise("pending").alias("status"))
