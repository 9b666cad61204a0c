"""Explainable score, selection floor, adaptive cap, diverse top-k and the orders of issue lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@dataclass(frozen=True)
class Weights:
    """The default weights of the score."""

    importance: dict = field(default_factory=lambda: {"must_read": 10.0, "nice_to_know": 5.0})
    event: dict = field(default_factory=lambda: {"policy_decision": 6.0, "regulatory_action": 6.0, "contract_award": 6.0, "incident_safety": 6.0, "project_milestone": 4.0, "corporate_move": 3.0, "market_signal": 2.0, "research_report": 2.0, "opinion": 0.0, "other": 1.0})
    feature: dict = field(default_factory=lambda: {"korea_relevance": 1.2, "market_materiality": 1.0, "policy_materiality": 1.0, "novelty": 0.0, "evidence_strength": 1.0})
    tier: dict = field(default_factory=lambda: {1: 3.0, 2: 1.5})
    related: float = 1.0
    follow_up: float = 1.5
    repeat: float = 0.5
    decay_per_12h: float = 0.5
    decay_max: float = 3.0


def scale(c: Column) -> Column:
    """A 0-3 feature: other numbers are clamped, what is no number is 0."""
    return F.coalesce(F.least(F.greatest(c.try_cast("double").cast("int"), F.lit(0)), F.lit(3)), F.lit(0))


def novelty(prior: Column) -> Column:
    return F.when(prior.isNull(), 2).when(prior <= 0, 3).when(prior <= 2, 2).otherwise(1)


def evidence_strength(text: Column, speculation: str, confirmed: str, quantity: str) -> Column:
    """1 for outlooks, 3 for facts, else 2; one less without a quantity; 0 for blank text."""
    base = F.when(text.rlike(speculation), 1).when(text.rlike(confirmed), 3).otherwise(2)
    return F.when(F.trim(text) == "", 0).otherwise(base - F.when(text.rlike(quantity), 0).otherwise(1))


def _choice(c: Column, table: dict, other: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), F.lit(other))


def breakdown(importance: Column, event: Column, features: dict[str, Column], tier: Column, related: Column, prior: Column, age_hours: Column, w: Weights = Weights()) -> Column:
    """map of the parts that aren't zero; the score is their sum."""
    parts = [(F.lit("importance"), _choice(importance, w.importance, w.importance["nice_to_know"])), (F.concat(F.lit("event:"), event), _choice(event, w.event, w.event["other"]))]
    parts += [(F.lit(k), scale(c) * F.lit(w.feature.get(k, 0.0))) for k, c in features.items()]
    parts += [
        (F.lit("source_tier"), _choice(tier, w.tier, 0.0)),
        (F.lit("related_reports"), F.when(related, w.related).otherwise(0.0)),
        (F.lit("tracking"), F.when(F.coalesce(prior, F.lit(0)) == 0, 0.0).when(prior <= 2, w.follow_up).otherwise(w.repeat)),
        (F.lit("time_decay"), -F.coalesce(F.least(F.lit(w.decay_max), F.lit(w.decay_per_12h) * F.greatest(age_hours, F.lit(0.0)) / 12), F.lit(0.0))),
    ]
    return F.map_filter(F.map_from_arrays(F.array(*(k for k, _ in parts)), F.array(*(v.cast("double") for _, v in parts))), lambda k, v: v != 0)


def total(parts: Column, digits: int = 3) -> Column:
    return F.round(F.aggregate(F.map_values(parts), F.lit(0.0), lambda a, x: a + x), digits)


def floor_verdict(score: Column, grade: Column, has_features: Column, limits: dict[str, float]) -> Column:
    """struct(passes, reason): rows without features and grades without a limit are exempt."""
    limit = F.try_element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), grade) if limits else F.lit(None).cast("double")
    passes = ~has_features | limit.isNull() | (score >= limit)
    reason = F.when(~has_features, "exempt_no_features").when(limit.isNull(), "no_limit_for_grade").when(score >= limit, "passed").otherwise("below_floor")
    return F.struct(passes.alias("passes"), reason.alias("reason"))


def adaptive_cap(eligible: Column, must_read: Column, base: int, most: int, per: int = 1, bonus_max: int = 2, step: int = 5, step_max: int = 3, surge: int = 0) -> Column:
    """base and bonuses for must-read rows and for the number of eligible rows, at most `most` and what is eligible."""
    volume = F.least(F.lit(step_max), F.greatest(F.lit(0), F.floor((eligible - base) / step))) if step > 0 else F.lit(0)
    raw = F.lit(base + surge) + F.least(F.lit(bonus_max), must_read * per) + volume
    return F.greatest(F.lit(0), F.least(raw, eligible, F.lit(most))).cast("int")


def select_diverse(rows: DataFrame, group: list[str], topic: str, score: str, ties: list[str], k: int | Column, max_per_topic: int = 2, penalty: float = 2.5) -> DataFrame:
    """Greedy choice in closed form: beyond max_per_topic rows of a topic the rest lose `penalty`. Adds adjusted and rank; keeps rank <= k."""
    own = W.partitionBy(*group, topic).orderBy(F.desc(score), *(F.desc(t) for t in ties))
    adjusted = F.col(score) - F.when(F.row_number().over(own) > max_per_topic, penalty).otherwise(0.0)
    best = W.partitionBy(*group).orderBy(F.desc("adjusted"), F.desc(score), *(F.desc(t) for t in ties))
    return rows.withColumn("adjusted", adjusted).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (k if isinstance(k, Column) else F.lit(k)))


def interleave(rows: DataFrame, group: list[str], region: str, must: str, score: str, key: str) -> DataFrame:
    """Order of a briefing: the rank within the region first, then must-read, then score."""
    own = W.partitionBy(*group, region).orderBy(F.desc(must), F.desc(score), F.asc(key))
    ranked = rows.withColumn("region_rank", F.row_number().over(own))
    return ranked.withColumn("position", F.row_number().over(W.partitionBy(*group).orderBy("region_rank", F.desc(must), F.desc(score), F.asc(key))))


def round_robin(rows: DataFrame, entity: str, priority: str, order: str, per_entity: int = 4, n: int = 30) -> DataFrame:
    """Depth-first rounds over the entities by priority: everyone's first query, then everyone's second."""
    own = rows.withColumn("depth", F.row_number().over(W.partitionBy(entity).orderBy(order))).where(F.col("depth") <= per_entity)
    return own.orderBy("depth", priority, entity).limit(n)


def follow_up_tags(rows: DataFrame, tag: str, least: int = 3, n: int = 5) -> DataFrame:
    counts = rows.groupBy(tag).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), F.asc(tag)).limit(n)
