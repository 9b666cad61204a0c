"""Whether two articles are the same issue: facilities, countries, the scored ladder of rules, and clustering by it in two passes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import text as X
from tidewire.functions.fields import NO_COUNTRY
from tidewire.operators import cluster as C
from tidewire.operators import dedup as D
from tidewire.operators import graph

#: Plants that issues and titles name.
ISSUE_PLANTS = (
    "신월성", "신한울", "신고리", "후쿠시마", "자포리자", "체르노빌",
    "올킬루오토", "플라망빌", "힝클리", "사이즈웰", "두코바니", "테믈린",
    "세르나보다", "알마라즈", "바라카", "아투차", "엠발세", "보글틀",
    "새울", "고리", "월성", "한빛", "한울", "타이산", "파크스",
)
TITLE_PLANTS = ("신고리", "신월성", "신한울", "새울", "고리", "월성", "한빛", "한울", "영광", "울진")
#: Scores of a pair that a person or a model approved, and the cosines of a match and of review.
BY_HAND, BY_MODEL, COSINE, REMOTE_REVIEW, LOCAL_REVIEW = 1.0, 0.99, 0.92, 0.70, 0.18


def named_facilities(text: Column, plants: tuple[str, ...] = ISSUE_PLANTS) -> Column:
    """struct(plants, units): plants that a text names, and units such as 고리-2 for 고리 2호기."""
    low = F.lower(F.coalesce(text, F.lit("")))
    name = "(" + "|".join(sorted(plants, key=len, reverse=True)) + ")"  # a longer name before one that it contains
    unit = rf"{name}\s*(\d+)\s*호기"
    units = F.zip_with(F.regexp_extract_all(low, F.lit(unit), F.lit(1)), F.regexp_extract_all(low, F.lit(unit), F.lit(2)), lambda p, n: F.concat(p, F.lit("-"), n))
    return F.struct(F.array_distinct(F.regexp_extract_all(low, F.lit(name), F.lit(1))).alias("plants"), F.array_distinct(units).alias("units"))


def facilities_conflict(a: Column, b: Column) -> Column:
    """Both name units of one plant and none in common, or both name plants and none in common."""
    plant = lambda u: F.split_part(u, F.lit("-"), F.lit(1))
    met = lambda u: F.exists(b["units"], lambda v: plant(v) == plant(u))
    shared = lambda u: F.exists(a["units"], lambda w: (plant(w) == plant(u)) & F.array_contains(b["units"], w))
    apart = (F.size(a["plants"]) > 0) & (F.size(b["plants"]) > 0) & ~F.arrays_overlap(a["plants"], b["plants"])
    return F.exists(a["units"], lambda u: met(u) & ~shared(u)) | apart


def title_units(title: Column) -> Column:
    """Units that a title names, lists of numbers too: 고리 3·4호기 gives 고리3 and 고리4."""
    pattern = "(" + "|".join(TITLE_PLANTS) + r")\s*([0-9][0-9,·~\-\s]*)\s*호기"
    t = F.coalesce(title, F.lit(""))
    each = F.zip_with(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)), lambda p, ns: F.transform(F.regexp_extract_all(ns, F.lit("([0-9]+)"), F.lit(1)), lambda n: F.concat(p, n)))
    return F.array_distinct(F.flatten(each))


def units_conflict(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def plain_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(F.ltrim(t, F.lit("#"))))), lambda t: t != ""))


def same_unit_event(a: Column, b: Column, tags_a: Column, tags_b: Column) -> Column:
    """A unit and a tag in common; nothing is said where one side is empty."""
    return F.arrays_overlap(a, b) & F.arrays_overlap(tags_a, tags_b)


def country_scope(countries: Column, without: tuple[str, ...] = NO_COUNTRY) -> Column:
    return F.array_except(F.coalesce(countries, F.array().cast("array<string>")), F.array(*map(F.lit, without)))


def countries_conflict(a: Column, b: Column) -> Column:
    x, y = country_scope(a, ("OTHER",)), country_scope(b, ("OTHER",))
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def score_pairs(pairs: DataFrame, rows: DataFrame, key: str, title: str, tags: str, topics: str, countries: str, facilities: str, vector: str | None = None, local: DataFrame | None = None) -> DataFrame:
    """(left, right) -> the verdict on each pair: matched, method, score, and every feature that it rests on.

    right is the article that comes later; difflib's ratio depends on the order, (later, earlier). A conflict of country
    or facility blocks all rules. local: (left, right, cosine) of the hashed vectors, for the review queue only.
    """
    f = rows.select(key, F.regexp_replace(F.lower(F.coalesce(F.col(title), F.lit(""))), "[^0-9a-z가-힣]", "").alias("t"), X.words(F.col(title)).alias("w"), plain_tags(F.col(tags)).alias("g"), F.coalesce(F.col(topics), F.array().cast("array<string>")).alias("o"), F.col(countries).alias("c"), named_facilities(F.concat_ws(" ", F.col(title), F.array_join(plain_tags(F.col(tags)), " "))).alias("f"), (F.col(vector) if vector else F.lit(None).cast("array<double>")).alias("v"))
    if facilities:
        f = f.join(rows.select(key, F.col(facilities).alias("e")), key)
    else:
        f = f.withColumn("e", F.array().cast("array<string>"))
    side = lambda name: f.select(F.col(key).alias(name), F.struct("t", "w", "g", "o", "c", "f", "v", "e").alias(f"__{name}"))
    j = pairs.join(side("left"), "left").join(side("right"), "right")
    a, b = F.col("__right"), F.col("__left")
    jaccard = lambda x, y: D.jaccard(x, y)
    j = j.withColumns({
        "title_ratio": F.when((a["t"] != "") & (b["t"] != ""), X.ratio(a["t"], b["t"])).otherwise(0.0), "token_ratio": jaccard(a["w"], b["w"]), "tag_ratio": jaccard(a["g"], b["g"]),
        "tag_shared": F.size(F.array_intersect(a["g"], b["g"])), "topic_shared": F.size(F.array_intersect(a["o"], b["o"])), "shared_facilities": F.array_sort(F.array_intersect(a["e"], b["e"])),
        "cosine": D.cosine(a["v"], b["v"]) if vector else F.lit(None).cast("double"),
        "blocked_by": F.array_compact(F.array(F.when(countries_conflict(a["c"], b["c"]), "country_conflict"), F.when(facilities_conflict(a["f"], b["f"]), "facility_conflict"))),
    })
    t, k, g = F.col("title_ratio"), F.col("token_ratio"), F.col("tag_shared")
    method = (
        F.when(F.size("blocked_by") > 0, "blocked").when(t >= C.TITLE_ALONE, "title").when((g >= 2) & ((t >= C.TAGS_TITLE) | (k >= C.TAGS_TOKENS)), "tags")
        .when((g >= 1) & (t >= C.TAG_TITLE), "title_tags").when(F.coalesce(F.col("cosine"), F.lit(0.0)) >= COSINE, "embedding").otherwise("none")
    )
    base = F.lit(C.WEIGHTS[0]) * t + F.lit(C.WEIGHTS[1]) * k + F.lit(C.WEIGHTS[2]) * F.col("tag_ratio")
    j = j.withColumn("method", method).withColumn("score", F.round(F.when(F.col("method") == "embedding", F.greatest(base, "cosine")).otherwise(base), 4))
    j = j.withColumn("matched", ~F.col("method").isin("blocked", "none"))
    j = j.join(local.select("left", "right", F.col("cosine").alias("local_cosine")), ["left", "right"], "left") if local is not None else j.withColumn("local_cosine", F.lit(None).cast("double"))
    return j.drop("__left", "__right")


def review_candidate(scored: DataFrame) -> DataFrame:
    """Adds review (a method, or null) and review_score: pairs below a match that a person or model should see."""
    t, k = F.col("title_ratio"), F.col("token_ratio")
    context = (F.col("tag_shared") > 0) | (F.col("topic_shared") > 0) | (t >= 0.28) | (k >= 0.16)
    near = ((F.col("tag_shared") > 0) & (t >= 0.20)) | ((F.col("topic_shared") > 0) & ((t >= 0.25) | (k >= 0.12))) | (t >= 0.45)
    open_ = ~F.col("matched") & (F.size("blocked_by") == 0) & context
    review = F.when(open_ & (F.col("cosine") >= REMOTE_REVIEW), "remote_candidate").when(open_ & (F.col("local_cosine") >= LOCAL_REVIEW) & near, "local_candidate")
    return scored.withColumn("review", review).withColumn("review_score", F.when(review == "remote_candidate", F.col("cosine")).when(review == "local_candidate", F.col("local_cosine")))


@dataclass
class Judgments:
    """Pairs (left, right) that people and models have judged; any may be missing. A rejection beats an approval."""

    approved: DataFrame | None = None
    rejected: DataFrame | None = None
    model_approved: DataFrame | None = None
    model_rejected: DataFrame | None = None


def _both(pairs: DataFrame | None) -> DataFrame | None:
    return None if pairs is None else pairs.select("left", "right").unionAll(pairs.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct()


def judged_pairs(scored: DataFrame, judgments: Judgments) -> DataFrame:
    """Scored pairs with judgments applied: approved ones match at BY_HAND or BY_MODEL unless a conflict blocks them."""
    out = scored
    for pairs, mark, score in ((judgments.model_approved, "model_approved", BY_MODEL), (judgments.approved, "manual_approved", BY_HAND)):
        if pairs is not None:
            out = out.join(_both(pairs).withColumn("__yes", F.lit(True)), ["left", "right"], "left")
            take = F.col("__yes").isNotNull() & (F.size("blocked_by") == 0)
            out = out.withColumns({"method": F.when(take, mark).otherwise(F.col("method")), "score": F.when(take, F.greatest("score", F.lit(score))).otherwise(F.col("score")), "matched": F.col("matched") | take}).drop("__yes")
    return out


def cluster(rows: DataFrame, scored: DataFrame, key: str, day: str, order: list[str], countries: str, judgments: Judgments = Judgments(), window: int = C.WINDOW) -> DataFrame:
    """(key, issue): in the declared order each article joins the issue with the best matching pair among its last three members.

    An issue is closed to articles more than `window` days after its last member, to those rejected against any member,
    and to those from a country that no member links to each other member's. The first of equal scores wins; the first
    member names the issue. The fold runs per component of matching pairs: an article can only join over one.
    """
    pairs = judged_pairs(scored, judgments)
    vetoes = None
    for v in (judgments.rejected, judgments.model_rejected):
        if v is not None:
            vetoes = _both(v) if vetoes is None else vetoes.unionAll(_both(v)).distinct()
    if vetoes is not None:
        pairs = pairs.join(vetoes, ["left", "right"], "left_anti")
    matched = pairs.where("matched").select("left", "right", "score")
    placed = graph.by_pairs(rows.select(key, day, *[o for o in order if o not in (key, day)], country_scope(F.col(countries)).alias("__scope")), matched, key)
    near = matched.select(F.col("right").alias(key), F.struct("left", "score").alias("p")).unionAll(matched.select(F.col("left").alias(key), F.struct(F.col("right").alias("left"), "score").alias("p")))
    fed = placed.join(near.groupBy(key).agg(F.collect_list("p").alias("near")), key, "left")
    kind = rows.schema[key].dataType
    if vetoes is not None:
        fed = fed.join(vetoes.groupBy(F.col("left").alias(key)).agg(F.collect_set("right").alias("veto")), key, "left")
    else:
        fed = fed.withColumn("veto", F.lit(None).cast(T.ArrayType(kind)))
    # an article without a matching pair is an issue of its own: only the others are folded
    alone = fed.where("near is null").select(key, F.col(key).alias("issue"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        issues: list[dict] = []
        names = []
        for r in pdf.sort_values([*order, key], kind="stable").to_dict("records"):
            scores: dict = {}
            for p in r["near"]:
                scores[p["left"]] = max(p["score"], scores.get(p["left"], p["score"]))
            veto, scope = set(r["veto"] if r["veto"] is not None else ()), frozenset(r["__scope"])
            open_ = [(i, max(scores[m] for m in i["keys"][-C.ANCHORS :] if m in scores)) for i in issues if fits(i, r, scores, veto, scope)]
            target = max(open_, key=lambda x: x[1])[0] if open_ else None
            if target is None:
                target = {"name": r[key], "keys": [], "scopes": []}
                issues.append(target)
            target["keys"].append(r[key])
            target["scopes"].append(scope)
            target["last"] = r[day]
            names.append((r[key], target["name"]))
        return pd.DataFrame(names, columns=[key, "issue"])

    def fits(issue: dict, r: dict, scores: dict, veto: set, scope: frozenset) -> bool:
        if not any(m in scores for m in issue["keys"][-C.ANCHORS :]) or veto.intersection(issue["keys"]):
            return False
        if r[day] is not None and issue["last"] is not None and (pd.Timestamp(r[day]) - pd.Timestamp(issue["last"])).days > window:
            return False
        pool = [*issue["scopes"], scope]
        return all(not scope or not s or scope & s or any(p & scope and p & s for p in pool) for s in issue["scopes"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("issue", kind)])
    return fed.where("near is not null").groupBy("component").applyInPandas(fold, schema).unionAll(alone)


def two_passes(rows: DataFrame, scored: DataFrame, key: str, day: str, order: list[str], countries: str, ask: Callable[[DataFrame], DataFrame], judgments: Judgments = Judgments()) -> DataFrame:
    """Clusters once, has the review candidates judged (ask: pairs -> left, right, same) and clusters again with the verdicts.

    No verdict keeps the first pass; a null verdict counts neither way.
    """
    first = cluster(rows, scored, key, day, order, countries, judgments)
    verdicts = ask(review_candidate(scored).where("review is not null")).where("same is not null")
    if verdicts.isEmpty():
        return first
    both = Judgments(judgments.approved, judgments.rejected, verdicts.where("same").select("left", "right"), verdicts.where("not same").select("left", "right"))
    return cluster(rows, scored, key, day, order, countries, both)
