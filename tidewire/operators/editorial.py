"""Editorial operators: hashed local vectors, featured flows, insight folding, day-to-day headlines and cool-down, body checks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import text as X

#: Vector size and the weights of title n-grams (by n), summary trigrams, words, tags, topics.
DIMENSION = 1024
TITLE_WEIGHTS, SUMMARY_WEIGHT, WORD_WEIGHT, TAG_WEIGHT, TOPIC_WEIGHT = {2: 1.6, 3: 2.2, 4: 1.2}, 0.45, 1.0, 4.0, 2.2


def bucket(feature: Column) -> Column:
    """A feature's place in the vector: its 8-byte BLAKE2b, modulo the size."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda f: int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big") % DIMENSION)

    return run(feature)


def local_vectors(rows: DataFrame, key: str, title: str, summary: str, tags: str | None = None, topics: str | None = None) -> DataFrame:
    """(key, idx, value): TF-IDF of hashed features, unit length, only the cells that aren't zero. Repeats of a feature add up."""
    t, s = X.loose_key(F.col(title)), X.loose_key(F.col(summary))
    feature = lambda prefix, values, w: F.transform(values, lambda v: F.struct(F.concat(F.lit(prefix), v).alias("f"), F.lit(w).alias("w")))
    parts = [feature(f"t{n}:", X.ngrams(t, n), w) for n, w in TITLE_WEIGHTS.items()]
    parts += [feature("s3:", X.ngrams(s, 3), SUMMARY_WEIGHT), feature("w:", X.words(F.concat_ws(" ", title, summary)), WORD_WEIGHT)]
    for c, prefix, w in ((tags, "tag:", TAG_WEIGHT), (topics, "topic:", TOPIC_WEIGHT)):
        if c:
            parts.append(feature(prefix, F.col(c), w))
    long = rows.select(key, F.explode(F.concat(*parts)).alias("x")).groupBy(key, "x.f").agg(F.sum("x.w").alias("w"))
    n = rows.agg(F.count("*").alias("docs"))
    listed = long.groupBy("f").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    known = listed.select("f", bucket(F.col("f")).alias("idx"), (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    cells = long.join(known, "f").groupBy(key, "idx").agg(F.sum(F.col("w") * F.col("idf")).alias("v"))
    norms = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return cells.join(norms, key).select(key, "idx", (F.col("v") / F.col("norm")).alias("value"))


def sparse_cosine(vectors: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(left, right, cosine) of candidate pairs, by joins on the cells."""
    left = pairs.join(vectors.select(F.col(key).alias("left"), "idx", F.col("value").alias("x")), "left")
    return left.join(vectors.select(F.col(key).alias("right"), "idx", F.col("value").alias("y")), ["right", "idx"]).groupBy("left", "right").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("cosine"))


#: What a new region adds, what it adds more for a flow that is from abroad only, what evidence seen before costs.
NEW_REGION, ABROAD_ONLY, SEEN_EVIDENCE = 2.5, 0.35, 6.0


def overlap(a: Column, b: Column) -> Column:
    """Shared values of two arrays as a part of the lesser; 0 where one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def insight_signal(now: Column, before: Column, evidence: Column) -> Column:
    """Strength of a flow: its count, its growth and its evidence."""
    n, b = F.coalesce(now, F.lit(0)).cast("double"), F.coalesce(before, F.lit(0)).cast("double")
    return n + F.greatest(F.lit(0.0), n - b) * 0.6 + F.least(F.size(evidence), F.lit(6)) * 0.15


def featured(rows: DataFrame, group: str, key: str, signal: str, regions: str, evidence: str, n: int = 3, direction: str | None = None, scope: str | None = None, abroad: str = "overseas") -> DataFrame:
    """(group, key, rank): n rounds, each of which gives every group the row that adds the most to those it has.

    A row adds its signal, NEW_REGION for each region that is new (from the second round on), ABROAD_ONLY if abroad is
    new and all of its scope, less SEEN_EVIDENCE times its largest overlap with a chosen row. Rows without evidence, or
    without a direction where that column is named, are no candidates; of equals the higher signal, then the greater key.
    The rounds are aggregates and joins by group: a group is never gathered.
    """
    wanted = F.size(evidence) > 0 if direction is None else (F.size(evidence) > 0) & (F.coalesce(F.col(direction), F.lit("")) != "")
    todo = rows.where(wanted).select(group, key, F.col(signal).cast("double").alias("__s"), F.col(regions).cast("array<string>").alias("__r"), F.col(evidence).alias("__e"), (F.col(scope) if scope else F.lit(None).cast("string")).alias("__scope"))
    state, picks = None, []
    for rank in range(1, n + 1):
        if state is None:
            now = todo.withColumn("__add", F.col("__s"))
        else:
            fresh = F.array_except("__r", "__seen")
            bonus = NEW_REGION * F.size(fresh) + F.when(F.array_contains(fresh, F.lit(abroad)) & (F.coalesce("__scope", F.lit("")) == abroad), ABROAD_ONLY).otherwise(0.0)
            cost = F.array_max(F.transform("__chosen", lambda c: overlap(F.col("__e"), c)))
            now = todo.join(state, group).where(~F.array_contains("__keys", F.col(key))).withColumn("__add", F.col("__s") + bonus - SEEN_EVIDENCE * cost)
        best = now.groupBy(group).agg(F.max(F.struct(F.round("__add", 9).alias("a"), F.col("__s").alias("s"), F.col(key).alias("k"), F.col("__r").alias("r"), F.col("__e").alias("e"))).alias("b"))
        picks.append(best.select(group, F.col("b.k").alias(key), F.lit(rank).alias("rank")))
        chosen = best.select(group, F.array("b.k").alias("__k1"), F.col("b.r").alias("__r1"), F.array("b.e").alias("__e1"))
        if state is None:
            state = chosen.toDF(group, "__keys", "__seen", "__chosen")
        else:
            joined = state.join(chosen, group)
            state = joined.select(group, F.concat("__keys", "__k1").alias("__keys"), F.array_union("__seen", "__r1").alias("__seen"), F.concat("__chosen", "__e1").alias("__chosen"))
    out = picks[0]
    for p in picks[1:]:
        out = out.unionAll(p)
    return out


def _overlap(a: set, b: set) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def fold_insights(rows: DataFrame, group: str, key: str, evidence: str, signal: str, least: float = 0.4) -> DataFrame:
    """(group, key, kept_as): rows that share `least` of the smaller evidence set fold into the kept one with more evidence."""
    schema = T.StructType([rows.schema[group], rows.schema[key], T.StructField("kept_as", rows.schema[key].dataType)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = sorted(zip(pdf[key], map(set, pdf[evidence]), pdf[signal], strict=True), key=lambda x: (-len(x[1]), -x[2], str(x[0])))
        kept: list[tuple] = []
        out = {}
        for k, e, _ in items:
            hit = next((o for o, f in kept if _overlap(e, f) >= least), None)
            out[k] = k if hit is None else hit
            if hit is None:
                kept.append((k, e))
        return pd.DataFrame({group: pdf[group].iloc[0], key: list(out), "kept_as": list(out.values())})

    return rows.groupBy(group).applyInPandas(run, schema)


def headlines(rows: DataFrame, site: str, day: str, rank: str, title: str, shared: int = 3) -> DataFrame:
    """(site, day, headline): the best-ranked title that doesn't share `shared` words with the day before's headline; if all do, the first.

    Each day depends on the day before, so a site's days run in order; sites are independent.
    """
    schema = T.StructType([rows.schema[site], rows.schema[day], T.StructField("headline", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before: set = set()
        out = []
        for d, part in pdf.sort_values([day, rank, title], kind="stable").groupby(day, sort=True):
            titles = part[title].tolist()
            heads = [set(t.lower().split()) for t in titles]
            at = next((i for i, h in enumerate(heads) if len(h & before) < shared), 0)
            out.append((pdf[site].iloc[0], d, titles[at]))
            before = heads[at]
        return pd.DataFrame(out, columns=[site, day, "headline"])

    return rows.groupBy(site).applyInPandas(run, schema)


def cooled_order(rows: DataFrame, site: str, day: str, key: str, score: str, days: int = 3) -> DataFrame:
    """(site, day, key, position): an issue that led one of the `days` briefings before ranks behind the others."""
    schema = T.StructType([rows.schema[site], rows.schema[day], rows.schema[key], T.StructField("position", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        led: list = []
        out = []
        for d, part in pdf.sort_values(day, kind="stable").groupby(day, sort=True):
            ordered = sorted(zip(part[key], part[score], strict=True), key=lambda x: (x[0] in led[-days:], -x[1], x[0]))
            led.append(ordered[0][0])
            out += [(pdf[site].iloc[0], d, k, i) for i, (k, _) in enumerate(ordered, 1)]
        return pd.DataFrame(out, columns=[site, day, key, "position"])

    return rows.groupBy(site).applyInPandas(run, schema)


def body_fits_title(body: Column, title: Column, share: float = 0.5, least: int = 3) -> Column:
    """At least max(least, share) of the title's words occur in the body, also without their last letter; titles without words fit."""
    tokens = F.array_distinct(F.transform(F.regexp_extract_all(title, F.lit("([가-힣]{2,}|[A-Za-z]{3,}|[0-9]{2,})"), F.lit(1)), lambda w: F.lower(w)))
    low = F.lower(F.coalesce(body, F.lit("")))
    hits = F.size(F.filter(tokens, lambda w: F.contains(low, w) | ((F.length(w) > 2) & F.contains(low, F.substring(w, F.lit(1), F.length(w) - 1)))))
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) <= 0, True).otherwise(hits >= F.greatest(F.lit(least), F.bround(F.size(tokens) * share).cast("int")))


def article_body(page: Column) -> Column:
    """Text of the longest <article>, else of the paragraphs, else of the page, without scripts, styles and comments; block ends become line ends."""
    bare = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<!--.*?-->|<(script|style|noscript|form|nav|header|footer|aside)\b.*?</\1\s*>", " ")
    articles = F.array_sort(F.regexp_extract_all(bare, F.lit(r"(?is)<article\b[^>]*>(.*?)</article\s*>"), F.lit(1)), lambda a, b: F.length(b) - F.length(a))
    paragraphs = F.array_join(F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), F.lit(1)), lambda p: F.concat(p, F.lit("</p>"))), "")
    chosen = F.coalesce(F.get(articles, F.lit(0)), F.when(paragraphs != "", paragraphs), bare)
    lines = F.split(F.regexp_replace(chosen, r"(?i)</?(p|div|h[1-6]|li|tr|br|ul|ol|table|section|blockquote)\b[^>]*>", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: X.strip_html(x)), lambda x: x != ""), "\n")
