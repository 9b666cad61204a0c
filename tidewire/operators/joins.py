"""Joins: lookups with blanks filled, seen and delivered sets, suffix and alias tables, windows, as-of and token joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def fill_blanks(rows: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join that only fills null or empty values."""
    p = patch.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return rows.join(p, key, "left").withColumns({c: F.when(blank(c), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop(*(f"__{c}" for c in columns))


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows none of whose keys is in the seen table: one anti join for each key, null keys match nothing."""
    for k in keys:
        rows = rows.join(seen.select(k).distinct(), k, "left_anti")
    return rows


def delivered(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    return rows.join(log.select(key).distinct(), key, "left_semi")


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def longest_suffix(rows: DataFrame, host: str, table: DataFrame, domain: str, values: list[str], key: str) -> DataFrame:
    """Looks a host up by its longest listed parent domain: an equality join on exploded suffixes, not a theta join."""
    each = rows.select(key, host).distinct()
    hit = each.select(key, F.posexplode(suffixes(F.col(host))).alias("__p", domain)).join(table, domain)
    best = hit.groupBy(key).agg(F.min(F.struct("__p", domain, *values)).alias("__b")).select(key, *(F.col(f"__b.{c}") for c in [domain, *values]))
    return rows.join(best, key, "left")


def within_days(left: DataFrame, right: DataFrame, on: list[str], left_day: str, right_day: str, days: int, one_sided: bool = False) -> DataFrame:
    """Pairs of equal keys whose days are at most `days` apart; buckets of that width make it an equality join."""
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / (days + 1))
    a = left.withColumn("__b", F.explode(F.array(bucket(left_day) - 1, bucket(left_day), bucket(left_day) + 1)))
    b = right.withColumn("__b", bucket(right_day))
    gap = F.datediff(F.col(left_day), F.col(right_day))
    return a.join(b, [*on, "__b"]).where(gap.between(0, days) if one_sided else F.abs(gap) <= days).drop("__b")


def previous_state(rows: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """For each key the latest row and the latest one strictly earlier in time; null where there is none."""
    last = W.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    newest = rows.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").select(key, F.col(at).alias("now_at"), F.col(value).alias("now_value"))
    before = rows.join(newest.select(key, "now_at"), key).where(F.col(at) < F.col("now_at")).groupBy(key).agg(F.max(F.struct(at, tie, value)).alias("p"))
    return newest.join(before, key, "left").select(key, "now_at", "now_value", F.col(f"p.{at}").alias("prev_at"), F.col(f"p.{value}").alias("prev_value"))


def idf_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, token: str, least: int = 2, n: int = 2) -> DataFrame:
    """Pairs that share at least `least` tokens, scored by the sum of the shared tokens' IDF over the root of the right side's
    number of tokens; the best n for each left row. left and right: one row for each (id, token)."""
    right = right.distinct()
    docs = right.select(right_id).distinct().agg(F.count("*").alias("docs"))
    idf = right.groupBy(token).agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs)).select(token, F.log((1 + F.col("docs")) / (1 + F.col("df"))).alias("idf"))
    size = right.groupBy(right_id).agg(F.count("*").alias("size"))
    pairs = left.distinct().join(right.join(idf, token), token).groupBy(left_id, right_id).agg(F.count("*").alias("shared"), F.sum("idf").alias("s")).where(F.col("shared") >= least)
    scored = pairs.join(size, right_id).withColumn("score", F.round(F.col("s") / F.sqrt("size"), 6))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(left_id).orderBy(F.desc("score"), F.asc(right_id)))).where(F.col("rank") <= n).select(left_id, right_id, "shared", "score", "rank")


def entity_mentions(members: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity_id): tokens equal to a Latin alias, or a Hangul alias with at most three further letters; the longest alias of
    a token wins. aliases: (entity_id, alias, rank). Prefixes of the token join the alias, so no pair of all is formed."""
    tokens = members.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda t: t != ""))).alias("token"))
    n = F.length("token")
    hangul = F.col("token").rlike("[가-힣]")
    cut = F.when(hangul, F.transform(F.sequence(F.greatest(F.lit(1), n - 3), n), lambda i: F.substring("token", F.lit(1), i))).otherwise(F.array("token"))
    prefixed = tokens.select(key, "token", F.explode(cut).alias("alias"))
    hit = prefixed.join(aliases.withColumn("alias", F.lower("alias")), "alias")
    best = hit.groupBy(key, "token").agg(F.max(F.struct(F.length("alias").alias("n"), (-F.col("rank")).alias("r"), "entity_id")).alias("b"))
    return best.select(key, F.col("b.entity_id")).distinct()


def prefix_lookup(rows: DataFrame, table: DataFrame, short: str, full: str, order: str, length: int = 8) -> DataFrame:
    """Joins short hashes to the first full hash with that prefix."""
    firsts = table.groupBy(F.substring(full, 1, length).alias(short)).agg(F.min(F.struct(order, full)).alias("f")).select(short, F.col(f"f.{full}"))
    return rows.join(firsts, short, "left")
