"""Sinks: idempotent appends, keyed upserts, retention, atomic replacement, message and feed rendering."""

from __future__ import annotations

import uuid
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.operators.dedup import or_keys


def new_records(records: DataFrame, existing: DataFrame, keys: list[str], order: list[str], run: str) -> DataFrame:
    """Records none of whose keys exists yet, the first of those that share a key within the run. Null and empty keys never match."""
    for k in keys:
        seen = existing.select(k).where(F.col(k).isNotNull() & (F.col(k) != "")).distinct()
        records = records.join(seen, k, "left_anti")
    kept = or_keys(records, [run], order[-1], keys, order).where("kept").select(order[-1])
    return records.join(kept, order[-1], "left_semi")


def append_by_month(records: DataFrame, path: str, at: str) -> None:
    """Appends to the partition of the month; an unreadable time goes to the current month."""
    month = F.coalesce(F.date_format(F.try_to_timestamp(F.col(at)), "yyyy-MM"), F.date_format(F.current_timestamp(), "yyyy-MM"))
    records.withColumn("month", month).write.mode("append").partitionBy("month").parquet(path)


def append_once(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in the log: running the same batch again appends nothing."""
    return rows.dropDuplicates(keys).join(log.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], compare: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of their key; with compare, an old row stays if those columns are equal."""
    kept = table.join(rows.select(*keys), keys, "left_anti")
    if compare is None:
        return kept.unionByName(rows, allowMissingColumns=True)
    same = rows.select(*keys, *(F.col(c).alias(f"__{c}") for c in compare))
    equal = F.lit(True)
    for c in compare:
        equal = equal & F.col(c).eqNullSafe(F.col(f"__{c}"))
    stays = table.join(same, keys).where(equal).drop(*(f"__{c}" for c in compare))
    return kept.unionByName(stays).unionByName(rows.join(stays.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def keep_latest(table: DataFrame, order: str, n: int = 26) -> DataFrame:
    """The n greatest rows; top-k, not a full sort."""
    return table.orderBy(F.desc(order)).limit(n)


def expire(table: DataFrame, at: str, now: Column, days: int, keep_blank: bool = True) -> DataFrame:
    """Rows of at most `days`; rows without a time stay if keep_blank."""
    fresh = F.datediff(now, F.to_date(F.col(at))) <= days
    return table.where(F.coalesce(fresh, F.lit(keep_blank)))


def enrich(table: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New keys are added; for known ones only blanks are filled."""
    p = rows.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    filled = table.join(p, key, "left").withColumns({c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"__{c}"), F.col(c)) for c in columns}).drop(*(f"__{c}" for c in columns))
    return filled.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def compare_and_set(store: DataFrame, version: int, operations: DataFrame) -> tuple[int, DataFrame]:
    """Optimistic lock: operations (id, op, kind, value, disabled) apply only to the version they were made for.

    add needs a new id, delete and toggle a known one; others raise.
    """
    current = store.agg(F.max("version").alias("v")).first()["v"] or 0
    if current != version:
        raise RuntimeError(f"version is {current}, not {version}")
    known = store.select("id")
    if not operations.where("op = 'add'").join(known, "id", "left_semi").isEmpty() or not operations.where("op <> 'add'").join(known, "id", "left_anti").isEmpty():
        raise ValueError("an id is there already, or isn't known")
    out = store.join(operations.where("op = 'delete'").select("id"), "id", "left_anti").join(operations.where("op = 'toggle'").select("id", F.lit(True).alias("__t")), "id", "left")
    out = out.withColumn("disabled", F.when(F.coalesce("__t", F.lit(False)), ~F.col("disabled")).otherwise(F.col("disabled"))).drop("__t")
    added = operations.where("op = 'add'").select("id", "kind", "value", F.coalesce("disabled", F.lit(False)).alias("disabled"))
    return version + 1, out.drop("version").unionByName(added).withColumn("version", F.lit(version + 1))


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the target and renames, so readers see the old or the new table; the old one goes last."""
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(p(path))
    if had and not fs.rename(p(path), p(old)) or not fs.rename(p(staged), p(path)):
        raise OSError(f"{path} could not be replaced")
    if had:
        fs.delete(p(old), True)


def rss_items(rows: DataFrame, day: str, title: str, link: str, summary: str, days: int = 14, per_day: int = 20, order: str = "rank") -> DataFrame:
    """(day, xml) of the latest days' items, at most per_day each."""
    latest = rows.select(day).distinct().orderBy(F.desc(day)).limit(days)
    top = rows.join(F.broadcast(latest), day).withColumn("__r", F.row_number().over(W.partitionBy(day).orderBy(order))).where(F.col("__r") <= per_day)
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return top.select(day, "__r", F.concat(F.lit("<item><title>"), safe(title), F.lit("</title><link>"), safe(link), F.lit("</link><description>"), safe(summary), F.lit("</description></item>")).alias("xml"))


def render_rss(spark: SparkSession, items: DataFrame, day: str, title: str) -> str:
    """The whole feed; rss_items bounds its size."""
    rows = items.orderBy(F.desc(day), "__r").select("xml").collect()
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title>{"".join(r["xml"] for r in rows)}</channel></rss>'
