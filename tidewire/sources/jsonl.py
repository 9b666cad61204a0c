"""Lenient readers of JSON-lines logs and archives: bad lines, non-objects and missing fields never fail a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

_STRINGS = ("hash", "url", "resolved_url", "domain", "feed", "publisher", "site_name", "title", "title_kr", "archived_at", "pub", "source_type", "evidence_role", "summary", "detail", "implication", "why_important", "open_question", "importance", "section", "scope", "category", "article_type", "event_date", "event_date_type", "event_date_precision", "event_date_source")
#: The archive's record, version 2.
ARCHIVE = T.StructType(
    [T.StructField("v", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in _STRINGS), T.StructField("source_tier", T.IntegerType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("tags", "topics", "countries"))]
    + [T.StructField("features", T.MapType(T.StringType(), T.StringType())), T.StructField("folded_count", T.IntegerType())]
)
DELIVERY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_type", "date", "hash", "title_kr", "region", "section", "scope", "domain", "theme", "generated_at", "pipeline_status")]
    + [T.StructField("score", T.DoubleType()), T.StructField("breakdown", T.MapType(T.StringType(), T.StringType()))]
)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the lines that hold a JSON object; adds __file and __line (order within the file)."""
    raw = spark.read.text(path).select(F.input_file_name().alias("__file"), F.monotonically_increasing_id().alias("__line"), F.trim("value").alias("value"))
    parsed = raw.where(F.col("value").startswith("{")).withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    ok = F.try_parse_json("value").isNotNull()
    return parsed.where(ok).select("__file", "__line", "r.*")


def read_archive(spark: SparkSession, path: str, blocked: Column | None = None) -> DataFrame:
    """Archive rows with a hash; blocked: a condition on domain, resolved_url or url that removes rows. Blank arrays for missing ones."""
    rows = read_lines(spark, path, ARCHIVE).where(F.coalesce("hash", F.lit("")) != "")
    for c in ("tags", "topics", "countries"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return rows.where(~F.coalesce(blocked, F.lit(False))) if blocked is not None else rows


def recent_months(rows: DataFrame, month: str, now: Column, n: int = 2) -> DataFrame:
    """The partitions of the current and the n - 1 months before; a filter on the partition column only."""
    months = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_format(F.add_months(now, -i), "yyyy-MM"))
    return rows.where(F.array_contains(months, F.col(month)))


def identities(rows: DataFrame, canonical: Column, key: Column) -> DataFrame:
    """The three key sets of seen articles."""
    return rows.select("hash", canonical.alias("url_key"), key.alias("title_key")).distinct()


def deliveries(rows: DataFrame) -> DataFrame:
    """Article rows of the delivery log: the last line for each hash."""
    articles = rows.where(F.col("record_type").isNull() & F.col("hash").isNotNull() & F.col("date").isNotNull())
    w = W.partitionBy("hash").orderBy(F.desc("__file"), F.desc("__line"))
    return articles.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def selection_stats(rows: DataFrame) -> DataFrame:
    """One stats row for each date: the best status, then the latest, then the first line."""
    rank = F.when(F.col("pipeline_status") == "ok", 2).when(F.col("pipeline_status") == "partial", 1).otherwise(0)
    w = W.partitionBy("date").orderBy(F.desc(rank), F.desc("generated_at"), "__file", "__line")
    return rows.where("record_type = 'selection_stats'").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def delivered_window(archive: DataFrame, log: DataFrame, days: int = 21) -> DataFrame:
    """Archive rows delivered within `days` of the latest delivery; the last archive row for each hash."""
    end = log.agg(F.max("date").alias("__end"))
    near = log.crossJoin(F.broadcast(end)).where(F.datediff(F.col("__end").cast("date"), F.col("date").cast("date")) <= days).select("hash").distinct()
    w = W.partitionBy("hash").orderBy(F.desc("__file"), F.desc("__line"))
    return archive.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").join(near, "hash", "left_semi")


def upgrade(rows: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """Version 1 to 2: blanks filled, repairs (hash, countries) laid over."""
    out = rows.withColumns({"v": F.lit(2), "source_type": F.coalesce("source_type", F.lit("unknown")), "evidence_role": F.coalesce("evidence_role", F.lit("unknown")), "source_tier": F.coalesce("source_tier", F.lit(3))})
    if repairs is None:
        return out
    return out.join(F.broadcast(repairs.select("hash", F.col("countries").alias("__c"))), "hash", "left").withColumn("countries", F.coalesce("__c", "countries")).drop("__c")


def valid_vectors(rows: DataFrame, vector: str, model: str, current: str) -> DataFrame:
    """Cached vectors of the current model that are finite and not empty."""
    v = F.col(vector)
    return rows.where((F.col(model) == current) & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)))
