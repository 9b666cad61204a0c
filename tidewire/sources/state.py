"""State and settings of the jobs: tables that may be missing, files that may be broken, rows that may be wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidewire.operators.links import override_table


def table_or_empty(spark: SparkSession, path: str, schema: str | T.StructType, form: str = "parquet") -> DataFrame:
    """A state table, or one without rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document below path; a missing or broken one gives no row, unknown keys are left out."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    got = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("d"), F.try_parse_json("value").isNotNull().alias("ok"))
    return got.where("ok").select("d.*")


def settings(defaults: dict, loaded: dict | None) -> dict:
    """Defaults with the loaded keys over them; keys that begin with _ are remarks, and what is no object changes nothing."""
    return {**defaults, **{k: v for k, v in loaded.items() if not k.startswith("_")}} if isinstance(loaded, dict) else dict(defaults)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, name_kr, name_en, aliases, ord) of an entity registry; rows without id or type are skipped, the first of an id counts."""
    got = json_document(spark, path, "entities array<struct<id:string,type:string,name_kr:string,name_en:string,aliases:array<string>>>")
    each = got.select(F.posexplode("entities").alias("ord", "e")).select("ord", "e.*").where("coalesce(id, '') <> '' and coalesce(type, '') <> ''")
    return each.groupBy("id").agg(F.min(F.struct("ord", "type", "name_kr", "name_en", "aliases")).alias("f")).select("id", "f.type", "f.name_kr", "f.name_en", F.coalesce("f.aliases", F.array().cast("array<string>")).alias("aliases"), "f.ord")


def sources(spark: SparkSession, path: str) -> DataFrame:
    """(domain, publisher, source_type, evidence_role, tier, names) of a source list by tiers."""
    entry = "array<struct<name:string,domain:string,source_type:string,evidence_role:string,rank_tier:int,aliases:array<string>>>"
    got = json_document(spark, path, f"tier1 {entry}, tier2 {entry}, tier3 {entry}")
    parts = [got.select(F.explode(f"tier{t}").alias("e"), F.lit(t).alias("listed")) for t in (1, 2, 3)]
    each = parts[0].unionAll(parts[1]).unionAll(parts[2]).select("e.*", "listed")
    names = F.transform(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))), lambda n: F.lower(F.trim(n)))
    return each.select(F.lower(F.trim("domain")).alias("domain"), F.trim("name").alias("publisher"), F.coalesce("source_type", F.lit("unknown")).alias("source_type"), F.coalesce("evidence_role", F.lit("unknown")).alias("evidence_role"), F.coalesce("rank_tier", "listed").alias("tier"), F.filter(names, lambda n: n != "").alias("names"))


def match_overrides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, right, verdict, disabled) -> approved and rejected pairs, in canonical order; disabled, blank and loop rows are skipped, rejection wins."""
    good = rows.where("not coalesce(disabled, false) and coalesce(left, '') <> '' and coalesce(right, '') <> '' and left <> right").select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "verdict").distinct()
    rejected = good.where("verdict = 'rejected'").select("left", "right")
    return good.where("verdict = 'approved'").select("left", "right").join(rejected, ["left", "right"], "left_anti"), rejected


def selection_overrides(spark: SparkSession, path: str) -> DataFrame:
    """override_table of a JSON document {promote: [...], demote: [...]}."""
    row = "array<struct<hash8:string,hash:string,date:string,action:string>>"
    got = json_document(spark, path, f"promote {row}, demote {row}")
    side = lambda name, action: got.select(F.explode(name).alias("r")).select(F.coalesce("r.hash8", "r.hash").alias("hash"), F.col("r.date").alias("day"), action.alias("action"))
    return override_table(side("promote", F.lit("promote")).unionAll(side("demote", F.coalesce(F.col("r.action"), F.lit("hide")))))


def country_repairs(spark: SparkSession, path: str) -> DataFrame:
    """(hash, countries) of a JSON object of repairs by hash; entries without a list of countries repair something else."""
    got = _by_key(spark, path)
    codes = F.filter(F.transform("countries", lambda c: F.upper(F.trim(c))), lambda c: c != "")
    return got.where("countries is not null").select("hash", codes.alias("countries"))


def _by_key(spark: SparkSession, path: str) -> DataFrame:
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "hash string, countries array<string>")
    entries = F.explode(F.from_json("value", "map<string,struct<countries:array<string>>>"))
    return text.select(entries.alias("hash", "r")).select("hash", F.col("r.countries").alias("countries"))


def weekly_reports(spark: SparkSession, path: str) -> DataFrame:
    """(week_start, title, summary) of the stored reports, one a week: the last of a week's."""
    got = json_document(spark, path, "reports array<struct<week_start:string,title:string,summary:string>>")
    each = got.select(F.posexplode("reports").alias("ord", "r")).select("ord", "r.*").where("coalesce(week_start, '') <> ''")
    return each.groupBy("week_start").agg(F.max(F.struct("ord", "title", "summary")).alias("l")).select("week_start", "l.title", "l.summary")


def publications(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, url, org, date) of the stored publications that have a title and a link."""
    got = json_document(spark, path, "items array<struct<id:string,title:string,url:string,org:string,date:string>>")
    return got.select(F.explode("items").alias("r")).select("r.*").where("coalesce(title, '') <> '' and coalesce(url, '') <> ''")


def negative_examples(spark: SparkSession, path: str, least: int = 6) -> DataFrame:
    """(example): rejected examples of a knowledge base with at least `least` characters."""
    text = json_document(spark, path, "reports array<struct<negative_examples:array<string>>>")
    return text.select(F.explode("reports.negative_examples").alias("n")).select(F.explode("n").alias("example")).select(F.trim("example").alias("example")).where(F.length("example") >= least)


def admin_store(spark: SparkSession, path: str) -> DataFrame:
    """(version, entries) of the console's store; a broken one is version 0 without entries."""
    got = json_document(spark, path, "version long, entries array<struct<id:string,kind:string,group:string,value:string,disabled:boolean>>")
    empty = spark.createDataFrame([(0, [])], got.schema)
    return got if not got.isEmpty() else empty
