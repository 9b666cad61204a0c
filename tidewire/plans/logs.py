"""Queries over logs and stores: the harness's tables written as JSON lines and read back leniently, and the sinks' rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import normalize as N
from tidewire.functions import text as X
from tidewire.functions import urls as U
from tidewire.operators import protocols as Q
from tidewire.sources import jsonl, sinks
from tidewire.session import scratch_path, table


def _lines(spark, rows: DataFrame, order: str, name: str) -> str:
    """JSON lines in order, over as many files as there are partitions: a file's name and a line's place give the order back."""
    path = scratch_path(spark, name)
    lines = rows.repartitionByRange(order).sortWithinPartitions(order)
    broken = F.when(F.col(order) % 10 == 3, F.lit("{broken")).when(F.col(order) % 10 == 7, F.lit("[1]")).otherwise(F.to_json(F.struct(*(c for c in rows.columns if c != order))))
    lines.select(broken.alias("value")).write.text(path)
    return path


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("hash"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("event_type") == "error", "selection_stats").alias("record_type"), F.col("event_type").alias("section"), F.col("value").alias("score"), F.when(F.col("value") > 20, "ok").when(F.col("value") > 5, "partial").alias("pipeline_status"), F.date_format("ts", "HH:mm:ss").alias("generated_at"))


def delivery_log(spark, d):
    """The last delivered line of each hash, broken and other lines aside."""
    log = jsonl.read_lines(spark, _lines(spark, _events(spark, d), "event_id", "deliveries"), jsonl.DELIVERY)
    return jsonl.deliveries(log).select("hash", "date", "section", F.round("score", 6).alias("score"))


def stats_log(spark, d):
    log = jsonl.read_lines(spark, _lines(spark, _events(spark, d), "event_id", "stats"), jsonl.DELIVERY)
    return jsonl.selection_stats(log).select("date", "pipeline_status", "generated_at")


def archive_lines(spark, d):
    """Archive rows by domain, blocked ones aside."""
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 9 == 0, "").otherwise(F.col("page_id").cast("string")).alias("hash"), "url", U.host_plain(F.col("url")).alias("domain"), F.when(F.col("page_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"))
    rows = jsonl.read_archive(spark, _lines(spark, p, "page_id", "archive"), U.blocked(F.col("url"), ["example.org"]))
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.size("tags")).alias("tags"))


def seen_identities(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("hash"), F.concat(F.lit("https://h.kr/"), (F.col("doc_id") % 50).cast("string"), F.lit("?utm_source=a")).alias("url"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    keys = jsonl.identities(rows, U.article_url_col(F.col("url")), X.title_key(F.col("title")))
    return keys.agg(F.countDistinct("hash").alias("hashes"), F.countDistinct("url_key").alias("urls"), F.countDistinct("title_key").alias("titles"))


def appended_once(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    return sinks.append_once(o, o.where("o_custkey % 3 = 0 and o_orderstatus = 'F'"), ["o_custkey", "o_orderstatus"])


def upserted(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = table(spark, d, "customer").where("c_custkey % 4 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lower("c_mktsegment").alias("c_mktsegment"))
    return sinks.upsert(c, new, ["c_custkey"])


def enriched(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("brand"))
    new = table(spark, d, "part").where("p_partkey % 2 = 0").select((F.col("p_partkey") + 50).alias("p_partkey"), F.col("p_type").alias("brand"))
    return sinks.enrich(p, new, "p_partkey", ["brand"])


def unexpired(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 20 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"))
    today = F.lit(table(spark, d, "events").agg(F.max(F.to_date("ts"))).first()[0])
    return sinks.expire(e, "at", today, 3).select("event_id")


def new_archive_records(spark, d):
    """Orders whose address and title no older order has, the first of those that share either within a day's run."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("run"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))).alias("title"))
    old = o.where("o_orderkey % 5 = 0")
    return sinks.new_records(o.where("o_orderkey % 5 <> 0"), old, ["url", "title"], ["o_orderkey"], "run").select("o_orderkey", "run")


def valid_vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<double>")).when(F.col("vec_id") % 7 == 1, F.array(F.lit(float("nan")))).otherwise(F.col("embedding").cast("array<double>")).alias("v"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise("now").alias("model"))
    return jsonl.valid_vectors(v, "v", "model", "now").select("vec_id")


def social_noise(spark, d):
    c = table(spark, d, "conversations")
    meta = F.concat(F.lit("2024 | @"), F.when(F.col("conv_id") % 3 == 0, "iaeaorg").otherwise("someone"), F.lit(" ["), (F.col("turn") * 4).cast("string"), F.lit("likes, "), F.col("turn").cast("string"), F.lit("rt]"))
    title = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("@x "), F.col("role"))).when(F.col("turn") % 4 == 1, "That damn reactor").when(F.col("turn") % 4 == 2, "New game out").otherwise("Reactor news")
    reason = N.social_noise(title, F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("X"))).otherwise(F.array(F.lit("X"), F.lit("Reddit"))), meta, F.col("turn") * 10 + 15, ["damn"], ["game"], ["iaeaorg"])
    return c.select("conv_id", "turn", F.coalesce(reason, F.lit("kept")).alias("reason"))


def model_verdicts(spark, d):
    """Verdicts of answers in several states: fenced, with words around, of the wrong type, broken."""
    o = table(spark, d, "orders").where("o_orderkey is not null").select("o_custkey", "o_orderkey")
    asked = o.withColumn("idx", (F.col("o_orderkey") % 4).cast("int")).groupBy(F.col("o_custkey").alias("batch"), "idx").agg(F.min("o_orderkey").alias("o_orderkey"))
    item = lambda i, same: F.format_string('{"idx": %s, "same_event": %s}', i, same)
    body = F.concat(F.lit('{"items": ['), item(F.lit("0"), F.lit("true")), F.lit(", "), item(F.lit('"1"'), F.lit("false")), F.lit(", "), item(F.lit("2"), F.lit('"true"')), F.lit(", "), item(F.lit("9"), F.lit("true")), F.lit("]}"))
    said = table(spark, d, "customer").select(F.col("c_custkey").alias("batch"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("Sure: "), body)).when(F.col("c_custkey") % 4 == 2, F.lit("{broken")).otherwise(body).alias("payload"))
    return Q.verdicts(said, asked).select("batch", "idx", "o_orderkey", "same")


def cluster_scores(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") % 20).alias("batch"), (F.floor(F.col("c_custkey") / 20)).cast("int").alias("idx"), "c_custkey", "c_acctbal")
    said = c.where("idx % 3 <> 0").groupBy("batch").agg(F.to_json(F.struct(F.collect_list(F.struct("idx", F.floor(F.col("c_acctbal") / 500).cast("double").alias("score"))).alias("scores"))).alias("payload"))
    got = Q.cluster_scores(said.withColumn("payload", F.when(F.col("batch") == 7, "down").otherwise(F.col("payload"))), c)
    return got.select("c_custkey", "ai_score", "kept")


_LIVE = "event_id % 10 NOT IN (3, 7)"
SQL = {
    "delivery_log": f"""SELECT hash, date, section, score FROM (SELECT 'u' || user_id AS hash, strftime(ts, '%Y-%m-%d') AS date, event_type AS section, round(value, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'error' AND {_LIVE}) WHERE r = 1""",
    "stats_log": f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS date, CASE WHEN value > 20 THEN 'ok' WHEN value > 5 THEN 'partial' END AS pipeline_status, strftime(ts, '%H:%M:%S') AS generated_at, event_id FROM events WHERE event_type = 'error' AND {_LIVE})
        SELECT date, pipeline_status, generated_at FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE pipeline_status WHEN 'ok' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END DESC, generated_at DESC, event_id) AS r FROM e) WHERE r = 1""",
    "archive_lines": r"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS domain FROM pages WHERE page_id % 9 <> 0 AND page_id % 10 NOT IN (3, 7)) SELECT domain, count(*) AS n, sum(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END)::bigint AS tags FROM p WHERE NOT regexp_matches(domain, '(^|\.)example\.org$') GROUP BY 1""",
    "seen_identities": r"""SELECT count(DISTINCT doc_id) AS hashes, count(DISTINCT doc_id % 50) AS urls, count(DISTINCT lower(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g')))) AS titles FROM documents""",
    "appended_once": """SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE NOT (o_custkey % 3 = 0 AND o_orderstatus = 'F')""",
    "upserted": """SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey * 2 FROM customer WHERE c_custkey % 4 = 0) UNION ALL SELECT c_custkey * 2, lower(c_mktsegment) FROM customer WHERE c_custkey % 4 = 0""",
    "enriched": """WITH n AS (SELECT p_partkey + 50 AS p_partkey, p_type AS brand FROM part WHERE p_partkey % 2 = 0) SELECT p.p_partkey, CASE WHEN p.p_partkey % 3 <> 0 THEN p_brand ELSE coalesce(n.brand, '') END AS brand FROM part p LEFT JOIN n USING (p_partkey) UNION ALL SELECT * FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM part)""",
    "unexpired": """SELECT event_id FROM events WHERE event_id % 20 = 0 OR ts::date >= (SELECT max(ts::date) FROM events) - 3""",
    "new_archive_records": """WITH o AS (SELECT o_orderkey, o_orderdate::date::varchar AS run, o_custkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)) SELECT min(o_orderkey) AS o_orderkey, run FROM o GROUP BY run, o_custkey""",
    "valid_vectors": """SELECT vec_id FROM embeddings WHERE vec_id % 7 > 1 AND vec_id % 5 <> 0""",
    "social_noise": """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND conv_id % 3 <> 0 THEN 'reply_chain' WHEN turn % 4 = 1 THEN 'profanity' WHEN turn % 4 = 2 THEN 'hobby' WHEN conv_id % 2 = 0 AND conv_id % 3 <> 0 AND turn * 4 < 5 AND turn < 2 THEN 'low_engagement' WHEN turn * 10 + 15 < 30 THEN 'low_score' ELSE 'kept' END AS reason FROM conversations""",
    "model_verdicts": """SELECT o_custkey AS batch, (o_orderkey % 4)::int AS idx, min(o_orderkey) AS o_orderkey, o_orderkey % 4 = 0 AS same FROM orders WHERE o_orderkey % 4 <= 1 AND o_custkey % 4 <> 2 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1, 2, 4""",
    "cluster_scores": """WITH c AS (SELECT c_custkey, CASE WHEN (c_custkey // 20) % 3 <> 0 AND c_custkey % 20 <> 7 THEN greatest(0.0, least(10.0, floor(c_acctbal / 500)))::double END AS ai_score FROM customer) SELECT c_custkey, ai_score, ai_score IS NULL OR ai_score >= 6 AS kept FROM c""",
}
QUERIES = {k: globals()[k] for k in SQL}
