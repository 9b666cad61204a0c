"""Queries over the harness's tables: field contracts, URL identity, gates, editorial folds, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import normalize as N
from tidewire.functions import text as X
from tidewire.functions import urls as U
from tidewire.operators import editorial as E
from tidewire.session import scratch_path, table
from tidewire.sources.state import table_or_empty
from tidewire.streaming import state

#: Fixed values of the topic rules used on the harness's documents.
TOPICS = (("dense", ["tion", "ment"]), ("ing", ["ing "]), ("german", ["sch", "ung"]), ("romance", ["ción", "que"]))


def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", U.article_url_col(F.col("url")).alias("canonical"))


def url_identity(spark, d):
    c = U.article_url_col(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.identity(c).alias("id"), U.invalid_reason(c).alias("reason"))


def url_groups(spark, d):
    """Pages of one host and first path segment, as groups with their best row."""
    p = table(spark, d, "pages").select("page_id", F.regexp_replace(U.host(F.col("url")), r"^blog\.", "").alias("site"))
    return p.groupBy("site").agg(F.count("*").alias("n"), F.max("page_id").alias("best"))


def blocked_sources(spark, d):
    return table(spark, d, "pages").select("page_id", U.blocked(F.col("url"), ["example.org", "spam-farm.example.com"]).alias("blocked"))


def source_roles(spark, d):
    """Roles of the hosts of pages, and of hosts made from customers and suppliers so that each rung of the ladder is met."""
    k = F.pmod("c_custkey", F.lit(5))
    ending = F.when(k == 0, ".go.kr").when(k == 1, ".gov").when(k == 2, ".gov.uk").when(k == 3, ".co.kr").otherwise(".com")
    hosts = table(spark, d, "pages").select(U.host_plain(F.col("url")).alias("h"))
    hosts = hosts.unionAll(table(spark, d, "customer").select(F.concat(F.replace(F.lower("c_mktsegment"), F.lit(" "), F.lit("")), ending)))
    hosts = hosts.unionAll(table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "prnewswire.com").when(F.col("s_suppkey") % 3 == 1, "businesswire.com")))
    r = U.source_role(F.col("h"))
    return hosts.select(r["source_type"].alias("source_type"), r["tier"].alias("tier")).groupBy("source_type", "tier").agg(F.count("*").alias("n"))


def body_extract(spark, d):
    body = E.article_body(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(body).alias("n"), F.md5(body).alias("md5"))


def title_keys(spark, d):
    t = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").select(X.title_key(t).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def calendar_days(spark, d):
    e = table(spark, d, "events").select("event_id", N.kst_day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).cast("string").alias("day"))
    return e.groupBy("day").agg(F.count("*").alias("n"))


def topics_by_rule(spark, d):
    i = N.infer(F.array().cast("array<string>"), F.lower("text"), [(k, list(v)) for k, v in TOPICS], 3)
    return table(spark, d, "documents").select("doc_id", F.array_join(i["values"], ",").alias("topics"), i["source"].alias("source"))


def region_ladder(spark, d):
    c = table(spark, d, "customer")
    scope = F.when(F.col("c_custkey") % 5 == 0, "kr").when(F.col("c_custkey") % 5 == 1, "overseas")
    countries = F.when(F.col("c_nationkey") == 3, F.array(F.lit("KR"))).when(F.col("c_nationkey") > 15, F.array(F.lit("US"))).otherwise(F.array().cast("array<string>"))
    section = F.when(F.col("c_mktsegment") == "BUILDING", "khnp").when(F.col("c_mktsegment") == "MACHINERY", "international")
    return c.select("c_custkey", N.region(scope, countries, section, F.lit("x.kr")).alias("region"))


def tag_canonical(spark, d):
    return table(spark, d, "part").groupBy(N.canonical_tag(F.concat(F.lit(" #"), "p_type"), {"promobrushedtin": "tin"}).alias("tag")).agg(F.count("*").alias("n"))


def capped_tags(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return t.select("l_orderkey", F.array_join(N.capped(F.transform("x", lambda s: s["l_returnflag"]), 2, ["A", "R", "N"], {"N": "R"}), ",").alias("tags"))


def event_date_contract(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 4 == 0, "2024-02-30").when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, "soon")
    e = N.event_date(raw, F.lit("Deadline"), F.lit("day"), F.lit("rumour"))
    return o.select("o_orderkey", e["event_date"].cast("string").alias("event_date"), e["type"].alias("type"), e["precision"].alias("precision"), e["source"].alias("source"))


def local_vector_norms(spark, d):
    v = E.local_vectors(table(spark, d, "benchmark").withColumn("title", F.split_part("text", F.lit("."), F.lit(1))), "item_id", "title", "text")
    return v.groupBy("item_id").agg(F.round(F.sum(F.col("value") * F.col("value")), 6).alias("norm"), F.count("*").alias("cells"))


def featured_flows(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    flows = li.groupBy(F.year("l_shipdate").alias("y"), "l_partkey").agg(F.sum("l_quantity").alias("signal"), F.collect_set("s_nationkey").alias("regions"), F.collect_set("l_orderkey").alias("evidence"))
    return E.featured(flows, "y", "l_partkey", "signal", "regions", "evidence")


def daily_headlines(spark, d):
    e = table(spark, d, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), F.col("event_id").alias("rank"), F.concat_ws(" ", F.lit("user"), F.pmod("user_id", F.lit(5)).cast("string"), "event_type").alias("title"))
    first = e.groupBy("event_type", "day", "title").agg(F.min("rank").alias("rank"))
    return E.headlines(first, "event_type", "day", "rank", "title")


def stream_type_counts(spark, d):
    """Event-time windows over the events read as a stream, run to the end of the input."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d).withColumn("at", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "stream")
    counts = state.windowed_counts(stream, "at", ["event_type"], "1 day", late="40 days")
    # each batch replaces the whole table, so a retried batch changes nothing
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/counts")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return table_or_empty(spark, f"{out}/counts", counts.schema).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


SQL = {
    "url_canonical": r"""WITH a AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), b AS (SELECT page_id, string_split(u, '?')[1] AS base, list_filter(string_split(coalesce(string_split(u, '?')[2], ''), '&'), lambda x: x <> '' AND NOT starts_with(x, 'ref=') AND NOT starts_with(x, 'utm_source=')) AS q FROM a)
        SELECT page_id, regexp_replace(base, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS canonical FROM b""",
    "url_groups": r"SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', ''), '^m\.', ''), '^amp\.', ''), '^blog\.', '') AS site, count(*) AS n, max(page_id) AS best FROM pages GROUP BY 1",
    "blocked_sources": r"WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', ''), '^m\.', '') AS h FROM pages) SELECT page_id, h IN ('example.org', 'spam-farm.example.com') OR ends_with(h, '.example.org') OR ends_with(h, '.spam-farm.example.com') AS blocked FROM h",
    "source_roles": r"""WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)), '^www\.', '') AS h FROM pages UNION ALL SELECT replace(lower(c_mktsegment), ' ', '') || CASE c_custkey % 5 WHEN 0 THEN '.go.kr' WHEN 1 THEN '.gov' WHEN 2 THEN '.gov.uk' WHEN 3 THEN '.co.kr' ELSE '.com' END FROM customer UNION ALL SELECT CASE s_suppkey % 3 WHEN 0 THEN 'prnewswire.com' WHEN 1 THEN 'businesswire.com' END FROM supplier)
        SELECT CASE WHEN regexp_matches(h, '\.(go\.kr|gov|gov\.uk)$') THEN 'official' WHEN h IN ('globenewswire.com', 'prnewswire.com', 'businesswire.com') THEN 'press_release' WHEN coalesce(h, '') <> '' THEN 'general_media' ELSE 'unknown' END AS source_type, CASE WHEN regexp_matches(h, '\.(go\.kr|gov|gov\.uk)$') THEN 1 ELSE 3 END AS tier, count(*) AS n FROM h GROUP BY 1, 2""",
    "title_keys": r"SELECT lower(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g'))) AS k, count(*) AS n FROM documents GROUP BY 1",
    "calendar_days": "SELECT ((ts + INTERVAL 9 HOUR)::date)::varchar AS day, count(*) AS n FROM events GROUP BY 1",
    "topics_by_rule": """WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), r AS (SELECT doc_id, list_filter([CASE WHEN contains(t, 'tion') OR contains(t, 'ment') THEN 'dense' END, CASE WHEN contains(t, 'ing ') THEN 'ing' END, CASE WHEN contains(t, 'sch') OR contains(t, 'ung') THEN 'german' END, CASE WHEN contains(t, 'ción') OR contains(t, 'que') THEN 'romance' END], lambda x: x IS NOT NULL)[1:3] AS v FROM t)
        SELECT doc_id, array_to_string(v, ',') AS topics, CASE WHEN len(v) > 0 THEN 'rules' ELSE 'none' END AS source FROM r""",
    "region_ladder": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'domestic' WHEN c_custkey % 5 = 1 THEN 'overseas' WHEN c_nationkey = 3 THEN 'domestic' WHEN c_nationkey > 15 THEN 'overseas' WHEN c_mktsegment = 'BUILDING' THEN 'domestic' WHEN c_mktsegment = 'MACHINERY' THEN 'overseas' ELSE 'domestic' END AS region FROM customer""",
    "tag_canonical": "SELECT CASE WHEN t = 'promobrushedtin' THEN 'tin' ELSE t END AS tag, count(*) AS n FROM (SELECT regexp_replace(lower(p_type), '\\s+', '', 'g') AS t FROM part) GROUP BY 1",
    "capped_tags": """WITH x AS (SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN 'R' ELSE l_returnflag END AS f, min((l_linenumber, l_returnflag)) AS k FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, array_to_string(list(f ORDER BY k)[1:2], ',') AS tags FROM x GROUP BY 1""",
    "event_date_contract": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN o_orderdate::date::varchar END AS event_date, CASE WHEN o_orderkey % 4 = 1 THEN 'deadline' ELSE 'unknown' END AS type, CASE WHEN o_orderkey % 4 = 1 THEN 'day' ELSE 'unknown' END AS precision, 'unknown' AS source FROM orders""",
    "stream_type_counts": "SELECT ts::date::varchar AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
QUERIES = {k: globals()[k] for k in [*SQL, "url_identity", "body_extract", "local_vector_norms", "featured_flows", "daily_headlines"]}
