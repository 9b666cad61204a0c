"""Queries over the harness's tables: aggregates, windows, periods. Each has DuckDB SQL of the same name in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import aggregates as A
from tidewire.session import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", F.to_date("ts").alias("day"))


def tag_windows(spark, d):
    e = _events(spark, d)
    today = F.lit(e.agg(F.max("day")).first()[0])
    return A.tag_windows(e, "event_type", "day", today)


def rising_event_types(spark, d):
    e = _events(spark, d).withColumn("tag", F.concat_ws("-", "event_type", F.pmod("user_id", F.lit(11)).cast("string")))
    today = F.lit(e.agg(F.max("day")).first()[0])
    return A.rising_tags(A.tag_windows(e, "tag", "day", today), "tag")


def new_event_types(spark, d):
    e = _events(spark, d).withColumn("tag", F.concat_ws("-", "event_type", F.col("user_id").cast("string"), F.floor("value").cast("string")))
    today = F.lit(e.agg(F.max("day")).first()[0])
    return A.new_tags(A.tag_windows(e, "tag", "day", today), "tag")


def period_fanout_prev_null(spark, d):
    e = _events(spark, d)
    end = e.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return A.period_fanout(e, "day", end, "user_id", "event_type")


def period_fanout_orders(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_custkey", "o_orderpriority")
    return A.period_fanout(o, "day", o.agg(F.min("day").alias("first"), F.max("day").alias("last")), "o_custkey", "o_orderpriority")


def bucket_timeline_from_end(spark, d):
    e = _events(spark, d)
    last = F.lit(e.agg(F.max("day")).first()[0])
    return A.bucket_timeline(e, "day", last, 7, 30)


def bucket_top_types(spark, d):
    e = _events(spark, d)
    last = F.lit(e.agg(F.max("day")).first()[0])
    counts = e.withColumn("bucket", F.floor(F.datediff(last, "day") / 7).cast("int")).groupBy("bucket", "event_type").agg(F.count("*").alias("n"))
    return A.top_in_group(counts, ["bucket"], [F.desc("n"), F.asc("event_type")], 3)


def iso_week_alive_counts(spark, d):
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last"), F.min("o_orderpriority").alias("topic"))
    return A.alive_weeks(spans, "o_custkey", "first", "last", "topic")


def latest_status_per_key(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    return A.first_by(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


def pick_daily_stats(spark, d):
    e = _events(spark, d)
    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return A.first_by(e, ["day"], [F.desc(rank), F.desc("ts"), F.asc("event_id")]).select("day", "event_id", "event_type")


def verification_ladder(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity")
    return A.verification(rows, "l_orderkey", "l_suppkey", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))


def metrics_insufficient_guard(spark, d):
    rows = table(spark, d, "orders").withColumn("bucket", F.pmod("o_custkey", F.lit(97)))
    return A.guarded_rates(rows, "bucket", {"open_rate": F.col("o_orderstatus") == "O", "urgent_rate": F.col("o_orderpriority").startswith("1")}, least=160)


def mode_with_alpha_tiebreak(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.mode_by_group(rows, "c_nationkey", "o_orderpriority").select("c_nationkey", "o_orderpriority", "n")


def weekly_movers(spark, d):
    e = _events(spark, d)
    start = F.date_sub(F.lit(e.agg(F.max("day")).first()[0]), 6)
    return A.movers(e, "user_id", "day", "event_type", start)


def issue_lifecycle(spark, d):
    e = _events(spark, d)
    return A.lifecycle(e, "user_id", "day", F.lit(e.agg(F.max("day")).first()[0]))


def issue_catalog(spark, d):
    """Orders as issues, their lines as members."""
    li = table(spark, d, "lineitem")
    a = li.groupBy("l_orderkey").agg(
        F.count("*").alias("articles"), F.countDistinct("l_suppkey").alias("outlets"), F.min(F.to_date("l_shipdate")).alias("first_seen"), F.max(F.to_date("l_shipdate")).alias("last_seen"), F.max("l_quantity").alias("top_score"),
        F.count_if(F.col("l_returnflag") == "R").alias("must_read"), F.array_join(F.slice(F.array_sort(F.collect_set("l_linestatus")), 1, 3), ",").alias("tags"),
    )
    return a.withColumn("tracked", F.col("first_seen") < F.col("last_seen"))


def entity_rollup_with_zero(spark, d):
    registry = table(spark, d, "part").select("p_partkey", "p_brand")
    mentions = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", F.to_date("l_shipdate").alias("day"))
    return A.registry_rollup(registry, mentions, "p_partkey", "l_orderkey", "day")


def country_issue_counts(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("issues"), F.countDistinct("o_custkey").alias("sources"))


def system_status(spark, d):
    e = _events(spark, d)
    return A.heartbeat(e, "ts", F.to_timestamp(F.lit("2024-02-01 00:00:00")), 10.0).select("age_hours", "stale")


def max_calls_in_60s(spark, d):
    return A.peak_in_window(_events(spark, d), "event_type", "ts", 60)


def topic_week_shares(spark, d):
    e = _events(spark, d)
    return A.daily_share(e, A.iso_week(F.col("day")), "event_type", "user_id")


def role_turn_rollup(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"), F.min_by("role", F.struct("turn", "role")).alias("first_role"), F.max_by("role", F.struct("turn", "role")).alias("last_role"),
    )


def field_fill(spark, d):
    """Share of filled fields per event type, over a conditional denominator."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("k").isNotNull().cast("double")), 6).alias("k_fill"), F.round(F.avg(F.when(F.col("value") > 10, (F.col("k") > 50).cast("double"))), 6).alias("k_high_of_valued"))


def unique_issue_estimate(spark, d):
    t = F.regexp_replace(F.lower(F.split_part("text", F.lit("\n"), F.lit(1))), "[^a-z0-9]+", "")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct(t).alias("unique_titles"))


def recall_by_stage(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", "left")
    return j.groupBy("quality").agg(F.count("*").alias("required"), F.round(F.avg(F.col("lang").isNotNull().cast("double")), 6).alias("collected"), F.round(F.avg(F.coalesce((F.col("n_chars") > 500).cast("double"), F.lit(0.0))), 6).alias("exposed"))


def story_construction(spark, d):
    """Member rows folded into stories with sets and a representative by lexicographic key."""
    li = table(spark, d, "lineitem")
    key = F.struct("l_quantity", "l_extendedprice", (-F.col("l_linenumber")).alias("ln"))
    return li.groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("day"), F.countDistinct("l_suppkey").alias("outlets"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("flags"), F.max(F.col("l_discount") > 0.09).alias("any_deep"), F.min(F.col("l_tax") > 0).alias("all_taxed"), F.max_by("l_partkey", key).alias("rep_part"))


def briefing_rollup(spark, d):
    """Per day and type: rows of the day against history before it."""
    e = _events(spark, d)
    per = e.groupBy("event_type", "day").agg(F.count("*").alias("current"))
    from pyspark.sql.window import Window as W

    return per.withColumn("history", F.coalesce(F.sum("current").over(W.partitionBy("event_type").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def open_questions_first(spark, d):
    c = table(spark, d, "conversations").where(F.col("text").contains("?") | (F.col("role") == "user"))
    return A.first_by(c.select("conv_id", "turn", F.col("text").alias("question")), ["question"], [F.asc("conv_id"), F.asc("turn")])


def weekly_counters(spark, d):
    """Counters by section and event type as grouping sets."""
    e = _events(spark, d).withColumn("week", A.iso_week(F.col("day")))
    return e.groupingSets([["week", "event_type"], ["week"]], "week", "event_type").agg(F.count("*").alias("n"), F.grouping("event_type").cast("int").alias("is_total"))


SQL = {
    "tag_windows": """WITH e AS (SELECT event_type, ts::date AS day FROM events), t AS (SELECT max(day) AS today FROM e)
        SELECT event_type, sum((day >= today - 7)::int)::bigint AS now7, sum((day >= today - 14 AND day < today - 7)::int)::bigint AS prev7, sum((day >= today - 30)::int)::bigint AS last30, sum((day < today - 7)::int)::bigint AS before7 FROM e, t GROUP BY 1""",
    "rising_event_types": """WITH e AS (SELECT event_type || '-' || (user_id % 11) AS tag, ts::date AS day FROM events), t AS (SELECT max(day) AS today FROM e),
        w AS (SELECT tag, sum((day >= today - 7)::int) AS now7, sum((day >= today - 14 AND day < today - 7)::int) AS prev7 FROM e, t GROUP BY 1)
        SELECT tag, now7, prev7, now7 - prev7 AS delta FROM w WHERE now7 >= 3 AND now7 > prev7 ORDER BY delta DESC, now7 DESC, tag LIMIT 10""",
    "new_event_types": """WITH e AS (SELECT event_type || '-' || user_id || '-' || floor(value)::bigint AS tag, ts::date AS day FROM events), t AS (SELECT max(day) AS today FROM e)
        SELECT tag, sum((day >= today - 7)::int) AS now7 FROM e, t GROUP BY 1 HAVING sum((day < today - 7)::int) = 0 AND sum((day >= today - 7)::int) >= 2""",
    "bucket_timeline_from_end": """WITH e AS (SELECT ts::date AS day FROM events), t AS (SELECT max(day) AS last FROM e)
        SELECT ((last - day) // 7)::int AS bucket, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM e, t WHERE last - day BETWEEN 0 AND 29 GROUP BY 1""",
    "bucket_top_types": """WITH e AS (SELECT event_type, ts::date AS day FROM events), t AS (SELECT max(day) AS last FROM e), c AS (SELECT ((last - day) // 7)::int AS bucket, event_type, count(*) AS n FROM e, t GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, event_type) AS rank FROM c) WHERE rank <= 3""",
    "iso_week_alive_counts": """WITH s AS (SELECT o_custkey, min(o_orderdate::date) AS f, max(o_orderdate::date) AS l, min(o_orderpriority) AS topic FROM orders GROUP BY 1),
        w AS (SELECT topic, o_custkey, unnest(generate_series(date_trunc('week', f), date_trunc('week', l), INTERVAL 7 DAY)) AS m FROM s)
        SELECT topic, strftime(m, '%G-W%V') AS week, count(DISTINCT o_custkey) AS n FROM w GROUP BY 1, 2""",
    "latest_status_per_key": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "pick_daily_stats": """SELECT day, event_id, event_type FROM (SELECT *, ts::date AS day, row_number() OVER (PARTITION BY ts::date ORDER BY CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END DESC, ts DESC, event_id) AS r FROM events) WHERE r = 1""",
    "verification_ladder": """WITH a AS (SELECT l_orderkey, l_suppkey, max((l_returnflag = 'R' AND l_quantity > 40)::int) AS o FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey, sum(o)::bigint AS official, sum(1 - o)::bigint AS independent FROM a GROUP BY 1)
        SELECT *, CASE WHEN official > 0 THEN 'confirmed' WHEN independent >= 2 THEN 'cross_checked' WHEN independent = 1 THEN 'single' ELSE 'unverified' END AS state FROM g""",
    "metrics_insufficient_guard": """SELECT o_custkey % 97 AS bucket, count(*) AS n, CASE WHEN count(*) >= 160 THEN round(avg((o_orderstatus = 'O')::int), 6) END AS open_rate, CASE WHEN count(*) >= 160 THEN round(avg(starts_with(o_orderpriority, '1')::int), 6) END AS urgent_rate, CASE WHEN count(*) >= 160 THEN 'ok' ELSE 'insufficient_data' END AS status FROM orders GROUP BY 1""",
    "mode_with_alpha_tiebreak": """SELECT c_nationkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT c_nationkey, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE r = 1""",
    "weekly_movers": """WITH e AS (SELECT *, ts::date AS day FROM events), t AS (SELECT max(day) - 6 AS start FROM e)
        SELECT user_id, count(*) AS n, count(DISTINCT day) AS days, count(DISTINCT event_type) AS sources, max(day) AS last_seen FROM e, t WHERE day >= start GROUP BY 1 ORDER BY n DESC, days DESC, sources DESC, user_id LIMIT 4""",
    "issue_lifecycle": """WITH e AS (SELECT user_id, ts::date AS day FROM events), t AS (SELECT max(day) AS today FROM e), a AS (SELECT user_id, min(day) AS first_seen, max(day) AS last_seen, count(*) AS n, count(DISTINCT day) AS days FROM e GROUP BY 1)
        SELECT a.*, CASE WHEN today - last_seen <= 7 THEN 'active' ELSE 'dormant' END AS lifecycle, CASE WHEN days > 1 THEN 'ongoing' ELSE 'new' END AS status FROM a, t""",
    "issue_catalog": """SELECT l_orderkey, count(*) AS articles, count(DISTINCT l_suppkey) AS outlets, min(l_shipdate::date) AS first_seen, max(l_shipdate::date) AS last_seen, max(l_quantity) AS top_score, count(*) FILTER (l_returnflag = 'R') AS must_read, array_to_string(list_sort(list(DISTINCT l_linestatus))[1:3], ',') AS tags, min(l_shipdate::date) < max(l_shipdate::date) AS tracked FROM lineitem GROUP BY 1""",
    "entity_rollup_with_zero": """SELECT p_partkey, p_brand, count(DISTINCT l_orderkey) AS item_count, max(l_shipdate::date) AS latest FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY 1, 2""",
    "country_issue_counts": """SELECT n_name, count(DISTINCT o_orderkey) AS issues, count(DISTINCT o_custkey) AS sources FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
    "system_status": """SELECT round(epoch(TIMESTAMP '2024-02-01' - max(date_trunc('second', ts))) / 3600, 6) AS age_hours, epoch(TIMESTAMP '2024-02-01' - max(date_trunc('second', ts))) / 3600 > 10 AS stale FROM events""",
    "max_calls_in_60s": """SELECT event_type, count(*) AS calls, max(n) AS peak FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1""",
    "topic_week_shares": """WITH a AS (SELECT strftime(ts, '%G-W%V') AS week, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2) SELECT *, sum(n) OVER (PARTITION BY week)::bigint AS total, round(n / sum(n) OVER (PARTITION BY week), 6) AS share FROM a""",
    "role_turn_rollup": """SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, sum(length(text))::bigint AS chars, arg_min(role, (turn, role)) AS first_role, arg_max(role, (turn, role)) AS last_role FROM conversations GROUP BY 1""",
    "field_fill": """WITH e AS (SELECT *, json_extract_string(props, '$.k')::double AS k FROM events) SELECT event_type, count(*) AS n, round(avg((k IS NOT NULL)::int), 6) AS k_fill, round(avg(CASE WHEN value > 10 THEN (k > 50)::int END), 6) AS k_high_of_valued FROM e GROUP BY 1""",
    "unique_issue_estimate": """SELECT lang, count(*) AS n, count(DISTINCT regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '', 'g')) AS unique_titles FROM documents GROUP BY 1""",
    "recall_by_stage": """SELECT quality, count(*) AS required, round(avg((lang IS NOT NULL)::int), 6) AS collected, round(avg(coalesce((n_chars > 500)::int, 0)), 6) AS exposed FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1""",
    "story_construction": """SELECT l_orderkey, min(l_shipdate::date) AS day, count(DISTINCT l_suppkey) AS outlets, array_to_string(list_sort(list(DISTINCT l_returnflag)), '') AS flags, bool_or(l_discount > 0.09) AS any_deep, bool_and(l_tax > 0) AS all_taxed, arg_max(l_partkey, (l_quantity, l_extendedprice, -l_linenumber)) AS rep_part FROM lineitem GROUP BY 1""",
    "briefing_rollup": """WITH p AS (SELECT event_type, ts::date AS day, count(*) AS current FROM events GROUP BY 1, 2) SELECT *, coalesce(sum(current) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS history FROM p""",
    "open_questions_first": """SELECT conv_id, turn, question FROM (SELECT conv_id, turn, text AS question, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS r FROM conversations WHERE contains(text, '?') OR role = 'user') WHERE r = 1""",
    "weekly_counters": """SELECT strftime(ts, '%G-W%V') AS week, event_type, count(*) AS n, grouping(event_type)::int AS is_total FROM events GROUP BY GROUPING SETS ((1, event_type), (1))""",
}


def _fanout_sql(rows: str, item: str, source: str) -> str:
    return f"""WITH e AS ({rows}), t AS (SELECT min(day) AS first, max(day) AS last FROM e),
        p AS (SELECT days, greatest(first, (last - (days - 1))::date) AS f, last, (last - (2 * days - 1))::date AS pf, (last - days)::date AS pt, (last - (2 * days - 1))::date >= first AS covered FROM t, (VALUES (7), (30), (90), (180), (365)) v(days))
        SELECT days, f AS "from", last AS "to", (SELECT count(*) FROM e WHERE day BETWEEN f AND last) AS n, (SELECT count(DISTINCT {item}) FROM e WHERE day BETWEEN f AND last) AS items, (SELECT count(DISTINCT {source}) FROM e WHERE day BETWEEN f AND last) AS sources,
          CASE WHEN covered THEN (SELECT count(*) FROM e WHERE day BETWEEN pf AND pt) END AS prev_n, CASE WHEN covered THEN (SELECT count(DISTINCT {item}) FROM e WHERE day BETWEEN pf AND pt) END AS prev_items,
          CASE WHEN covered THEN (SELECT count(*) FROM e WHERE day BETWEEN f AND last) - (SELECT count(*) FROM e WHERE day BETWEEN pf AND pt) END AS delta FROM p"""


SQL["period_fanout_prev_null"] = _fanout_sql("SELECT user_id, event_type, ts::date AS day FROM events", "user_id", "event_type")
SQL["period_fanout_orders"] = _fanout_sql("SELECT o_custkey, o_orderpriority, o_orderdate::date AS day FROM orders", "o_custkey", "o_orderpriority")

QUERIES = {k: globals()[k] for k in SQL}
