"""Queries over the harness's tables: joins, set operations, de-duplication, similarity, ranking, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions import text as X
from tidewire.operators import cluster as C
from tidewire.operators import dedup as D
from tidewire.operators import joins as J
from tidewire.operators import ranking as R
from tidewire.operators import search as S
from tidewire.session import table

#: Fixed values of the lookup queries' inline dimension: domain, tier.
DOMAINS = (("example.com", 1), ("example.net", 2), ("m.example.com", 3), ("org", 2), ("spam-farm.example.org", 3))


def _values(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def seen_anti_join(spark, d):
    """Customers without an order, by two keys: the key, and the name."""
    seen = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.format_string("Customer#%09d", "o_custkey").alias("c_name"))
    return J.unseen(table(spark, d, "customer").select("c_custkey", "c_name"), seen, ["c_custkey", "c_name"])


def delivered_semi_join(spark, d):
    log = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.delivered(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), log, "c_custkey")


def backfill_blanks(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("prio"))
    patch = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("prio"))
    return J.fill_blanks(rows, patch, "o_orderkey", ["prio"])


def domain_tier_lookup(spark, d):
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1))
    pages = table(spark, d, "pages").select("page_id", host.alias("host"))
    return J.longest_suffix(pages, "host", _values(spark, DOMAINS, "domain string, tier int"), "domain", ["tier"], "page_id")


def window_join_21_days(spark, d):
    """Pairs of a customer's orders at most 21 days apart, one-sided."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    pairs = J.within_days(o, o.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("day").alias("other_day")), ["o_custkey"], "day", "other_day", 21, one_sided=True)
    return pairs.where("o_orderkey <> other").groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.sum(F.datediff("day", "other_day")).alias("gap_days"))


def asof_previous_state(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").alias("at"), "event_type", "event_id")
    out = J.previous_state(e, "user_id", "at", "event_type", "event_id")
    return out.select("user_id", F.col("now_at").cast("string").alias("now_at"), "now_value", F.col("prev_at").cast("string").alias("prev_at"), "prev_value")


def _tokens(c: str, n: int = 5) -> F.Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z]+"), lambda t: F.length(t) >= n))


def idf_weighted_matches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(_tokens("text", 6)).alias("token"))
    bench = table(spark, d, "benchmark").select("item_id", F.explode(_tokens("text", 6)).alias("token"))
    return J.idf_matches(docs, bench, "doc_id", "item_id", "token")


def exact_dedup_two_phase(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("url"), F.lower(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), "n_chars")
    return D.exact_two_phase(docs, "url", "title", "n_chars", "doc_id").select("doc_id", "url", "n_chars")


def fold_ledger(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("url"), "doc_id", F.substring("text", 1, 20).alias("title"))
    out = D.fold_ledger(docs, "url", "doc_id", "title", "doc_id", cap=3)
    return out.select("url", "kept", "folded_count", F.array_join("folded", "|").alias("folded"))


def cosine_pairs_threshold(spark, d):
    """All pairs of vectors with a cosine of at least 0.15."""
    p = D.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.15 - 1e-6)
    return p.select(F.col("left").alias("vec_id"), F.col("right").alias("other"), F.round("cosine", 6).alias("cosine")).where("cosine >= 0.15")


def greedy_embedding_dedup(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return D.greedy_vectors(v, ["label"], "vec_id", "embedding", "vec_id")


def greedy_title_dedup(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "n_chars")
    return D.greedy_titles(docs, ["source", "lang"], "doc_id", "title", "n_chars")


def or_key_dedup_fold(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.md5("text").alias("url"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return D.or_keys(docs, ["source"], "doc_id", ["url", "title"], ["doc_id"])


def story_window_groups(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("day"), "event_type")
    return D.story_groups(e, "user_id", "event_id", "day", lambda a, b: a["event_type"] == b["event_type"])


def pair_features(spark, d):
    """Token Jaccard of neighbouring documents."""
    docs = table(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("tokens"))
    p = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("tokens").alias("next")), "doc_id")
    return p.select("doc_id", F.round(D.jaccard(F.col("tokens"), F.col("next")), 6).alias("jaccard"), F.size(F.array_intersect("tokens", "next")).alias("shared"))


def candidate_pairs_scored(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.array(F.col("o_custkey").cast("string")).alias("blocks"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.split(F.concat_ws(" ", "o_orderstatus", F.year("o_orderdate")), " ").alias("tokens"))
    return C.score_pairs(C.candidate_pairs(o, "o_orderkey", "day", "blocks"), o, "o_orderkey", "tokens", "tags").withColumn("token_ratio", F.round("token_ratio", 6))


def issue_clusters(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.array(F.col("o_custkey").cast("string")).alias("blocks"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.split(F.concat_ws(" ", "o_orderstatus", F.year("o_orderdate")), " ").alias("tokens"), F.pmod("o_custkey", F.lit(64)).alias("shard"))
    pairs = C.score_pairs(C.candidate_pairs(o, "o_orderkey", "day", "blocks"), o, "o_orderkey", "tokens", "tags")
    return C.cluster(o, pairs, "o_orderkey", "day")


def rejected_wins_except(spark, d):
    e = table(spark, d, "events")
    pair = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("left"), F.pmod("event_id", F.lit(150)).alias("right"))
    return C.merge_judgments(pair("purchase"), pair("error"))


def review_band(spark, d):
    v = cosine_pairs_threshold(spark, d)
    return C.review_band(v.withColumnsRenamed({"vec_id": "left", "other": "right"}), "cosine", 0.2, 0.3, 15)


def queue_prune(spark, d):
    """Orders without selected, duplicate and junk keys: a union of sets, then an anti join."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    prune = o.where("o_totalprice > 300000").select("o_orderkey").union(o.where("o_orderstatus = 'P'").select("o_orderkey")).union(o.where("o_orderpriority like '5%'").select("o_orderkey"))
    return o.join(prune.distinct(), "o_orderkey", "left_anti")


def _queue(spark, d) -> DataFrame:
    """Line items as queue items with features."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    grade = F.when(F.col("o_orderpriority").startswith("1"), "must_read").when(F.col("o_orderpriority").startswith("5"), "noise").otherwise("nice_to_know")
    event = F.when(F.col("l_returnflag") == "R", "contract_award").when(F.col("l_returnflag") == "A", "opinion").otherwise("market_signal")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate", grade.alias("grade"), event.alias("event"), F.pmod("l_suppkey", F.lit(4)).cast("int").alias("tier"), (F.col("l_discount") > 0.05).alias("related"), F.pmod("l_partkey", F.lit(5)).cast("int").alias("prior"), "l_quantity", "l_tax", F.pmod("l_orderkey", F.lit(200)).cast("double").alias("age"))


def _scored(spark, d) -> DataFrame:
    q = _queue(spark, d)
    features = {"korea_relevance": F.col("l_quantity") - 20, "market_materiality": F.col("l_linenumber"), "policy_materiality": F.col("l_tax") * 50}
    parts = R.breakdown(F.col("grade"), F.col("event"), features, F.col("tier"), F.col("related"), F.col("prior"), F.col("age"))
    return q.withColumn("parts", parts).withColumn("score", R.total(F.col("parts")))


def explainable_score(spark, d):
    s = _scored(spark, d)
    return s.select("l_orderkey", "l_linenumber", "score", F.size("parts").alias("n_parts"), F.round(F.coalesce(F.try_element_at("parts", F.lit("time_decay")), F.lit(0.0)), 3).alias("decay"))


def selection_floor(spark, d):
    s = _scored(spark, d)
    v = R.floor_verdict(F.col("score"), F.col("grade"), F.col("l_linenumber") < 6, {"nice_to_know": 14.0, "must_read": 16.0})
    return s.withColumn("v", v).groupBy("grade", "v.reason").agg(F.count("*").alias("n"), F.count_if("v.passes").alias("passed"))


def adaptive_cap(spark, d):
    per_day = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count_if(F.col("o_totalprice") > 350000).alias("eligible"), F.count_if(F.col("o_totalprice") > 440000).alias("must_read"))
    return per_day.withColumn("cap", R.adaptive_cap(F.col("eligible"), F.col("must_read"), 6, 12))


def diverse_topk(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_orderpriority", F.round(F.col("o_totalprice") / 100000, 3).alias("score"), "o_orderdate", "o_orderkey")
    return R.select_diverse(o, ["y"], "o_orderpriority", "score", ["o_orderdate", "o_orderkey"], 8).select("y", "o_orderkey", F.round("adjusted", 6).alias("adjusted"), "rank")


def region_interleave_rank(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return R.interleave(c.withColumn("must", (F.col("c_mktsegment") == "BUILDING").cast("int")), ["c_mktsegment"], "n_regionkey", "must", "c_acctbal", "c_custkey").select("c_custkey", "c_mktsegment", "region_rank", "position")


def query_round_robin(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_size", "p_partkey")
    return R.round_robin(p.withColumn("prio", F.length("p_brand")), "p_brand", "prio", "p_partkey").select("p_brand", "p_partkey", "depth")


def repeat_tags(spark, d):
    return R.follow_up_tags(table(spark, d, "part"), "p_type", 3, 5)


def faceted_search_and(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return S.facets(docs, {"lang": "en", "source": None}, text="text", query="the ing on").select("doc_id", "source", "n_chars")


def scored_quick_search(spark, d):
    p = table(spark, d, "part")
    return S.scored_search(p, "1", [("p_name", 100), ("p_brand", 50), ("p_type", 15)], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "score")


def ladder_quick_search(spark, d):
    p = table(spark, d, "part")
    return S.ladder_search(p, "2", [("p_brand", 60), ("p_name", 40), ("p_type", 20)], [F.asc("p_partkey")], n=25).select("p_partkey", "score")


def related_items(spark, d):
    li = table(spark, d, "lineitem")
    quantity = F.rint("l_quantity").cast("int")
    fits = F.col("l_suppkey").between(-(2**31), 2**31 - 1)
    offer = F.when(fits, F.shiftleft("l_suppkey", 32).bitwiseOR(quantity.cast("long").bitwiseAND(F.lit(2**32 - 1)))).otherwise(F.xxhash64("l_suppkey", quantity))
    offer = F.when(F.col("l_suppkey").isNotNull() & quantity.isNotNull(), offer)
    return S.related(li.select("l_orderkey", F.col("l_partkey").alias("parts"), offer.alias("offers")), "l_orderkey", [("parts", 2), ("offers", 1)])


def topic_facets(spark, d):
    return S.facet_counts(table(spark, d, "part"), "p_type")


def keyword_rows(spark, d):
    e = table(spark, d, "events").withColumn("tag", F.concat_ws("-", "event_type", F.pmod("user_id", F.lit(40)).cast("string")))
    n = lambda c: e.where(c).groupBy("tag").agg(F.count("*").alias("n"))
    return S.keyword_rows(n(F.col("value") > 50), n(F.col("value") < 2), "tag", "n")


def topic_share_trend(spark, d):
    c = table(spark, d, "events").groupBy("event_type", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"))
    return S.share_trend(c, "event_type", "week", "n")


def continent_rollup(spark, d):
    counts = table(spark, d, "customer").where("c_nationkey % 5 <> 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    dim = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return S.rollup_to_parent(counts, "n_nationkey", "n", dim, "r_regionkey", table(spark, d, "region").select("r_regionkey"))


def briefing_weeks(spark, d):
    e = table(spark, d, "events").withColumn("week", S.briefing_week(F.to_date("ts")).cast("string"))
    return e.groupBy("week").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def tfidf_top_terms(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.explode(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda x: F.length(x) >= 3)).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("tf"))
    n = table(spark, d, "benchmark").agg(F.count("*").alias("docs"))
    idf = t.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("w", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    s = t.join(idf, "w").withColumn("tfidf", F.round(F.col("tf") * F.col("idf"), 6))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("tfidf"), "w"))).where("rank <= 5").select("item_id", "w", "tfidf", "rank")


def quality_gate_codes(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").dropDuplicates(["doc_id"]), "doc_id", "left")
    codes = F.array_compact(F.array(F.when(F.col("n_chars") < 100, "too_short"), F.when(F.col("quality") == 0, "bad_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality").isNull(), "unlabelled"), F.when(~F.col("text").rlike(r"[.!?]\s*$"), "incomplete_sentence")))
    return docs.select("doc_id", F.array_join(codes, ",").alias("codes"), (F.size(codes) == 0).alias("passes"))


def discovery_yield(spark, d):
    """Zero-yield streak per query at the end of its runs."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("hit"))
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("hit"), F.col("event_id"))).alias("last_hit"))
    a = e.join(last, "user_id").groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if(F.col("event_id") > F.coalesce("last_hit", F.lit(-1))).alias("zero_streak"))
    return a.withColumn("cooling", F.col("zero_streak") >= 3)


def union_by_name_feeds(spark, d):
    """Candidate feeds with differing columns stacked by name."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("search").alias("feed"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("score"), F.lit("rss").alias("feed"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("feed").agg(F.count("*").alias("n"), F.count("score").alias("scored"))


def entity_mentions(spark, d):
    aliases = table(spark, d, "benchmark").select(F.explode(_tokens("text", 6)).alias("alias")).distinct().withColumn("rank", F.length("alias").cast("long")).withColumn("entity_id", F.concat(F.lit("e-"), "alias"))
    m = J.entity_mentions(table(spark, d, "documents"), aliases, "doc_id", "text")
    return m.groupBy("entity_id").agg(F.count("*").alias("docs"))


SQL = {
    "seen_anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND (o_custkey = c_custkey OR printf('Customer#%09d', o_custkey) = c_name))",
    "delivered_semi_join": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "backfill_blanks": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN p ELSE o_orderpriority END AS prio FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "domain_tier_lookup": """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM pages), t(domain, tier) AS (VALUES ('example.com',1),('example.net',2),('m.example.com',3),('org',2),('spam-farm.example.org',3)),
        b AS (SELECT page_id, domain, tier, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS r FROM p JOIN t ON host = domain OR ends_with(host, '.' || domain)) SELECT p.page_id, host, domain, tier FROM p LEFT JOIN b ON b.page_id = p.page_id AND r = 1""",
    "window_join_21_days": """SELECT a.o_custkey, count(*) AS pairs, sum(date_diff('day', b.o_orderdate::date, a.o_orderdate::date))::bigint AS gap_days FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND date_diff('day', b.o_orderdate::date, a.o_orderdate::date) BETWEEN 0 AND 21 GROUP BY 1""",
    "asof_previous_state": """WITH e AS (SELECT user_id, date_trunc('hour', ts)::timestamp AS h, event_type, event_id FROM events), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h DESC, event_id DESC) AS r FROM e) WHERE r = 1),
        p AS (SELECT e.user_id, e.h, e.event_type, row_number() OVER (PARTITION BY e.user_id ORDER BY e.h DESC, e.event_id DESC) AS r FROM e JOIN n ON n.user_id = e.user_id AND e.h < n.h)
        SELECT n.user_id, n.h::varchar AS now_at, n.event_type AS now_value, p.h::varchar AS prev_at, p.event_type AS prev_value FROM n LEFT JOIN p ON p.user_id = n.user_id AND p.r = 1""",
    "idf_weighted_matches": """WITH a AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents) WHERE length(token) >= 6), b AS (SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM benchmark) WHERE length(token) >= 6),
        n AS (SELECT count(DISTINCT item_id) AS docs FROM b), i AS (SELECT token, ln((1 + any_value(docs)) / (1 + count(*))) AS idf FROM b, n GROUP BY token), s AS (SELECT item_id, count(*) AS size FROM b GROUP BY 1),
        p AS (SELECT doc_id, item_id, count(*) AS shared, sum(idf) AS x FROM a JOIN b USING (token) JOIN i USING (token) GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT * FROM (SELECT doc_id, item_id, shared, round(x / sqrt(size), 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(x / sqrt(size), 6) DESC, item_id) AS rank FROM p JOIN s USING (item_id)) WHERE rank <= 2""",
    "exact_dedup_two_phase": """WITH x AS (SELECT doc_id, md5(text) AS url, lower(string_split(text, chr(10))[1]) AS title, n_chars FROM documents), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n_chars DESC, doc_id) AS r FROM x) WHERE r = 1)
        SELECT doc_id, url, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY n_chars DESC, doc_id) AS q FROM a) WHERE q = 1""",
    "fold_ledger": """SELECT md5(text) AS url, min(doc_id) AS kept, count(*) - 1 AS folded_count, array_to_string(list(left(text, 20) ORDER BY doc_id)[2:4], '|') AS folded FROM documents GROUP BY 1""",
    "cosine_pairs_threshold": """SELECT * FROM (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE cosine >= 0.15""",
    "pair_features": """WITH w AS (SELECT DISTINCT doc_id, left(w, 8) AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}]+')) AS w FROM documents) WHERE length(w) >= 2),
        n AS (SELECT d.doc_id, count(w.w) AS n FROM documents d LEFT JOIN w USING (doc_id) GROUP BY 1), s AS (SELECT a.doc_id, count(*) AS k FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 AND a.w = b.w GROUP BY 1)
        SELECT a.doc_id, round(CASE WHEN a.n + b.n > 0 THEN coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)) ELSE 0 END, 6) AS jaccard, coalesce(k, 0)::int AS shared FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 LEFT JOIN s ON s.doc_id = a.doc_id""",
    "candidate_pairs_scored": """WITH o AS (SELECT *, o_orderdate::date AS day FROM orders), p AS (SELECT a.o_orderkey AS left, b.o_orderkey AS right, a.o_orderstatus = b.o_orderstatus AS s, a.o_orderpriority = b.o_orderpriority AS q, year(a.day) = year(b.day) AS y FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND (a.day, a.o_orderkey) < (b.day, b.o_orderkey) AND b.day - a.day <= 21),
        f AS (SELECT "left", "right", (s::int + y::int) / (4 - s::int - y::int)::double AS t, q::int + s::int AS g FROM p)
        SELECT "left", "right", round(t, 6) AS token_ratio, g AS tag_shared, round(0.55 * t + 0.25 * t + 0.2 * g / (4 - g), 6) AS score, t >= 0.78 OR (g >= 2 AND (t >= 0.32 OR t >= 0.2)) OR (g >= 1 AND t >= 0.55) AS matched FROM f""",
    "rejected_wins_except": """WITH p AS (SELECT DISTINCT event_type, least(user_id, event_id % 150) AS l, greatest(user_id, event_id % 150) AS r FROM events) SELECT l AS "left", r AS "right" FROM p WHERE event_type = 'purchase' EXCEPT SELECT l, r FROM p WHERE event_type = 'error'""",
    "queue_prune": "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE NOT (o_totalprice > 300000 OR o_orderstatus = 'P' OR starts_with(o_orderpriority, '5'))",
    "adaptive_cap": """SELECT *, greatest(0, least(6 + least(2, must_read) + least(3, greatest(0, floor((eligible - 6) / 5))), eligible, 12))::int AS cap FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) FILTER (o_totalprice > 350000) AS eligible, count(*) FILTER (o_totalprice > 440000) AS must_read FROM orders GROUP BY 1, 2)""",
    "diverse_topk": """WITH o AS (SELECT year(o_orderdate) AS y, o_orderpriority AS t, round(o_totalprice / 100000, 3) AS score, o_orderdate AS d, o_orderkey FROM orders), a AS (SELECT *, score - CASE WHEN row_number() OVER (PARTITION BY y, t ORDER BY score DESC, d DESC, o_orderkey DESC) > 2 THEN 2.5 ELSE 0 END AS adj FROM o)
        SELECT y, o_orderkey, round(adj, 6) AS adjusted, rank FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY adj DESC, score DESC, d DESC, o_orderkey DESC) AS rank FROM a) WHERE rank <= 8""",
    "region_interleave_rank": """WITH c AS (SELECT c_custkey, c_mktsegment, n_regionkey, (c_mktsegment = 'BUILDING')::int AS must, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, n_regionkey ORDER BY must DESC, c_acctbal DESC, c_custkey) AS region_rank FROM c)
        SELECT c_custkey, c_mktsegment, region_rank, row_number() OVER (PARTITION BY c_mktsegment ORDER BY region_rank, must DESC, c_acctbal DESC, c_custkey) AS position FROM r""",
    "query_round_robin": """SELECT p_brand, p_partkey, depth FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS depth FROM part) WHERE depth <= 4 ORDER BY depth, length(p_brand), p_brand LIMIT 30""",
    "repeat_tags": "SELECT p_type, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, p_type LIMIT 5",
    "faceted_search_and": """WITH f AS (SELECT *, regexp_replace(lower(text), '[\\s\\-./]+', '', 'g') AS t FROM documents) SELECT doc_id, source, n_chars FROM f WHERE lang = 'en' AND contains(t, 'the') AND contains(t, 'ing') AND contains(t, 'on')""",
    "scored_quick_search": """WITH f AS (SELECT *, regexp_replace(lower(p_name), '[\\s\\-./]+', '', 'g') AS a, regexp_replace(lower(p_brand), '[\\s\\-./]+', '', 'g') AS b, regexp_replace(lower(p_type), '[\\s\\-./]+', '', 'g') AS c FROM part), s AS (SELECT *, 100 * contains(a, '1')::int + 50 * contains(b, '1')::int + 15 * contains(c, '1')::int AS score FROM f)
        SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_retailprice DESC, p_partkey LIMIT 10""",
    "ladder_quick_search": """WITH f AS (SELECT *, regexp_replace(lower(p_name), '[\\s\\-./]+', '', 'g') AS a, regexp_replace(lower(p_brand), '[\\s\\-./]+', '', 'g') AS b, regexp_replace(lower(p_type), '[\\s\\-./]+', '', 'g') AS c FROM part), s AS (SELECT *, CASE WHEN contains(b, '2') THEN 60 WHEN contains(a, '2') THEN 40 WHEN contains(c, '2') THEN 20 ELSE 0 END AS score FROM f)
        SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 25""",
    "related_items": """WITH a AS (SELECT DISTINCT l_orderkey, l_partkey AS v FROM lineitem), b AS (SELECT DISTINCT l_orderkey, l_suppkey || '/' || l_quantity::int AS v FROM lineitem), s AS (SELECT x.l_orderkey, y.l_orderkey AS other, 2 * count(*) AS s FROM a x JOIN a y ON x.v = y.v AND x.l_orderkey <> y.l_orderkey GROUP BY 1, 2 UNION ALL SELECT x.l_orderkey, y.l_orderkey, count(*) FROM b x JOIN b y ON x.v = y.v AND x.l_orderkey <> y.l_orderkey GROUP BY 1, 2),
        t AS (SELECT l_orderkey, other, sum(s)::bigint AS score FROM s GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, other) AS rank FROM t) WHERE rank <= 3""",
    "topic_facets": "SELECT p_type, count(*) AS n FROM part GROUP BY 1",
    "keyword_rows": """WITH e AS (SELECT event_type || '-' || (user_id % 40) AS tag, value FROM events) SELECT tag, count(*) FILTER (value > 50) AS now, count(*) FILTER (value < 2) AS before FROM e GROUP BY 1 HAVING count(*) FILTER (value > 50) + count(*) FILTER (value < 2) > 0""",
    "topic_share_trend": """WITH c AS (SELECT event_type, date_trunc('week', ts) AS w, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY w), 6) AS share FROM c), a AS (SELECT event_type, arg_min(share, w) AS first_share, arg_max(share, w) AS last_share, sum(n)::bigint AS n FROM s GROUP BY 1)
        SELECT *, round(last_share - first_share, 6) AS change, CASE WHEN abs(round(last_share - first_share, 6)) >= 8 AND n >= 8 THEN CASE WHEN last_share > first_share THEN 'up' ELSE 'down' END ELSE 'flat' END AS direction FROM a""",
    "continent_rollup": """WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 5 <> 0 GROUP BY 1), t AS (SELECT r_regionkey, coalesce(n, 0) AS n FROM region LEFT JOIN a ON k = r_regionkey) SELECT *, round(n / sum(n) OVER (), 6) AS share FROM t""",
    "briefing_weeks": """SELECT (ts::date - ((dayofweek(ts) + 1) % 7)::int)::varchar AS week, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""",
    "tfidf_top_terms": """WITH t AS (SELECT item_id, w, count(*) AS tf FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 3 GROUP BY 1, 2), n AS (SELECT count(*) AS docs FROM benchmark), i AS (SELECT w, ln((1 + any_value(docs)) / (1 + count(*))) + 1 AS idf FROM t, n GROUP BY w)
        SELECT * FROM (SELECT item_id, w, round(tf * idf, 6) AS tfidf, row_number() OVER (PARTITION BY item_id ORDER BY round(tf * idf, 6) DESC, w) AS rank FROM t JOIN i USING (w)) WHERE rank <= 5""",
    "quality_gate_codes": """WITH x AS (SELECT d.doc_id, concat_ws(',', CASE WHEN n_chars < 100 THEN 'too_short' END, CASE WHEN quality = 0 THEN 'bad_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN NOT regexp_matches(text, '[.!?]\\s*$') THEN 'incomplete_sentence' END) AS codes FROM documents d LEFT JOIN labels USING (doc_id)) SELECT doc_id, codes, codes = '' AS passes FROM x""",
    "discovery_yield": """WITH l AS (SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'purchase'), -1) AS h FROM events GROUP BY 1) SELECT user_id, count(*) AS runs, count(*) FILTER (event_id > h) AS zero_streak, count(*) FILTER (event_id > h) >= 3 AS cooling FROM events JOIN l USING (user_id) GROUP BY 1""",
    "union_by_name_feeds": "SELECT 'search' AS feed, count(*) AS n, 0::bigint AS scored FROM customer UNION ALL SELECT 'rss', count(*), count(s_acctbal) FROM supplier",
    "entity_mentions": """WITH a AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS alias FROM benchmark), t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\pL\\pM\\pN_]+')) AS token FROM documents) SELECT 'e-' || alias AS entity_id, count(DISTINCT doc_id) AS docs FROM a JOIN t ON alias = token WHERE length(alias) >= 6 GROUP BY 1""",
}

_SCORE = """WITH q AS (SELECT l_orderkey, l_linenumber, CASE WHEN starts_with(o_orderpriority, '1') THEN 'must_read' WHEN starts_with(o_orderpriority, '5') THEN 'noise' ELSE 'nice_to_know' END AS grade,
      CASE l_returnflag WHEN 'R' THEN 6.0 WHEN 'A' THEN 0.0 ELSE 2.0 END AS event, CASE l_suppkey % 4 WHEN 1 THEN 3.0 WHEN 2 THEN 1.5 ELSE 0 END AS tier, (l_discount > 0.05)::int AS related, CASE WHEN l_partkey % 5 = 0 THEN 0 WHEN l_partkey % 5 <= 2 THEN 1.5 ELSE 0.5 END AS track,
      least(3, greatest(0, trunc(l_quantity - 20))) AS f1, least(3, greatest(0, l_linenumber)) AS f2, least(3, greatest(0, trunc(l_tax * 50))) AS f3, least(3.0, 0.5 * (l_orderkey % 200) / 12) AS decay FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    s AS (SELECT *, round(CASE WHEN grade = 'must_read' THEN 10.0 ELSE 5.0 END + event + f1 * 1.2 + f2 + f3 + tier + related + track - decay, 3) AS score FROM q)"""
SQL["explainable_score"] = _SCORE + " SELECT l_orderkey, l_linenumber, score, 1 + (event <> 0)::int + (f1 <> 0)::int + (f2 <> 0)::int + (f3 <> 0)::int + (tier <> 0)::int + (related <> 0)::int + (track <> 0)::int + (decay <> 0)::int AS n_parts, -round(decay, 3) AS decay FROM s"
SQL["selection_floor"] = _SCORE + """, v AS (SELECT grade, CASE WHEN l_linenumber >= 6 THEN 'exempt_no_features' WHEN grade = 'noise' THEN 'no_limit_for_grade' WHEN score >= CASE grade WHEN 'must_read' THEN 16.0 ELSE 14.0 END THEN 'passed' ELSE 'below_floor' END AS reason FROM s) SELECT grade, reason, count(*) AS n, count(*) FILTER (reason <> 'below_floor') AS passed FROM v GROUP BY 1, 2"""
SQL["review_band"] = f"""SELECT vec_id AS "left", other AS "right", cosine FROM ({SQL["cosine_pairs_threshold"]}) WHERE cosine >= 0.2 AND cosine < 0.3 ORDER BY cosine DESC, 1, 2 LIMIT 15"""

QUERIES = {k: globals()[k] for k in [*SQL, "greedy_embedding_dedup", "greedy_title_dedup", "or_key_dedup_fold", "story_window_groups", "issue_clusters"]}
