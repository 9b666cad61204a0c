"""Queries over the harness's tables: the record's gates and fields, its archive, links, overrides and readers' views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import fields as P
from tidewire.functions import gates as G
from tidewire.functions import normalize as N
from tidewire.functions import urls as U
from tidewire.operators import cluster as C
from tidewire.operators import issues as I
from tidewire.operators import links as L
from tidewire.operators import records as A
from tidewire.operators import selection as SEL
from tidewire.operators import views as V
from tidewire.session import table

#: Fixed values of these queries: a small knowledge base (report, title, patterns, tags, entities, summary) and country rules by needles and tokens.
REPORTS = (
    ("r1", "the ing reports", ["tion on"], ["ent"], ["er"], "nothing here"), ("r2", "über schule", ["sch"], ["ung"], [], "eine lange zusammenfassung"), ("r3", "que ción", ["ción"], [], ["ado"], ""), ("r4", "", [], [], ["zzzz"], ""),
)
COUNTRY_RULES = {"KR": (["ung"], []), "FR": (["ement"], []), "US": ([], ["the", "on"]), "DE": (["sch"], []), "ES": (["ción"], [])}
SOURCES = (("a", "iaea.org", 1), ("b", "nrc.gov", 1), ("c", "example.com", 1), ("d", "example.net", 2), ("e", "", 1))


def _n(c: str, n: int) -> F.Column:
    return F.pmod(F.col(c), F.lit(n))


def _pick(c: F.Column, *values) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))


def _orders(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.withColumn("day", F.to_date("o_orderdate"))


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", F.to_date("ts").alias("day"))


def legacy_scores(spark, d):
    """Scores of orders as records without features."""
    o = _orders(spark, d)
    grade = SEL.grade(F.when(F.col("o_orderpriority").startswith("1"), "must_read"), F.when(F.col("o_orderstatus") == "P", "noise").otherwise("policy"))
    parts = SEL.legacy_parts(grade, F.when(F.col("c_mktsegment") == "BUILDING", "khnp"), _pick(_n("o_custkey", 4), "www.iaea.org", "x.nrc.gov", "a.com", "b.com"), F.col("o_totalprice") > 300000)
    return o.select("o_orderkey", grade.alias("grade"), F.aggregate(F.map_values(parts), F.lit(0.0), lambda a, x: a + x).alias("score"))


def question_gate(spark, d):
    c = table(spark, d, "conversations").withColumn("q", F.when(_n("turn", 5) == 0, "가동 시점은 미정이다").when(_n("turn", 5) == 1, "재가동할 것으로 보인다").when(_n("turn", 5) == 2, "언제인가?").otherwise(F.col("text")))
    reason = G.question_reason(F.col("q"), _pick(_n("conv_id", 4), "title", " Description", "body", None), _pick(_n("conv_id", 3), "must_read", "must_read", "noise"), _pick(_n("turn", 2), "incident_safety", "opinion"))
    return c.select("conv_id", "turn", reason.alias("reason"))


def hollow_drops(spark, d):
    said = _pick(_n("p_size", 6), "긍정적 입장을 시사한다.", "비용이 20% 늘 것으로 예상된다", "지켜볼 필요가 있습니다", "건설을 승인했다.", "", "주목된다")
    p = table(spark, d, "part").withColumn("s", said)
    return p.select("p_partkey", G.without_hollow(F.col("s")).alias("kept"), G.hollow(F.col("s")).alias("hollow"))


def recuration(spark, d):
    li = table(spark, d, "lineitem").withColumn("s", _pick(_n("l_partkey", 4), "정부가 건설을 승인했다.", "잘린 문장", "", "끝났다")).withColumn("i", _pick(_n("l_suppkey", 3), "", "비용이 늘 것이다.", "문장이"))
    errors = N.summary_errors(F.col("s"), F.col("i"), F.lit(""), _pick(_n("l_linenumber", 3), "2024-02-30", "2024-02-29", ""), F.col("l_quantity") > 10)
    return li.select("l_orderkey", "l_linenumber", F.array_join(errors, ",").alias("errors"), G.needs_recuration(errors, (F.col("l_quantity") / 5).cast("int")).alias("again"))


def visible_rows(spark, d):
    e = _events(spark, d).crossJoin(F.broadcast(_events(spark, d).agg(F.max("day").alias("today"))))
    grade = F.when(F.col("event_type") == "error", "noise").when(F.col("event_type") == "click", "market").otherwise("nice_to_know")
    day = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("date")).otherwise(F.col("day"))
    return e.where(G.visible(grade, day, F.col("today"), 10)).groupBy("event_type").agg(F.count("*").alias("n"))


def scheduled_topics(spark, d):
    o = _orders(spark, d)
    plan = F.when(F.col("o_orderstatus") == "F", "biweekly_odd").when(F.col("o_orderstatus") == "P", "biweekly_even")
    return o.where(G.scheduled(plan, F.col("day"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def report_gate(spark, d):
    li = table(spark, d, "lineitem").withColumn("grade", F.when(F.col("l_returnflag") == "R", "must_read").otherwise("nice_to_know")).withColumn("event", F.when(F.col("l_linestatus") == "O", "contract_award").otherwise("opinion"))
    take = G.report_candidate(F.col("l_linenumber") < 6, F.col("grade"), _n("l_partkey", 4), (F.col("l_tax") * 50).cast("int"), F.col("event"))
    return li.where(take).groupBy("grade", "event").agg(F.count("*").alias("n"))


def source_tests(spark, d):
    c = table(spark, d, "customer").withColumns({"role": _pick(_n("c_nationkey", 4), "primary", "independent", "distributed_claim", None), "kind": F.when(F.col("c_mktsegment") == "MACHINERY", "official"), "tier": _n("c_custkey", 4)})
    identity = P.source_identity(F.when(_n("c_custkey", 3) == 0, F.concat_ws(" ", F.lit("The"), F.col("c_mktsegment"))), _pick(_n("c_custkey", 5), "News.Example.com", "news.google.com", "", "a.kr", None), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", G.primary_source(F.col("role"), F.col("tier")).alias("first_hand"), G.official_source(F.col("role"), F.col("kind")).alias("official"), G.independent_source(F.col("role")).alias("independent"), identity.alias("identity"))


def backfill_need(spark, d):
    p = table(spark, d, "pages").withColumns({"u": F.when(_n("page_id", 4) == 0, "https://news.google.com/rss/x").otherwise(F.col("url")), "publisher": F.when(_n("page_id", 3) == 0, U.host_plain(F.col("url"))).otherwise("Daily News"), "site": F.when(_n("page_id", 5) == 0, "Site"), "resolved": F.when(_n("page_id", 2) == 0, "x")})
    need = G.needs_backfill(_n("page_id", 7) == 0, F.when(_n("page_id", 11) == 0, "noise"), _n("page_id", 13) == 0, F.col("site"), F.col("resolved"), F.col("publisher"), F.col("u"))
    return p.select("page_id", need.alias("need"))


def link_replacement(spark, d):
    """Whether the next customer's link may stand in for an aggregator's."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("[Update] Deal in "), "c_mktsegment").alias("title"), F.concat(F.lit("Press-"), _n("c_nationkey", 2).cast("string")).alias("publisher"), _pick(_n("c_custkey", 2), "https://news.google.com/a", "https://www.example.com/b").alias("link"), _pick(_n("c_custkey", 3), "example.com", "", "other.com").alias("domain"))
    later = c.select((F.col("c_custkey") - 1).alias("c_custkey"), *(F.col(x).alias(f"n_{x}") for x in ("title", "publisher", "link", "domain")))
    j = c.join(later, "c_custkey")
    side = lambda p: {x: F.col(f"{p}{x}") for x in ("title", "publisher", "link", "domain")}
    return j.select("c_custkey", G.may_replace(side(""), side("n_")).alias("may"))


def display_fields(spark, d):
    c = table(spark, d, "customer").withColumns({"p": _pick(_n("c_custkey", 3), "example.com", "", "The Daily"), "site": _pick(_n("c_custkey", 2), "Site Name", " "), "resolved": F.when(_n("c_custkey", 4) == 0, " https://x.kr/1 "), "host": _pick(_n("c_custkey", 5), "www.khnp.co.kr", "yna.net", "example.com", "", None), "t": F.when(_n("c_custkey", 7) == 0, "원전 소식").otherwise("News")})
    return c.select("c_custkey", P.display_publisher(F.col("p"), F.col("site")).alias("publisher"), P.display_url(F.col("resolved"), F.lit("https://y")).alias("url"), P.default_section(F.col("host"), F.col("t")).alias("section"))


def countries_inferred(spark, d):
    docs = table(spark, d, "documents").withColumn("t", F.lower("text"))
    of_text = P.countries_of_text(F.col("t"), COUNTRY_RULES, ["FR", "DE", "ES"], ["ission"], ["europ"], ["welt"])
    native = F.when(_n("doc_id", 5) == 0, F.array(F.lit(" us "), F.lit("UK"))).when(_n("doc_id", 5) == 1, F.array(F.lit("EU"), F.lit("FR"))).when(_n("doc_id", 5) == 2, F.array(F.lit("OTHER")))
    repair = F.when(_n("doc_id", 50) == 0, F.array(F.lit("JP")))
    got = P.countries(repair, native, of_text, F.when(F.col("lang") == "en", "domestic").otherwise("overseas"), F.contains("t", F.lit("ission")), {"UK": "GB"})
    return docs.withColumn("g", got).select("doc_id", F.array_join("g.values", ",").alias("countries"), "g.source")


def reason_badges(spark, d):
    li = table(spark, d, "lineitem")
    event = F.when(F.col("l_returnflag") == "R", "event:contract_award").when(F.col("l_returnflag") == "A", "event:opinion").otherwise("event:market_signal")
    parts = F.map_from_arrays(F.array(event, F.lit("korea_relevance"), F.lit("policy_materiality"), F.lit("source_tier1")), F.array((_n("l_partkey", 3) * 2.0), _n("l_suppkey", 4) * 1.2, F.col("l_linenumber").cast("double"), F.lit(1.0)))
    got = P.selection_reasons(F.col("l_quantity") > 5, parts, F.lit(1.0), F.when(F.col("l_quantity") > 45, "primary"), F.when(F.col("l_quantity") < 15, "specialist_media"))
    return li.select("l_orderkey", "l_linenumber", F.array_join(got, "|").alias("reasons"))


def unit_conflicts(spark, d):
    """Units named by the titles of neighbouring parts, and whether they contradict each other."""
    title = F.concat(_pick(_n("p_partkey", 3), "고리", "신고리", "한빛"), F.lit(" "), (_n("p_size", 3) + 1).cast("string"), F.lit("·"), (_n("p_size", 4) + 2).cast("string"), F.lit("호기 소식"))
    p = table(spark, d, "part").select("p_partkey", F.when(_n("p_partkey", 5) == 0, "no unit").otherwise(title).alias("t"))
    j = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u")), "p_partkey")
    a, b = I.title_units(F.col("t")), I.title_units(F.col("u"))
    return j.select("p_partkey", F.array_join(F.array_sort(a), ",").alias("units"), I.units_conflict(a, b).alias("conflict"))


def pair_conflicts(spark, d):
    """Facility and country conflicts of a customer's consecutive orders."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(_pick(_n("o_custkey", 3), "한빛 ", "바라카 ", "deal "), (_n("o_orderkey", 3) + 1).cast("string"), F.lit("호기")).alias("t"), F.when(_n("o_orderkey", 4) == 0, F.array(F.lit("OTHER"))).when(_n("o_orderkey", 4) == 1, F.array(F.lit("KR"), F.lit("US"))).when(_n("o_orderkey", 4) == 2, F.array(F.lit("FR"))).alias("c"))
    j = o.join(o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("t").alias("u"), F.col("c").alias("e")), "o_orderkey")
    return j.select("o_orderkey", I.facilities_conflict(I.named_facilities(F.col("t")), I.named_facilities(F.col("u"))).alias("facility"), I.countries_conflict(F.col("c"), F.col("e")).alias("country"))


def report_matches(spark, d):
    terms = L.report_terms(spark.createDataFrame(list(REPORTS), "report string, title string, patterns array<string>, tags array<string>, entities array<string>, summary string"), "report", "patterns", "tags", "entities", "title", "summary")
    return L.relevant_reports(table(spark, d, "documents"), "doc_id", "text", terms, "report")


def insight_evidence(spark, d):
    o = table(spark, d, "orders")
    insights = o.groupBy(F.col("o_custkey").alias("insight")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("evidence"))
    news = o.where("o_orderstatus <> 'F'").select("o_orderkey", F.when(_n("o_orderkey", 3) == 0, "domestic").when(_n("o_orderkey", 3) == 1, "overseas").alias("region"))
    got = L.insight_evidence(insights, "insight", "evidence", news, "o_orderkey", "region")
    return got.select("insight", F.size("evidence").alias("evidence"), F.array_join("regions", ",").alias("regions"), "domestic", "overseas", "scope")


def keyword_trend(spark, d):
    e = _events(spark, d).withColumn("tag", F.concat_ws("-", "event_type", _n("user_id", 5).cast("string")))
    today = F.lit(e.agg(F.max("day")).first()[0])
    return L.keyword_trend(e, "tag", "event_id", "day", today).withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


def publication_refs(spark, d):
    li = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pair"), "l_orderkey", F.concat(F.lit("u"), _n("l_partkey", 3).cast("string")).alias("url"), "l_linenumber")
    verdicts = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pair"), (F.col("l_returnflag") != "A").alias("same"))
    return L.publication_refs(verdicts, li, "pair", "l_orderkey", "url", "l_linenumber").withColumn("refs", F.array_join("refs", ","))


def summary_lookup(spark, d):
    return L.latest_record(table(spark, d, "lineitem").select("l_partkey", F.to_date("l_shipdate").cast("string").alias("day"), "l_orderkey", "l_linenumber", "l_returnflag"), "l_partkey", ["day", "l_orderkey", "l_linenumber"])


def briefing_today(spark, d):
    rows = _events(spark, d).select("event_id", F.col("day").cast("string").alias("day"), F.when(F.col("event_type") != "view", F.col("value")).alias("score"), F.when(F.col("event_type") == "error", "selection_stats").alias("record_type"))
    return L.collect_today(rows, "day", "score", "event_id")


def _overrides(spark, d) -> DataFrame:
    e = _events(spark, d).where("event_id % 3 = 0")
    return L.override_table(e.select(F.when(_n("event_id", 5) == 0, F.lit("ab")).otherwise(F.substring(F.upper(F.md5(F.col("user_id").cast("string"))), 1, 12)).alias("hash"), F.when(_n("event_id", 7) == 0, "soon").otherwise(F.col("day").cast("string")).alias("day"), _pick(_n("event_id", 4), "promote", "demote", "hide", "what").alias("action")))


def override_verdicts(spark, d):
    members = _events(spark, d).select("event_type", F.md5(F.col("user_id").cast("string")).alias("hash"), "day")
    return L.override_verdicts(members, "event_type", "hash", "day", _overrides(spark, d))


def unmatched_overrides(spark, d):
    members = _events(spark, d).where("event_id % 2 = 0").select(F.md5(F.col("user_id").cast("string")).alias("hash"), "day")
    return L.unmatched_overrides(members, "hash", "day", _overrides(spark, d))


def insights_applied(spark, d):
    issues = table(spark, d, "part").select("p_partkey", _pick(_n("p_size", 3), "", "긍정적 입장을 시사한다.", "건설을 승인했다.").alias("implication"))
    insights = table(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", F.when(_n("p_partkey", 4) == 0, "").otherwise(F.concat(F.lit("insight "), F.col("p_partkey").cast("string"))).alias("insight"))
    return L.apply_insights(issues, "p_partkey", "implication", insights, "insight")


def coverage_gaps(spark, d):
    sources = spark.createDataFrame(list(SOURCES), "name string, domain string, tier int")
    pages = table(spark, d, "pages").select(U.host_plain(F.col("url")).alias("host"))
    return L.coverage_gaps(sources, "domain", "tier", pages, "host").select("name", "domain")


def story_tag_counts(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.array("l_returnflag", "l_linestatus", F.lit("")).alias("tags"))
    return L.story_tag_counts(rows, "l_orderkey", "tags")


def meta_coverage(spark, d):
    docs = table(spark, d, "documents")
    return L.meta_coverage(docs, F.col("lang").isNotNull(), {"has_source": F.coalesce(F.col("source") != "", F.lit(False)), "is_long": F.coalesce(F.col("n_chars") > 500, F.lit(False))})


def tracking_rate(spark, d):
    return L.tracking_rate(_events(spark, d).select("day", (F.col("value") > 10).alias("tracked")), "day", "tracked")


def days_with_stats(spark, d):
    e = _events(spark, d)
    return L.days_with_stats(e.where("event_type = 'purchase' and user_id % 4 = 0").select("day"), e.select("day"), "day").withColumn("day", F.col("day").cast("string"))


def evidence_hashes(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.md5(F.col("o_orderkey").cast("string")).alias("h"), "o_orderkey", "o_orderstatus")
    texts = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "h"))), lambda x: x["h"]).alias("hashes"))
    return L.evidence_of_hashes(texts, "o_custkey", "hashes", o.where("o_orderstatus = 'O'"), "h").withColumn("kept", F.array_join("kept", ","))


def _issues(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("last_seen"), F.min(F.to_date("l_shipdate")).alias("first_seen"), F.count_if(F.col("l_returnflag") == "R").alias("must_read"), F.max("l_quantity").alias("score"), F.countDistinct("l_suppkey").alias("card_count"), F.count("*").alias("article_count"), F.countDistinct("l_shipdate").alias("briefing_count"), F.array_sort(F.collect_set("l_returnflag")).alias("topics"), F.array_sort(F.collect_set("l_linestatus")).alias("entities"))


def catalog_order(spark, d):
    rows = _issues(spark, d).withColumn("shelf", _n("l_orderkey", 7))
    return V.positions(rows, "catalog", "l_orderkey", ["shelf"], 20).select("l_orderkey", "shelf", "position")


def archive_sorts(spark, d):
    rows = _issues(spark, d).withColumn("shelf", _n("l_orderkey", 7))
    parts = [V.positions(rows, o, "l_orderkey", ["shelf"], 10).select(F.lit(o).alias("sort"), "l_orderkey", "shelf", "position") for o in ("recent", "tracked", "sources")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def member_timeline(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("article_date"), (F.col("l_linenumber") % 3).alias("briefing_date"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string")).alias("hash"))
    return V.positions(rows, "timeline", "hash", ["l_orderkey"]).select("l_orderkey", "hash", "position")


def fifo_cap(spark, d):
    return V.fifo_cap(_events(spark, d).select("event_id", F.col("ts").alias("pub")), "event_id").select("event_id")


def weekly_changed(spark, d):
    rows = _issues(spark, d).withColumn("change", F.when(_n("l_orderkey", 2) == 0, "a → b."))
    return V.weekly_changed(rows, "l_orderkey", "change", "last_seen", "card_count", F.lit(rows.agg(F.max("last_seen")).first()[0])).select("l_orderkey")


def archive_filtered(spark, d):
    rows = _issues(spark, d).withColumns({"regions": F.array(_pick(_n("l_orderkey", 2), "kr", "us")), "verification": _pick(_n("l_orderkey", 3), "official", "partial", "corroborated"), "title": F.concat(F.lit("Order-No."), F.col("l_orderkey").cast("string"))})
    return V.archive_filter(rows, entity="F", region="kr", topic="R", verified=True, query="order no 1", texts=("title",)).select("l_orderkey")


def entity_counts(spark, d):
    seen = table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_linestatus").alias("entity")).agg(F.date_sub(F.max(F.to_date("l_shipdate")), 100).alias("seen"))
    return V.entity_counts(_issues(spark, d), "l_orderkey", "entities", "topics", "last_seen", seen).withColumn("topics", F.array_join("topics", ","))


def span_tracks(spark, d):
    rows = _issues(spark, d)
    ends = rows.agg(F.date_add(F.min("first_seen"), 100).alias("a"), F.date_sub(F.max("last_seen"), 100).alias("b"))
    j = rows.crossJoin(F.broadcast(ends)).withColumn("s", V.span_track(F.col("first_seen"), F.col("last_seen"), F.col("a"), F.col("b")))
    return j.select("l_orderkey", "s.left", "s.width", "s.days")


def resolved_issues(spark, d):
    e = _events(spark, d)
    per = e.groupBy("user_id", "day").agg(F.count("*").alias("n")).where("n % 2 = 1")
    catalog = e.where("user_id % 3 <> 0").groupBy("user_id").agg(F.count("*").alias("n"))
    asked = e.select("user_id", "day").distinct()
    got = V.resolve_issue(asked, "day", "user_id", catalog, per, "n", F.lit(e.agg(F.max("day")).first()[0]))
    return got.withColumn("day", F.col("day").cast("string"))


def publication_shelf(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.when(_n("p_partkey", 9) != 0, F.col("p_type")).alias("url"), "p_brand", (F.col("p_size") > 25).alias("technical"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).alias("day"))
    only = p.agg(F.min("p_brand")).first()[0]
    return V.publication_shelf(p, "p_name", "url", "p_brand", "technical", "day", "p_partkey", only).select("p_partkey", "technical")


def report_candidates(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(_n("p_partkey", 4) == 0, F.col("p_name")).otherwise(" ").alias("pick"), F.when(_n("p_partkey", 8) == 0, F.col("p_type")).alias("a"), F.col("p_brand").alias("b"))
    return V.report_candidates(p, "pick", ["a", "b"], "p_partkey").select("p_partkey", "why")


def settings_overlay(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("f"), _n("s_suppkey", 3).cast("string")).alias("feed"), F.lit("keywords").alias("field"), F.concat(F.lit("v"), _n("s_nationkey", 5).cast("string")).alias("value")).distinct()
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("at"), F.when(_n("c_custkey", 4) == 3, V.COMMON).otherwise(F.concat(F.lit("f"), _n("c_custkey", 4).cast("string"))).alias("group"), F.lit("keywords").alias("field"), F.when(_n("c_nationkey", 2) == 0, "add").otherwise("remove").alias("action"), F.concat(F.lit("v"), _n("c_nationkey", 7).cast("string")).alias("value"), (_n("c_custkey", 10) == 0).alias("disabled"))
    laid, applied = V.overlay(s, c)
    return laid.select("feed", "value").unionAll(applied.select(F.lit("applied"), F.col("id").cast("string")))


def search_variants(spark, d):
    p = table(spark, d, "part").select("p_partkey", _pick(_n("p_size", 4), "고리 1호기", "SMR market", "Steel-Tin", "소형모듈원자로 건설").alias("q"))
    return p.select("p_partkey", F.array_join(P.search_variants(F.col("q"), [("smr", "소형모듈원자로")]), ",").alias("variants"))


def _archive(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("hash"), F.when(_n("o_orderkey", 10) == 0, "").when(_n("o_orderkey", 10) == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("archived_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub"), F.when(_n("o_orderkey", 2) == 0, F.concat(F.lit("Title "), _n("o_orderkey", 50).cast("string"))).alias("title"), F.when(_n("o_orderkey", 3) == 0, F.concat(F.lit("제목 "), F.col("o_orderkey").cast("string"))).alias("title_kr"), F.when(F.col("o_orderpriority").startswith("5"), "noise").when(F.col("o_orderpriority").startswith("4"), "market").otherwise("nice_to_know").alias("importance"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))


def _today(spark, d) -> F.Column:
    return F.lit(table(spark, d, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0])


def recent_titles(spark, d):
    return A.recent_titles(_archive(spark, d), _today(spark, d)).groupBy("title").agg(F.count("*").alias("n"))


def archive_windows(spark, d):
    """How many records each reader of the archive gets."""
    a, today = _archive(spark, d), _today(spark, d)
    end = today.cast("timestamp")
    reads = {"seeds": A.seed_rows(a, today), "trend": A.trend_rows(a, "month", today), "window": A.window_rows(a, end - F.expr("interval 30 days"), end - F.expr("interval 3 hours"))}
    counts = [df.agg(F.lit(k).alias("reader"), F.count("*").alias("n")) for k, df in reads.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


def collector_dedup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("[속보] Deal "), _n("o_custkey", 40).cast("string"), F.when(_n("o_orderkey", 2) == 0, " (update)").otherwise("!")).alias("title"), "o_totalprice")
    return A.collector_dedup(o, "title", "o_totalprice", "o_orderkey").select("o_orderkey")


def migrated_archive(spark, d):
    """Records that the migration keeps; addresses and titles repeat."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("hash"), F.when(_n("o_orderkey", 17) == 0, "").otherwise(F.concat(F.lit("https://h.com/"), F.col("o_custkey").cast("string"), F.lit("/?utm_source=x"))).alias("url"), F.concat(F.lit("T "), F.col("o_orderkey").cast("string")).alias("title"), F.lit("정부가 승인했다.").alias("summary"), F.lit("").alias("implication"), F.lit("").alias("why_important"), F.lit("x").alias("pub"), _n("o_orderkey", 3).cast("int").alias("source_tier"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("archived_at"), F.when(F.col("o_orderpriority").startswith("5"), "noise").otherwise("must_read").alias("importance"))
    repairs = o.where("o_orderkey % 29 = 0").select(F.col("o_orderkey").cast("string").alias("hash"), F.lit(True).alias("drop"), F.lit(None).cast("string").alias("reason"))
    return A.migrate(A.upgrade(rows, repairs)).select("hash", "url")


def curation_normalised(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(
        F.col("c_custkey").alias("hash"), _pick(_n("c_custkey", 3), "MUST_READ ", "urgent", "noise").alias("importance"), _pick(_n("c_custkey", 4), "smr", "x", None, "KHNP").alias("section"), _pick(_n("c_custkey", 3), "KR", "moon", None).alias("scope"), F.array(F.lit(" SMR"), F.lit("zzz"), F.lit("waste"), F.lit("smr"), F.lit("fusion"), F.lit("finance")).alias("topics"), F.array(F.lit("usa"), F.lit("US"), F.lit("kr"), F.lit("fr")).alias("countries"), F.lit("Opinion").alias("article_type"),
        F.when(_n("c_custkey", 2) == 0, "제목").otherwise(" ").alias("title_kr"), F.col("c_name").alias("title"), F.lit(" a  b ").alias("summary"), F.lit("").alias("detail"), F.lit("건설을 승인했다.").alias("implication"), F.lit("중요한 일이다.").alias("why_important"), F.when(_n("c_custkey", 5) == 0, "본문").alias("body"), F.lit("시점은 미정이다").alias("open_question"), F.lit("title").alias("open_question_source"), F.lit("opinion").alias("event_type"),
        F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("e")).alias("tags"), F.lit(None).cast("array<string>").alias("related_reports"), F.lit("2024-02-29").alias("event_date"), F.lit("deadline").alias("event_date_type"), F.lit("day").alias("event_date_precision"), F.lit("title").alias("event_date_source"), F.lit("x.com").alias("domain"),
    )
    got = A.normalise_curation(rows, ("smr", "waste", "fusion", "finance"), ("US", "KR", "FR"), {"USA": "US"})
    return got.select("hash", "importance", "section", "scope", F.array_join("topics", ",").alias("topics"), F.array_join("countries", ",").alias("countries"), "article_type", "title_kr", "summary", "implication", "why_important", "open_question", F.size("tags").alias("tags"), F.size("related_reports").alias("related"), "event_date_type")


def issue_verdicts(spark, d):
    """Orders of a customer as articles: candidate pairs within 21 days judged by the whole ladder of rules."""
    return _issue_pairs(spark, d)[1].select("left", "right", "method", F.round("score", 4).alias("score"), F.array_join("blocked_by", ",").alias("blocked_by"))


def issues_in_two_passes(spark, d):
    """Issues of the same orders, clustered again once every other review candidate is judged the same event and the rest another."""
    rows, scored = _issue_pairs(spark, d)
    return I.two_passes(rows, scored, "o_orderkey", "day", ["day"], "countries", lambda q: q.select("left", "right", ((F.col("left") + F.col("right")) % 2 == 0).alias("same")))


def _issue_pairs(spark, d) -> tuple[DataFrame, DataFrame]:
    o = _orders(spark, d)
    title = F.concat_ws(" ", _pick(_n("o_custkey", 3), "한빛", "바라카", "계약"), (_n("o_orderkey", 3) + 1).cast("string"), F.lit("호기"), F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "재가동 승인").otherwise("수출 계약"))
    rows = o.select("o_orderkey", "day", title.alias("title"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.array(F.year("o_orderdate").cast("string")).alias("topics"), F.when(_n("c_nationkey", 3) == 0, F.array(F.lit("KR"))).when(_n("o_orderkey", 2) == 0, F.array(F.lit("US"))).otherwise(F.array(F.lit("OTHER"))).alias("countries"), F.array(F.col("o_custkey").cast("string")).alias("blocks"))
    pairs = C.candidate_pairs(rows, "o_orderkey", "day", "blocks")
    return rows, I.score_pairs(pairs, rows, "o_orderkey", "title", "tags", "topics", "countries", "")


def selection_outcomes(spark, d):
    """A year's orders as a queue: duplicates folded, floor, cap and a diverse choice."""
    o = _orders(spark, d).where("o_totalprice > 100000")
    rows = o.select(F.date_format("day", "yyyy-MM-dd").alias("run"), "o_orderkey", F.concat_ws(" ", _pick(_n("o_custkey", 2), "고리", "한빛"), (_n("o_orderkey", 4) + 1).cast("string"), F.lit("호기"), F.col("c_mktsegment")).alias("title"), F.array("o_orderstatus").alias("tags"), F.round(F.col("o_totalprice") / 20000, 3).alias("score"), F.when(F.col("o_orderpriority").startswith("1"), "must_read").otherwise("nice_to_know").alias("grade"), (_n("o_orderkey", 5) != 0).alias("has"), F.col("o_orderpriority").alias("topic"), F.date_format("o_orderdate", "HH:mm:ss").alias("queued"))
    got = SEL.rank_and_select(rows, ["run"], "o_orderkey", "title", "tags", "score", "grade", "has", "topic", "queued", {"nice_to_know": 10.0, "must_read": 6.0}, {"base": 3, "max": 8})
    return got.select("run", "o_orderkey", "outcome", "dup_of", "rank")


def prior_coverage(spark, d):
    """How often benchmark titles were told before in the documents' first lines."""
    new = table(spark, d, "benchmark").select("item_id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"))
    return SEL.prior_coverage(new, "item_id", "title", table(spark, d, "documents").select(F.split_part("text", F.lit("."), F.lit(1)).alias("old")), "old")


SQL = {
    "legacy_scores": """WITH o AS (SELECT *, CASE WHEN starts_with(o_orderpriority, '1') THEN 'must_read' WHEN o_orderstatus = 'P' THEN 'noise' ELSE 'nice_to_know' END AS grade FROM orders JOIN customer ON c_custkey = o_custkey)
        SELECT o_orderkey, grade, CASE grade WHEN 'must_read' THEN 10.0::double ELSE 5.0::double END + CASE c_mktsegment WHEN 'BUILDING' THEN 2 ELSE 0 END + CASE WHEN o_custkey % 4 <= 1 THEN 2 ELSE 0 END + CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS score FROM o""",
    "question_gate": """WITH c AS (SELECT *, CASE turn % 5 WHEN 0 THEN '가동 시점은 미정이다' WHEN 1 THEN '재가동할 것으로 보인다' WHEN 2 THEN '언제인가?' ELSE trim(regexp_replace(replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&#39;', chr(39)), '&quot;', '"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '\\s+', ' ', 'g')) END AS q FROM conversations)
        SELECT conv_id, turn, CASE WHEN conv_id % 3 = 2 THEN 'not_must_read' WHEN coalesce(q, '') = '' THEN 'llm_null' WHEN conv_id % 4 >= 2 THEN 'no_source' WHEN length(q) > 60 THEN 'too_long' WHEN ends_with(q, '?') THEN 'is_question' WHEN contains(q, '것으로 보인다') THEN 'forecast' WHEN turn % 2 = 0 AND NOT contains(q, '미정') THEN 'incident_no_uncertainty' ELSE '' END AS reason FROM c""",
    "hollow_drops": f"""WITH p AS (SELECT p_partkey, ['긍정적 입장을 시사한다.', '비용이 20% 늘 것으로 예상된다', '지켜볼 필요가 있습니다', '건설을 승인했다.', '', '주목된다'][p_size % 6 + 1] AS s FROM part), h AS (SELECT *, regexp_matches(s, '{G.HOLLOW}') AND NOT regexp_matches(s, '{G.HOLLOW_QUANTITY}') AS hollow FROM p) SELECT p_partkey, CASE WHEN hollow THEN '' ELSE s END AS kept, hollow FROM h""",
    "recuration": """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, concat_ws(',', CASE l_partkey % 4 WHEN 2 THEN 'summary:missing' WHEN 1 THEN 'summary:incomplete_or_over_100' END, CASE l_suppkey % 3 WHEN 2 THEN 'implication:incomplete_or_over_90' END, CASE l_linenumber % 3 WHEN 0 THEN 'event_date:invalid' END, CASE WHEN l_quantity <= 10 THEN 'features:missing' END) AS errors FROM lineitem)
        SELECT l_orderkey, l_linenumber, errors, errors <> '' AND (errors <> 'features:missing' OR trunc(l_quantity / 5) < 2) AS again FROM x""",
    "visible_rows": """WITH e AS (SELECT *, ts::date AS day FROM events), t AS (SELECT max(day) AS today FROM e) SELECT event_type, count(*) AS n FROM e, t WHERE event_type NOT IN ('error', 'click') AND event_id % 10 <> 0 AND day >= today - 10 GROUP BY 1""",
    "scheduled_topics": """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND weekofyear(o_orderdate::date) % 2 = 1) OR (o_orderstatus = 'P' AND weekofyear(o_orderdate::date) % 2 = 0) GROUP BY 1""",
    "report_gate": """WITH q AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 'must_read' ELSE 'nice_to_know' END AS grade, CASE l_linestatus WHEN 'O' THEN 'contract_award' ELSE 'opinion' END AS event FROM lineitem)
        SELECT grade, event, count(*) AS n FROM q WHERE CASE WHEN l_linenumber < 6 THEN l_partkey % 4 >= 2 AND (grade = 'must_read' OR trunc(l_tax * 50) >= 2 OR event = 'contract_award') ELSE grade = 'must_read' END GROUP BY 1, 2""",
    "source_tests": """WITH c AS (SELECT *, CASE c_nationkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'independent' WHEN 2 THEN 'distributed_claim' END AS role, CASE c_custkey % 5 WHEN 0 THEN 'news.example.com' WHEN 1 THEN 'news.google.com' WHEN 2 THEN '' WHEN 3 THEN 'a.kr' END AS h FROM customer)
        SELECT c_custkey, coalesce(role = 'primary', false) OR c_custkey % 4 = 1 AS first_hand, coalesce(role = 'primary', false) OR c_mktsegment = 'MACHINERY' AS official, coalesce(role = 'independent', false) AS independent,
          CASE WHEN c_custkey % 3 = 0 THEN 'pub:the' || lower(c_mktsegment) WHEN coalesce(h, '') = '' OR h = 'news.google.com' THEN 'hash:' || c_custkey ELSE 'dom:' || h END AS identity FROM c""",
    "backfill_need": """SELECT page_id, page_id % 7 <> 0 AND page_id % 11 <> 0 AND page_id % 13 <> 0 AND NOT (page_id % 5 = 0 AND page_id % 2 = 0) AND (page_id % 4 = 0 OR (page_id % 3 = 0 AND regexp_matches(url, '^[A-Za-z]+://[^/]*[.]'))) AS need FROM pages""",
    "link_replacement": """SELECT a.c_custkey, a.c_custkey % 2 = 0 AND b.c_custkey % 2 = 1 AND a.c_mktsegment = b.c_mktsegment AND a.c_nationkey % 2 = b.c_nationkey % 2 AND a.c_custkey % 3 <> 1 AND CASE a.c_custkey % 3 WHEN 0 THEN 'example.com' ELSE 'other.com' END = CASE b.c_custkey % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.com' ELSE 'other.com' END AS may FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1""",
    "display_fields": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 2 THEN 'Site Name' ELSE ['example.com', '', 'The Daily'][c_custkey % 3 + 1] END AS publisher, CASE WHEN c_custkey % 4 = 0 THEN 'https://x.kr/1' ELSE 'https://y' END AS url, CASE c_custkey % 5 WHEN 0 THEN 'khnp' WHEN 1 THEN 'domestic' ELSE CASE WHEN c_custkey % 7 = 0 THEN 'domestic' ELSE 'international' END END AS section FROM customer""",
    "countries_inferred": """WITH t AS (SELECT doc_id, lang, lower(text) AS t FROM documents), h AS (SELECT *, list_filter([CASE WHEN contains(t, 'ung') THEN 'KR' END, CASE WHEN contains(t, 'ement') THEN 'FR' END, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])(the|on)($|[^a-z0-9])') THEN 'US' END, CASE WHEN contains(t, 'sch') THEN 'DE' END, CASE WHEN contains(t, 'ción') THEN 'ES' END], lambda x: x IS NOT NULL) AS named, contains(t, 'ission') AS eu FROM t),
        s AS (SELECT *, CASE WHEN len(named) > 2 THEN CASE WHEN list_contains(named, 'KR') OR list_contains(named, 'US') THEN ['GLOBAL'] ELSE ['EUROPE'] END ELSE named END || CASE WHEN eu THEN ['EU'] ELSE [] END AS sc FROM h),
        f AS (SELECT *, CASE WHEN len(sc) > 0 THEN sc[1:2] WHEN contains(t, 'europ') THEN ['EUROPE'] WHEN contains(t, 'welt') THEN ['GLOBAL'] ELSE [] END AS oft FROM s),
        u AS (SELECT *, list_filter(['FR'] || oft, lambda x: true) AS e FROM f)
        SELECT doc_id, array_to_string(CASE WHEN doc_id % 50 = 0 THEN ['JP'] WHEN doc_id % 5 = 0 THEN ['US', 'GB'] WHEN doc_id % 5 = 1 AND NOT eu THEN CASE WHEN len(oft) = 0 OR (len(oft) = 1 AND oft[1] = 'FR') THEN ['FR'] WHEN oft[1] = 'FR' THEN ['FR', oft[2]] ELSE ['FR', oft[1]] END WHEN doc_id % 5 = 1 THEN ['EU', 'FR'] WHEN len(oft) > 0 THEN oft WHEN doc_id % 5 <> 2 AND lang = 'en' THEN ['KR'] ELSE ['UNSPECIFIED'] END, ',') AS countries,
          CASE WHEN doc_id % 50 = 0 THEN 'manual-repair' WHEN doc_id % 5 = 0 THEN 'native-normalized-v2' WHEN doc_id % 5 = 1 AND NOT eu THEN 'eu-refined-v2' WHEN doc_id % 5 = 1 THEN 'native' WHEN doc_id % 5 = 2 THEN 'legacy-refined-v2' ELSE 'heuristic-v2' END AS source FROM u""",
    "reason_badges": """WITH x AS (SELECT *, CASE l_returnflag WHEN 'R' THEN '계약 체결' WHEN 'A' THEN NULL ELSE '시장 신호' END AS e, CASE WHEN l_quantity > 45 THEN '공식 원문' WHEN l_quantity < 15 THEN '전문 매체' WHEN l_suppkey % 4 * 1.2 >= 2.4 THEN '국내 관련성 높음' WHEN l_linenumber >= 2 THEN '정책 영향 큼' END AS s FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 5 THEN '' WHEN e IS NULL AND s IS NULL THEN '브리핑 우선순위' ELSE concat_ws('|', e, s) END AS reasons FROM x""",
    "unit_conflicts": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN [] ELSE list_distinct([n || (p_size % 3 + 1), n || (p_size % 4 + 2)]) END AS u FROM (SELECT *, ['고리', '신고리', '한빛'][p_partkey % 3 + 1] AS n FROM part))
        SELECT a.p_partkey, array_to_string(list_sort(a.u), ',') AS units, len(a.u) > 0 AND len(b.u) > 0 AND NOT list_has_any(a.u, b.u) AS conflict FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1""",
    "pair_conflicts": """WITH o AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN '한빛' WHEN 1 THEN '바라카' END AS p, o_orderkey % 3 AS n, CASE o_orderkey % 4 WHEN 1 THEN ['KR', 'US'] WHEN 2 THEN ['FR'] ELSE [] END AS c FROM orders)
        SELECT a.o_orderkey, a.p IS NOT NULL AND b.p IS NOT NULL AND (a.p <> b.p OR a.n <> b.n) AS facility, len(a.c) > 0 AND len(b.c) > 0 AND NOT list_has_any(a.c, b.c) AS country FROM o a JOIN o b ON b.o_orderkey = a.o_orderkey + 1""",
    "report_matches": """WITH t(report, term, w) AS (VALUES ('r1','tion on',4.0),('r1','ent',3.0),('r1','er',2.0),('r1','the',1.0),('r1','ing',1.0),('r1','reports',1.0),('r1','nothing',0.3),('r2','sch',4.0),('r2','ung',3.0),('r2','ber',1.0),('r2','schule',1.0),('r2','lange',0.3),('r2','zusammenfassung',0.3),('r3','ción',4.0),('r3','ado',2.0),('r3','que',1.0),('r4','zzzz',2.0)),
        s AS (SELECT doc_id, report, round(sum(w), 6)::double AS score FROM documents, t WHERE contains(lower(text), term) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, report) AS rank FROM s) WHERE rank <= 3""",
    "insight_evidence": """WITH a AS (SELECT o_custkey AS insight, count(*) FILTER (o_orderstatus <> 'F') AS evidence, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 3 = 0) AS domestic, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 3 = 1) AS overseas FROM orders GROUP BY 1)
        SELECT insight, evidence::int AS evidence, concat_ws(',', CASE WHEN domestic > 0 THEN 'domestic' END, CASE WHEN overseas > 0 THEN 'overseas' END) AS regions, domestic, overseas, CASE WHEN domestic > 0 AND overseas > 0 THEN 'both' WHEN domestic > 0 THEN 'domestic' WHEN overseas > 0 THEN 'overseas' ELSE 'unclassified' END AS scope FROM a""",
    "keyword_trend": """WITH e AS (SELECT *, event_type || '-' || (user_id % 5) AS tag, ts::date AS day FROM events), t AS (SELECT max(day) AS today FROM e), c AS (SELECT tag, count(*) FILTER (day >= today - 7) AS now, count(*) FILTER (day < today - 7 AND day >= today - 14) AS before FROM e, t GROUP BY 1 HAVING now >= 3 ORDER BY now DESC, now - before DESC, tag LIMIT 6),
        r AS (SELECT e.tag, event_id, row_number() OVER (PARTITION BY e.tag ORDER BY day DESC, event_id) AS r FROM e JOIN c USING (tag), t WHERE day >= today - 7) SELECT tag, now, before, (SELECT string_agg(event_id, ',' ORDER BY r) FROM r WHERE r.tag = c.tag AND r <= 8) AS evidence FROM c""",
    "publication_refs": """WITH s AS (SELECT l_orderkey, 'u' || (l_partkey % 3) AS url, min(l_linenumber) AS o FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag <> 'A') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, url) AS r FROM s) SELECT l_orderkey, string_agg(url, ',' ORDER BY r) AS refs FROM r WHERE r <= 2 GROUP BY 1""",
    "summary_lookup": """SELECT l_partkey, l_shipdate::date::varchar AS day, l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate::date DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1""",
    "briefing_today": """WITH e AS (SELECT event_id, ts::date::varchar AS day, CASE WHEN event_type <> 'view' THEN value END AS score FROM events WHERE event_type <> 'error') SELECT * FROM e WHERE day = (SELECT max(day) FROM e) ORDER BY coalesce(score, 0) DESC, event_id LIMIT 12""",
    "override_verdicts": """WITH e AS (SELECT *, ts::date::varchar AS day, left(md5(user_id::varchar), 8) AS h FROM events), o AS (SELECT h, day, max(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS w FROM e WHERE event_id % 3 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY 1, 2)
        SELECT event_type, day, ['promote', 'demote', 'hide'][max(w) + 1] AS verdict FROM e JOIN o USING (h, day) GROUP BY 1, 2""",
    "unmatched_overrides": """WITH e AS (SELECT *, ts::date::varchar AS day, left(md5(user_id::varchar), 8) AS h FROM events), o AS (SELECT h, day, max(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS w FROM e WHERE event_id % 3 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY 1, 2)
        SELECT h AS hash8, day, ['promote', 'demote', 'hide'][w + 1] AS action FROM o WHERE (h, day) NOT IN (SELECT (h, day) FROM e WHERE event_id % 2 = 0)""",
    "insights_applied": """WITH p AS (SELECT p_partkey, ['', '긍정적 입장을 시사한다.', '건설을 승인했다.'][p_size % 3 + 1] AS i, p_partkey % 2 = 0 AND p_partkey % 4 <> 0 AND p_size % 3 <> 2 AS take FROM part) SELECT p_partkey, CASE WHEN take THEN 'insight ' || p_partkey ELSE i END AS implication, CASE WHEN take THEN 'issue_timeline' END AS implication_source FROM p""",
    "coverage_gaps": """SELECT name, domain FROM (VALUES ('a','iaea.org'),('b','nrc.gov'),('c','example.com')) s(name, domain) WHERE NOT EXISTS (SELECT 1 FROM pages WHERE contains(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), domain))""",
    "story_tag_counts": """SELECT tag, count(DISTINCT l_orderkey) AS stories FROM (SELECT l_orderkey, l_returnflag AS tag FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem) GROUP BY 1""",
    "meta_coverage": """SELECT count(*) AS records, count(lang) AS curated, round(count(*) FILTER (lang IS NOT NULL AND coalesce(source, '') <> '') / nullif(count(lang), 0), 6) AS has_source, round(count(*) FILTER (lang IS NOT NULL AND n_chars > 500) / nullif(count(lang), 0), 6) AS is_long FROM documents""",
    "tracking_rate": """WITH e AS (SELECT ts::date AS day, value > 10 AS tracked FROM events), l AS (SELECT DISTINCT day FROM e ORDER BY day DESC LIMIT 7) SELECT count(DISTINCT day) AS briefings, count(*) AS issues, round(avg(tracked::int), 6) AS tracked_rate FROM e JOIN l USING (day)""",
    "days_with_stats": """WITH e AS (SELECT *, ts::date AS day FROM events), b AS (SELECT DISTINCT day FROM e WHERE event_type = 'purchase' AND user_id % 4 = 0) SELECT DISTINCT day::varchar AS day, day NOT IN (SELECT day FROM b) AS empty FROM e WHERE day >= (SELECT min(day) FROM b)""",
    "evidence_hashes": """WITH o AS (SELECT o_custkey, o_orderkey, left(md5(o_orderkey::varchar), 8) AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') SELECT c.o_custkey, coalesce((SELECT string_agg(h, ',' ORDER BY r) FROM o WHERE o.o_custkey = c.o_custkey AND r <= 2), '') AS kept FROM (SELECT DISTINCT o_custkey FROM orders) c""",
    "catalog_order": """WITH i AS (SELECT l_orderkey, max(l_shipdate::date) AS ls, count(*) FILTER (l_returnflag = 'R') AS mr, max(l_quantity) AS sc, count(DISTINCT l_suppkey) AS cc FROM lineitem GROUP BY 1) SELECT l_orderkey, l_orderkey % 7 AS shelf, row_number() OVER (PARTITION BY l_orderkey % 7 ORDER BY ls DESC, mr DESC, sc DESC, cc DESC, l_orderkey) AS position FROM i QUALIFY position <= 20""",
    "archive_sorts": """WITH i AS (SELECT l_orderkey, max(l_shipdate::date) AS ls, count(*) AS ac, count(DISTINCT l_shipdate) AS bc FROM lineitem GROUP BY 1), s AS (SELECT 'recent' AS sort, l_orderkey, row_number() OVER (PARTITION BY l_orderkey % 7 ORDER BY ls DESC, ac DESC, l_orderkey) AS position FROM i UNION ALL SELECT 'tracked', l_orderkey, row_number() OVER (PARTITION BY l_orderkey % 7 ORDER BY bc DESC, ls DESC, l_orderkey) FROM i UNION ALL SELECT 'sources', l_orderkey, row_number() OVER (PARTITION BY l_orderkey % 7 ORDER BY ac DESC, ls DESC, l_orderkey) FROM i)
        SELECT sort, l_orderkey, l_orderkey % 7 AS shelf, position FROM s WHERE position <= 10""",
    "member_timeline": """WITH m AS (SELECT l_orderkey, l_shipdate::date AS a, l_linenumber % 3 AS b, l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_quantity::int AS hash FROM lineitem) SELECT l_orderkey, hash, row_number() OVER (PARTITION BY l_orderkey ORDER BY a DESC, b DESC, hash DESC) AS position FROM m""",
    "fifo_cap": "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 80",
    "weekly_changed": """WITH i AS (SELECT l_orderkey, max(l_shipdate::date) AS ls, count(DISTINCT l_suppkey) AS cc FROM lineitem GROUP BY 1), m AS (SELECT max(ls) AS d FROM i), w AS (SELECT (d - ((dayofweek(d) + 1) % 7)::int)::date AS s FROM m) SELECT l_orderkey FROM i, w WHERE l_orderkey % 2 = 0 AND ls BETWEEN s AND s + 6 ORDER BY ls DESC, cc DESC, l_orderkey LIMIT 5""",
    "archive_filtered": """WITH i AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linestatus = 'F') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0) SELECT l_orderkey FROM i WHERE l_orderkey % 2 = 0 AND l_orderkey % 3 <> 1 AND contains(l_orderkey::varchar, '1')""",
    "entity_counts": """WITH i AS (SELECT l_orderkey, max(l_shipdate::date) AS ls FROM lineitem GROUP BY 1), e AS (SELECT DISTINCT l_orderkey, l_linestatus AS entity FROM lineitem), s AS (SELECT max(l_shipdate::date) - 100 AS seen FROM lineitem WHERE l_linestatus = 'F'), c AS (SELECT entity, count(*) AS issues, count(*) FILTER (entity <> 'F' OR ls > seen) AS new_issues FROM e JOIN i USING (l_orderkey), s GROUP BY 1),
        t AS (SELECT entity, l_returnflag AS topic, count(DISTINCT l_orderkey) AS n FROM e JOIN lineitem USING (l_orderkey) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, topic) AS r FROM t) SELECT c.*, CASE WHEN issues >= 3 THEN (SELECT string_agg(topic, ',' ORDER BY r) FROM r WHERE r.entity = c.entity AND r <= 3) ELSE '' END AS topics FROM c""",
    "span_tracks": """WITH i AS (SELECT l_orderkey, min(l_shipdate::date) AS f, max(l_shipdate::date) AS l FROM lineitem GROUP BY 1), e AS (SELECT min(f) + 100 AS a, max(l) - 100 AS b FROM i), p AS (SELECT l_orderkey, l - f + 1 AS days, least(100.0, greatest(0.0, (f - a) * 100.0::double / greatest(b - a, 1))) AS x, least(100.0, greatest(0.0, (l - a) * 100.0::double / greatest(b - a, 1))) AS y FROM i, e)
        SELECT l_orderkey, round(x, 2) AS "left", round(CASE WHEN days <= 1 THEN 0 ELSE y - x END, 2) AS width, days::int AS days FROM p""",
    "resolved_issues": """WITH e AS (SELECT *, ts::date AS day FROM events), p AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) % 2 = 1), c AS (SELECT user_id, count(*) AS n FROM e WHERE user_id % 3 <> 0 GROUP BY 1), a AS (SELECT DISTINCT user_id, day FROM e)
        SELECT a.user_id, a.day::varchar AS day, CASE WHEN a.day = (SELECT max(day) FROM e) THEN coalesce(c.n, p.n) ELSE coalesce(p.n, c.n) END AS n FROM a LEFT JOIN c USING (user_id) LEFT JOIN p ON p.user_id = a.user_id AND p.day = a.day""",
    "publication_shelf": """SELECT p_partkey, p_size > 25 AS technical FROM part WHERE p_partkey % 9 <> 0 AND p_name <> '' AND p_type <> '' AND p_brand = (SELECT min(p_brand) FROM part)""",
    "report_candidates": """SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN p_type ELSE p_brand END AS why FROM part WHERE p_partkey % 4 = 0 ORDER BY p_partkey LIMIT 6""",
    "settings_overlay": """WITH s AS (SELECT DISTINCT 'f' || (s_suppkey % 3) AS feed, 'v' || (s_nationkey % 5) AS value FROM supplier), f AS (SELECT DISTINCT feed FROM s), c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'f' || (c_custkey % 4) END AS g, c_nationkey % 2 = 0 AS present, 'v' || (c_nationkey % 7) AS value FROM customer WHERE c_custkey % 10 <> 0),
        h AS (SELECT feed, value, NULL AS id, true AS present FROM s UNION ALL SELECT feed, value, id, present FROM c JOIN f ON g IS NULL OR g = feed), o AS (SELECT *, coalesce(lag(present) OVER w, false) AS before, lead(id) OVER w IS NULL AS last FROM h WINDOW w AS (PARTITION BY feed, value ORDER BY id NULLS FIRST))
        SELECT feed, value FROM o WHERE last AND present UNION ALL SELECT 'applied', id::varchar FROM (SELECT DISTINCT id FROM o WHERE id IS NOT NULL AND present <> before)""",
    "search_variants": """SELECT p_partkey, ['고리1호기,고리', 'smrmarket,소형모듈원자로market', 'steeltin', '소형모듈원자로건설,smr건설'][p_size % 4 + 1] AS variants FROM part""",
    "recent_titles": """WITH o AS (SELECT *, o_orderdate::date AS day, CASE WHEN o_orderkey % 3 = 0 THEN '제목 ' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'Title ' || (o_orderkey % 50) END AS title FROM orders), t AS (SELECT max(day) AS today FROM o) SELECT title, count(*) AS n FROM o, t WHERE title IS NOT NULL AND (day >= today - 21 OR o_orderkey % 10 = 1) GROUP BY 1""",
    "archive_windows": """WITH o AS (SELECT *, o_orderdate::date AS day, o_orderdate::timestamp AS stamp, o_orderkey % 10 > 1 AS stamped FROM orders), t AS (SELECT max(day) AS today FROM o) SELECT 'seeds' AS reader, count(*) AS n FROM o, t WHERE stamped AND day >= today - 21 UNION ALL SELECT 'trend', count(*) FROM o, t WHERE strftime(day, '%Y-%m') >= strftime(today - 14, '%Y-%m') AND NOT starts_with(o_orderpriority, '5') AND NOT starts_with(o_orderpriority, '4')
        UNION ALL SELECT 'window', count(*) FROM o, t WHERE stamped AND date_trunc('second', stamp) BETWEEN (today::timestamp - INTERVAL 30 DAY) AND today::timestamp""",
    "collector_dedup": """SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""",
    "migrated_archive": """SELECT o_orderkey::varchar AS hash, 'https://h.com/' || o_custkey AS url FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY starts_with(o_orderpriority, '5')::int, o_orderkey % 3, o_orderdate::date DESC, o_orderkey::varchar) AS r FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 29 <> 0) WHERE r = 1""",
    "curation_normalised": """SELECT c_custkey AS hash, ['must_read', 'nice_to_know', 'noise'][c_custkey % 3 + 1] AS importance, ['smr', 'international', 'international', 'khnp'][c_custkey % 4 + 1] AS section, ['kr', '', ''][c_custkey % 3 + 1] AS scope, 'smr,waste,fusion' AS topics, 'US,KR' AS countries, 'opinion' AS article_type, CASE WHEN c_custkey % 2 = 0 THEN '제목' ELSE c_name END AS title_kr, 'a b' AS summary, CASE WHEN c_custkey % 5 = 0 THEN '건설을 승인했다.' ELSE '' END AS implication, CASE WHEN c_custkey % 5 = 0 THEN '중요한 일이다.' ELSE '' END AS why_important, CASE WHEN c_custkey % 3 = 0 THEN '시점은 미정이다' ELSE '' END AS open_question, 3 AS tags, 0 AS related, 'deadline' AS event_date_type FROM customer""",
}
QUERIES = {k: globals()[k] for k in [*SQL, "issue_verdicts", "issues_in_two_passes", "selection_outcomes", "prior_coverage"]}
