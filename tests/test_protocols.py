import json

import pytest
from pyspark.sql import functions as F

from tidewire.operators import protocols as Q


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("b", i, f"제목 {i} 승인", [f"규제기관 심사 절차 마무리 {i}"], f"k{i}") for i in range(4)] + [("c", 0, "t", [], "k")], "batch string, idx int, title string, members array<string>, keyword string")


def answers(spark, *payloads):
    return spark.createDataFrame([(b, p if isinstance(p, str) or p is None else json.dumps(p, ensure_ascii=False)) for b, p in payloads], "batch string, payload string")


def test_salvage(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('Here: {"a": "x\ny"} thanks',), ("{broken",), (None,), ("[1]",)], "p string")
    assert [r["s"] for r in df.select(Q.salvaged(F.col("p")).alias("s")).collect()] == ['{"a": 1}', '{"a": "x y"}', None, None, None]


def test_scores_verdicts_and_groups(spark, asked):
    got = {(r["batch"], r["idx"]): r for r in Q.cluster_scores(answers(spark, ("b", {"scores": [{"idx": 0, "score": 12, "tags": ["a"] * 5}, {"idx": 1, "score": 3}, {"idx": 9, "score": 1}, {"idx": 2, "score": "x"}]}), ("c", "down")), asked).collect()}
    assert got["b", 0]["ai_score"] == 10.0 and len(got["b", 0]["ai_tags"]) == 3 and not got["b", 1]["kept"] and got["b", 2]["kept"] and got["b", 3]["kept"] and got["c", 0]["kept"] and len(got) == 5
    same = Q.verdicts(answers(spark, ("b", {"items": [{"idx": "0", "same_event": True, "reason": "r" * 90}, {"idx": 1, "same_event": "true"}, {"idx": 2, "same_event": False}, {"idx": 7, "same_event": True}, {"same_event": True}]})), asked).collect()
    assert {(r["idx"], r["same"]) for r in same} == {(0, True), (2, False)} and max(len(r["reason"]) for r in same) == 60
    in_groups = {(r["batch"], r["idx"]): r["group"] for r in Q.groups(answers(spark, ("b", {"groups": [[3, 1], [1, 2, 44]]})), asked).collect()}
    assert in_groups == {("b", 0): 0, ("b", 1): 1, ("b", 3): 1, ("b", 2): 2, ("c", 0): 0}


def test_texts(spark, asked):
    items = [{"idx": 0, "insight": "가" * 200}, {"idx": 1, "insight": "긍정적 입장을 시사한다."}, {"idx": 2, "insight": "제목 2 승인"}, {"idx": 3, "insight": "규제기관 심사 절차 마무리 3"}]
    assert {r["idx"]: r["rejected"] for r in Q.insights(answers(spark, ("b", {"items": items}), ("c", {"items": [{"idx": 0, "insight": "새로운  분석이다"}]})), asked, "title", "members").where("batch = 'b'").collect()} == {0: "too_long", 1: "hollow", 2: "restates_title", 3: "copies_member"}
    tr = Q.translations(answers(spark, ("b", {"items": [{"idx": 0, "title_kr": " 제 목 ", "off_topic": "false", "relevance": "??"}, {"idx": 1, "title_kr": "", "gist": "x"}, {"idx": 2, "title_kr": "t", "off_topic": True, "off_topic_reason": "r", "relevance": "Off"}]})), asked)
    assert [(r["idx"], r["title_kr"], r["off_topic"], r["off_topic_reason"], r["relevance"]) for r in tr.orderBy("idx").collect()] == [(0, "제 목", False, None, "core"), (2, "t", True, "r", "off")]
    inv = {(r["batch"], r["idx"]): (r["theme"], r["direction"]) for r in Q.investments(answers(spark, ("b", {"items": [{"idx": 0, "theme": "SMR", "direction": "Positive"}, {"idx": 1, "direction": "up"}]})), asked).collect()}
    assert inv["b", 0] == ("SMR", "positive") and inv["b", 1] == ("none", "none") and inv["c", 0] == (None, None)
    rec = Q.recommendations(answers(spark, ("b", {"recommendations": [{"idx": 9, "topic": "x"}, {"idx": 2, "topic": "A"}, {"idx": 2, "topic": "B"}, {"idx": 0, "topic": " "}, {"idx": 1, "topic": "C"}, {"idx": 3, "topic": "D"}]})), asked)
    assert sorted((r["idx"], r["topic"]) for r in rec.collect()) == [(1, "C"), (2, "A")]
    week = Q.weekly_synthesis(answers(spark, ("w", {"headline": "h", "key_events": list("abcdefg"), "policy_shifts": "none"}), ("x", None))).collect()
    assert {(r["batch"], r["headline"], len(r["key_events"]), len(r["policy_shifts"])) for r in week} <= {("w", "h", 5, 0), ("w", "", 0, 0), ("x", "", 0, 0)}
    dirs = Q.directions(answers(spark, ("b", {"items": [{"idx": 0, "keyword": "K0", "direction": "up"}, {"idx": 1, "keyword": "zz", "direction": "up"}, {"idx": 2, "direction": " down "}]})), asked)
    assert sorted((r["idx"], r["direction"]) for r in dirs.collect()) == [(0, "up"), (2, "down")]
    cards = spark.createDataFrame([("b", 0, "w", "i", "k"), ("b", 1, "w", "i", "k")], "batch string, idx int, why string, investment string, kr_takeaway string")
    assert [tuple(r) for r in Q.checked_cards(cards, answers(spark, ("b", {"unsupported": [{"idx": 1, "fields": ["Why ", "kr", "zz"]}]}))).orderBy("idx").collect()] == [("b", 0, "w", "i", "k"), ("b", 1, None, "i", None)]
    assert Q.checked_cards(cards, answers(spark, ("b", "oops"))).where("why is null").count() == 0
    cur = Q.curations(answers(spark, ("b", {"items": [{"hash": "h2", "summary": "s"}, {"hash": "zz", "summary": "t"}]})), spark.createDataFrame([("h1",), ("h2",)], "hash string"), "summary:string").collect()
    assert [(r["hash"], r["item"]["summary"]) for r in cur] == [("h2", "s")]
    back = Q.fallback_curation(spark.createDataFrame([("a", "원전 소식", "x.com"), ("b", "News", "x.com")], "hash string, title string, domain string")).collect()
    assert [(r["hash"], r["section"]) for r in back] == [("a", "domestic")]


def test_lead_ladder():
    said = iter(["vague", "Reactor A restarts"])
    assert Q.lead(lambda m: next(said), "m", lambda t: "A" in t) == ("Reactor A restarts", False)
    said = iter(["vague", "vague again"])
    assert Q.lead(lambda m: next(said), "m", lambda t: "A" in t) == ("", False)
    said = iter(["A " * 80, "A short"])
    assert Q.lead(lambda m: next(said), "m", lambda t: True) == ("A short", False)

    def fails(m, calls=[]):  # noqa: B006
        calls.append(m)
        if len(calls) > 1:
            raise TimeoutError
        return "Alpha beta, " * 12

    text, was_cut = Q.lead(fails, "m", lambda t: True)
    assert was_cut and len(text) <= 90 and text.endswith("…")


def test_requests_failures_and_pacing(spark, asked):
    parts = {(r["batch"], r["part"]): r["message"] for r in Q.messages(asked, "batch", "idx", F.col("keyword"), size=3).collect()}
    assert parts == {("b", 0): "[0] k0\n[1] k1\n[2] k2", ("b", 1): "[0] k3", ("c", 0): "[0] k"}
    df = spark.createDataFrame([("HTTP 429 RESOURCE_EXHAUSTED PerDay",), ('429 {"retryDelay": "42s"} PerDay',), ("request Timed out",), ("MAX_TOKENS",), (None,)], "m string")
    got = df.select(Q.failure_label(F.col("m")).alias("l"), Q.retry_delay(F.col("m")).alias("d"), F.coalesce(Q.daily_quota(F.col("m")), F.lit(False)).alias("q")).collect()
    assert [(r["l"], r["d"], r["q"]) for r in got] == [("quota", None, True), ("other", 44.0, False), ("timeout", None, False), ("truncated", None, False), ("other", None, False)]
    now, slept = [0.0], []
    p = Q.Pacer(clock=lambda: now[0], sleep=slept.append, budget=50)
    p.before_call()
    now[0] = 1.5
    p.before_call()
    assert slept == [2.5] and p.wait(44) and not p.wait(10) and p.wait(6)


def test_social_and_outbox(spark):
    df = spark.createDataFrame([(10, "2024 @IAEAorg", None), (10, "r/Nuclear", 1), (10, "", 2)], "s int, m string, t int")
    assert [r["b"] for r in df.select(Q.boosted(F.col("s"), F.col("m"), ["iaeaorg"], ["nuclear"], F.col("t")).alias("b")).collect()] == [35, 65, 30]
    briefs = spark.createDataFrame([("d", 0, "pending", None), ("d", 1, "sent", "x"), ("e", 0, "pending", None)], "day string, idx int, status string, sent_at string")
    results = spark.createDataFrame([("d", 0, 1, "failed", None), ("d", 0, 2, "sent", "y"), ("e", 0, 1, "stale_skipped", None), ("z", 0, 1, "sent", "q")], "day string, idx int, at int, status string, sent_at string")
    once = Q.outbox_results(briefs, results)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, Q.outbox_results(once, results).collect())) == [("d", 0, "sent", "y"), ("d", 1, "sent", "x"), ("e", 0, "stale_skipped", None)]
    assert {r["day"]: r["status"] for r in Q.outbox_status(once).collect()} == {"d": "sent", "e": "sent"} and {r["day"]: r["status"] for r in Q.outbox_status(briefs).collect()} == {"d": "partial", "e": "pending"}
