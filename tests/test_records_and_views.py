import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import fields as P
from tidewire.functions import gates as G
from tidewire.operators import graph
from tidewire.operators import issues as I
from tidewire.operators import links as L
from tidewire.operators import records as A
from tidewire.operators import selection as S
from tidewire.operators import views as V
from tidewire.sources import feeds
from tidewire.sources import state as ST


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[find(a)] = find(b)
    got = {}
    for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    want = {}
    for x in root:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gates(spark):
    c = F.col
    assert one(spark, G.keyword_gate(c("t"), c("d"), F.array(F.lit("SMR"))), t="New smr", d="x") and not one(spark, G.keyword_gate(c("t"), c("d"), F.array(F.lit("SMR"))), t="wool", d=None)
    assert one(spark, G.keyword_gate(c("t"), c("d"), F.lit(None).cast("array<string>")), t=None, d=None)
    assert one(spark, G.substantive(c("a"), c("b")), a="고리 2호기 심사 착수", b="고리 2호기 소식") and not one(spark, G.substantive(c("a"), c("b")), a="국내외 다양한 논의", b="국내외 다양한 논의")
    assert one(spark, G.restates_title(c("a"), c("b")), a="정부 원전 승인했다", b="정부, 원전 승인했다") and not one(spark, G.restates_title(c("a"), c("b")), a="정부 원전 3기 승인했다", b="정부, 원전 승인했다")
    assert one(spark, G.needs_insight(c("a"), F.lit(2)), a="전망이다.") and not one(spark, G.needs_insight(c("a"), F.lit(1)), a="")
    rows = spark.createDataFrame([(1, "Company holds a charity run"), (2, "Regulator approves reactor"), (3, None)], "k int, t string")
    examples = spark.createDataFrame([("Company holds charity run",), ("run",)], "e string")
    assert {r["k"] for r in G.unlike_examples(rows, "t", examples, "e").collect()} == {2, 3}
    assert one(spark, G.without_body(F.lit(" "), c("a")), a="x") == "" and one(spark, G.without_body(F.lit("b"), c("a")), a=" x ") == "x"


def test_fields(spark):
    c = F.col
    assert one(spark, P.without_org(c("t"), c("o")), t="경제협력개발기구 원자력기구(OECD-NEA): SMR 보고서", o="OECD 원자력기구(NEA)") == "SMR 보고서"
    assert one(spark, P.without_org(c("t"), c("o")), t="원자력기구(NEA)", o="NEA") == "원자력기구(NEA)"
    assert one(spark, P.takeaway(c("t")), t="짧다. 다음.") == "짧다."
    long = "정부가 신규 원전 건설을 위한 부지 선정 절차를 올해 안에 마무리하기로 했으며, " + "관련 부처와 협의를 이어가고 지역 주민 설명회를 여러 차례 열어 의견을 듣기로 하였고 예산도 확보한다."
    assert one(spark, P.takeaway(c("t")), t=long) == "정부가 신규 원전 건설을 위한 부지 선정 절차를 올해 안에 마무리하기로 했습니다."
    assert one(spark, P.change_line(c("a"), c("b")), a="부지 선정을 검토 중이다.", b="부지를 확정하고 착공했다.") == "부지 선정을 검토 중이다 → 부지를 확정하고 착공했다."
    assert one(spark, P.change_line(c("a"), c("b")), a="부지를 확정했다.", b="부지를 확정했다!") == "" == one(spark, P.change_line(c("a"), c("b")), a="", b="x")
    assert len(one(spark, P.change_line(c("a"), c("b")), a="가나 다라 " * 30, b="마바 사아 " * 30)) <= 200
    assert one(spark, P.restatement(c("a"), c("b")), a="MOU 체결 협력", b="양해각서 체결 협력한다") and not one(spark, P.restatement(c("a"), c("b")), a="건설 승인 검토", b="건설 승인 의결")
    s = one(spark, P.split_interpretation(c("a"), c("b")), a="원전 건설 승인 절차가 끝났다", b="원전 건설 승인 절차가 모두 끝났다")
    assert (s["implication"], s["why_important"]) == ("", "원전 건설 승인 절차가 모두 끝났다")
    assert str(one(spark, P.date_in_text(c("t")), t="게시 2024. 5. 6.")) == "2024-05-06" == str(one(spark, P.date_in_text(c("t")), t="on 6 May 2024")) and one(spark, P.date_in_text(c("t")), t="2024-13-40") is None
    assert one(spark, P.undoubled(c("t")), t="Outlook 2024 Outlook 2024") == "Outlook 2024" and one(spark, P.undoubled(c("t")), t="aab") == "aab"
    assert len(one(spark, P.publication_id(c("t")), t="u")) == 12 and one(spark, P.clause_cut(c("t"), 12), t="alpha beta, gamma delta") == "alpha beta…"
    guard = P.unsourced_names(c("t"), c("s"), "이윤문", "대통령|장관")
    assert one(spark, guard, t="윤석열 대통령이 승인", s="이재명 대통령 발언") == "대통령이 승인" and one(spark, guard, t="이재명 대통령이 승인", s="李 대통령") == "이재명 대통령이 승인"


def brute_fold(rows):
    import difflib
    import re

    bare = lambda t: re.sub(r"[^\w가-힣]", "", re.sub(r"\[[^\]]+\]|\([^)]+\)", "", t)).lower()
    heads = lambda t: {w[:2] for w in re.findall(r"\w+", t.lower()) if len(w) >= 2}
    units = lambda t: {p + n for p, ns in re.findall(r"(고리|한빛)\s*([0-9][0-9,·]*)\s*호기", t) for n in re.findall(r"\d+", ns)}
    kept, out = [], {}
    for k, t, tags, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        hit = None
        for o, u, ot in kept:
            if units(t) and units(u) and not units(t) & units(u):
                continue
            n = len(heads(t) & heads(u))
            alike = difflib.SequenceMatcher(None, bare(t), bare(u)).ratio() >= 0.82 or n >= 4 and (n >= 0.45 * len(heads(t) | heads(u)) or n >= 0.6 * min(len(heads(t)), len(heads(u)))) or units(t) & units(u) and set(tags) & set(ot)
            if alike:
                hit = o
                break
        out[k] = hit
        if hit is None:
            kept.append((k, t, tags))
    return out


def test_selection_pipeline(spark):
    rng = random.Random(3)
    words = "원전 건설 승인 심사 계속운전 수출 계약 규제 안전 연료".split()
    rows = []
    for i in range(60):
        unit = f"{rng.choice(['고리', '한빛'])} {rng.randint(1, 3)}호기 " if rng.random() < 0.5 else ""
        rows.append((i, unit + " ".join(rng.sample(words, rng.randint(2, 5))), rng.sample(["a", "b", "c"], 1), float(rng.randint(0, 40))))
    df = spark.createDataFrame(rows, "k int, t string, g array<string>, s double").withColumns({"r": F.lit("kr"), "q": F.lit("")})
    got = {r["k"]: r["dup_of"] for r in S.fold_duplicates(df, ["r"], "k", "t", "g", "s", "q").collect()}
    want = brute_fold(rows)
    assert {k: None if v is None or v != v else int(v) for k, v in got.items()} == want
    full = df.withColumns({"grade": F.when(F.col("s") > 30, "must_read").otherwise("nice_to_know"), "has": F.col("k") % 5 != 0, "topic": F.col("k") % 3})
    out = S.rank_and_select(full, ["r"], "k", "t", "g", "s", "grade", "has", "topic", "q", {"nice_to_know": 14.0, "must_read": 20.0}, {"base": 3, "max": 8})
    by = {r["k"]: r["outcome"] for r in out.collect()}
    kept = [k for k, v in want.items() if v is None]
    score = {r[0]: r[3] for r in rows}
    below = {k for k in kept if k % 5 and score[k] < (20 if score[k] > 30 else 14)}
    assert {k for k, v in by.items() if v == "below_floor"} == below and {k for k, v in by.items() if v == "duplicate"} == {k for k, v in want.items() if v is not None}
    eligible = [k for k in kept if k not in below]
    must = sum(score[k] > 30 for k in eligible)
    assert sum(v == "selected" for v in by.values()) == max(0, min(3 + min(2, must) + min(3, max(0, (len(eligible) - 3) // 5)), len(eligible), 8))
    stats = S.region_stats(out, full, ["r"], "k", "has").first()
    assert (stats["candidate_count"], stats["features_missing"]) == (60, 12)
    meant = S.rank_and_select(full, ["r"], "k", "t", "g", "s", "grade", "has", "topic", "q", k=5, semantic=lambda head: head.orderBy(F.desc("s"), "k").limit(1))
    assert {r["k"] for r in meant.where("outcome = 'semantic_duplicate'").collect()} == {max(kept, key=lambda k: (score[k], -k))}
    assert S.floors({"selection_floor": {"_note": 1, "must_read": {"kr": 3}, "noise": "x"}}, "kr") == {"must_read": 3.0}


def test_prior_coverage_equals_brute_force(spark):
    rng = random.Random(9)
    words = "reactor builds approves delays license uranium vendor export grid fuel".split()
    title = lambda: " ".join(rng.sample(words, rng.randint(2, 6)))
    new, old = [(i, title()) for i in range(25)] + [(99, None)], [(title(),) for _ in range(60)] + [(None,)]
    got = {r["k"]: r["prior"] for r in S.prior_coverage(spark.createDataFrame(new, "k int, t string"), "k", "t", spark.createDataFrame(old, "o string"), "o").collect()}
    assert got == {k: 0 if t is None else sum(len(brute_fold([(0, o, [], 1.0), (1, t, [], 0.0)])) == 2 and brute_fold([(0, o, [], 1.0), (1, t, [], 0.0)])[1] == 0 for (o,) in old if o) for k, t in new}


def test_prior_coverage_without_three_letters_in_a_row(spark):
    new, old = [(1, "abcdefgh"), (2, "qqqq")], [("abxcdxefxgh",), ("abxcdxefxgh",), ("[a] abcdefgi",), ("hgfedcba",), ("",)]
    got = {r["k"]: r["prior"] for r in S.prior_coverage(spark.createDataFrame(new, "k int, t string"), "k", "t", spark.createDataFrame(old, "o string"), "o").collect()}
    assert got == {1: 3, 2: 0}


def brute_issues(rows, scores, vetoes, window=21):
    issues = []
    for k, day, scope in sorted(rows, key=lambda r: (r[1], r[0])):
        best = None
        for i in issues:
            if day - i["last"] > window or any(frozenset((k, m)) in vetoes for m in i["keys"]):
                continue
            pool = [*i["scopes"], scope]
            if any(scope and s and not scope & s and not any(p & scope and p & s for p in pool) for s in i["scopes"]):
                continue
            for m in i["keys"][-3:]:
                s = scores.get(frozenset((k, m)))
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
        i = best[1] if best else {"keys": [], "scopes": []}
        if not best:
            issues.append(i)
        i["keys"].append(k)
        i["scopes"].append(scope)
        i["last"] = day
    return {k: i["keys"][0] for i in issues for k in i["keys"]}


def test_issue_fold_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, rng.randrange(60), {c for c in ("FR", "HU", "RO") if rng.random() < 0.3}) for i in range(70)]
    scores, vetoes = {}, set()
    for _ in range(160):
        a, b = rng.sample(range(70), 2)
        if rng.random() < 0.15:
            vetoes.add(frozenset((a, b)))
        else:
            scores[frozenset((a, b))] = round(rng.random(), 2)
    scores = {p: s for p, s in scores.items() if p not in vetoes}
    df = spark.createDataFrame([(k, d, sorted(c) or ["OTHER"]) for k, d, c in rows], "k int, n int, c array<string>").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n"))).repartition(3)
    scored = spark.createDataFrame([(*sorted(p), s) for p, s in scores.items()], "left int, right int, score double").withColumns({"matched": F.lit(True), "method": F.lit("title"), "blocked_by": F.array().cast("array<string>")})
    veto = spark.createDataFrame([tuple(sorted(p)) for p in vetoes], "left int, right int")
    got = {r["k"]: r["issue"] for r in I.cluster(df, scored, "k", "day", ["day"], "c", I.Judgments(rejected=veto)).collect()}
    assert got == brute_issues(rows, scores, vetoes)


def test_pair_verdicts_and_two_passes(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-01", "한빛 1호기 재가동 승인", ["#a", "b"], ["x"], ["KR"], [1.0, 0.0]), (2, "2024-01-02", "한빛 1호기 재가동 승인했다", ["A"], ["x"], ["KR"], [1.0, 0.1]), (3, "2024-01-03", "한빛 2호기 재가동 승인", ["a", "b"], [], ["KR"], [0.0, 1.0]), (4, "2024-01-04", "헝가리 가뭄 소식", ["a", "b"], ["x"], ["HU"], [-1.0, 0.0]), (5, "2024-01-05", "전혀 다른 제목 하나", ["c"], ["x"], [], [0.8, 0.6])],
        "k int, day string, t string, g array<string>, o array<string>, c array<string>, v array<double>",
    ).withColumn("day", F.col("day").cast("date"))
    pairs = rows.select(F.col("k").alias("left")).crossJoin(rows.select(F.col("k").alias("right"))).where("left < right")
    scored = I.score_pairs(pairs, rows, "k", "t", "g", "o", "c", "", "v").cache()
    by = {(r["left"], r["right"]): r for r in scored.collect()}
    assert by[1, 2]["method"] == "title" and by[1, 3]["blocked_by"] == ["facility_conflict"] and "country_conflict" in by[1, 4]["blocked_by"] and by[2, 5]["method"] == "none"
    review = {(r["left"], r["right"]): r["review"] for r in I.review_candidate(scored).where("review is not null").collect()}
    assert review[1, 5] == "remote_candidate" and (1, 2) not in review and (1, 3) not in review
    same = I.two_passes(rows, scored, "k", "day", ["day"], "c", lambda q: q.select("left", "right", ((F.col("left") == 2) & (F.col("right") == 5)).alias("same")))
    assert {r["k"]: r["issue"] for r in same.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}  # 1 and 5 are rejected: the veto holds for the whole issue
    yes = I.two_passes(rows, scored, "k", "day", ["day"], "c", lambda q: q.select("left", "right", F.lit(True).alias("same")))
    assert {r["k"]: r["issue"] for r in yes.collect()}[5] == 1


def test_archive(spark):
    articles = spark.createDataFrame([("h1", "2024-01-01", "https://news.google.com/rss/a?utm_source=x", "Reactor restarts - Example Daily", None, "news.google.com", "SMR", None, None), ("h2", None, "http://b.go.kr/x/", "Title", "Ministry", "www.b.go.kr", None, "정부", "http://c.kr/y")], "hash string, pub string, link string, title string, publisher string, domain string, feed string, site_name string, resolved_url string")
    curated = spark.createDataFrame([("h1", "요약했다.", "must_read")], "hash string, summary string, importance string")
    got = {r["hash"]: r for r in A.make_records(articles, curated, F.lit("2024-01-02")).collect()}
    assert (got["h1"]["title"], got["h1"]["publisher"], got["h1"]["source_type"], got["h1"]["summary"]) == ("Reactor restarts", "Example Daily", "general_media", "요약했다.")
    assert (got["h2"]["source_type"], got["h2"]["url"], got["h2"]["pub"], got["h2"]["publisher"]) == ("official", "http://b.go.kr/x", "", "Ministry")
    feed = spark.createDataFrame([(1, "Deal [A]", "P", "x.com", "https://news.google.com/1"), (2, "deal", "p", "x.com", "https://x.com/2"), (3, "Deal", "Q", "x.com", "https://x.com/3"), (4, "Other", "P", "y.com", "https://y.com/4")], "n int, t string, p string, d string, l string")
    assert sorted((r["n"], r["l"]) for r in A.first_with_replacement(feed, "t", "p", "d", "l", "n").collect()) == [(1, "https://x.com/2"), (4, "https://y.com/4")]
    stats = L.migration_stats(spark.createDataFrame([(1, "", False), (2, "u", True), (3, "u", False), (4, "u", False)], "k int, url string, drop boolean"), spark.createDataFrame([(3, "", 9)], "k int, publisher string, tier int"), "k", F.col("url") == "", F.col("drop"), F.lit(False), "publisher", "tier").first()
    assert (stats["input"], stats["kept"], stats["invalid_url_removed"], stats["manual_quality_removed"], stats["duplicates_removed"], stats["publisher_missing"], stats["source_tier_missing"]) == (4, 1, 1, 1, 1, 1, 1)


def test_links_and_views(spark):
    members = spark.createDataFrame([("i", "a", "2024-01-01", "2024-01-02", "부지 선정을 검토 중이다."), ("i", "b", "2024-01-05", "2024-01-06", "부지를 확정하고 착공했다."), ("j", "c", "2024-01-05", "2024-01-06", "x")], "issue string, k string, day string, briefing string, t string")
    assert {r["issue"]: r["change"] for r in L.previous_change(members, "issue", "t", "day", "briefing", "k").collect()} == {"i": "부지 선정을 검토 중이다 → 부지를 확정하고 착공했다.", "j": ""}
    mentions, registry = spark.createDataFrame([("a", "p1"), ("a", "c1"), ("b", "c1")], "k string, e string"), spark.createDataFrame([("p1", "plant"), ("c1", "company")], "e string, kind string")
    assert [(r["k"], r["entities"]) for r in L.facility_entities(mentions, registry, "k", "e", "kind").collect()] == [("a", ["p1"])]
    packs = V.material_pack(spark.createDataFrame([("i", "Issue"), ("n", "None")], "issue string, title string"), members, "issue", "title", "t", "k", "day")
    assert {r["issue"]: r["pack"] for r in packs.collect()} == {"i": "Issue\n\n[1] 부지 선정을 검토 중이다. (a)\n[2] 부지를 확정하고 착공했다. (b)", "n": "None"}
    state = spark.createDataFrame([("x", "2024-01-01"), ("y", None), ("z", "2024-01-02")], "job string, last_day string").withColumn("last_day", F.col("last_day").cast("date"))
    assert {r["job"] for r in V.briefing_guard(state, "job", F.lit("2024-01-02").cast("date")).collect()} == {"x", "y"}
    view = V.article_view(members.limit(1), {"a": F.lit(None).cast("string"), "b": F.lit(None).cast("array<string>"), "c": F.col("k")}).first()
    assert (view["a"], view["b"]) == ("", []) and V.changed_issues(spark.createDataFrame([(1, "new", 0), (2, "ongoing", 0), (3, "new", 2)], "n int, s string, p int"), "s", "p", "n").count() == 2
    assert [r["k"] for r in V.ordered(members.withColumn("pub", F.col("day")), "fifo", "k").collect()] == ["a", "b", "c"]


def test_hashes_alike_in_eight_characters_name_other_articles(spark):
    texts = [(1, ["aaaaaaaa1", "bbbbbbbb1", "bbbbbbbb2"]), (2, ["cccccccc", "aaaaaaaa", "aaaaaaaa2", "bbbbbbbb1", "bbbbbbbb2"]), (3, ["deadbeef", None]), (4, None), (5, ["bbbbbbbb2", "bbbbbbbb1"])]
    articles = spark.createDataFrame([("aaaaaaaa2",), ("bbbbbbbb1",), ("bbbbbbbb2",), ("bbbbbbbb1",), (None,)], "h string")
    got = {r["k"]: r["kept"] for r in L.evidence_of_hashes(spark.createDataFrame(texts, "k int, hashes array<string>"), "k", "hashes", articles, "h").collect()}
    assert got == {1: ["bbbbbbbb", "bbbbbbbb"], 2: ["aaaaaaaa", "bbbbbbbb"], 3: [], 4: [], 5: ["bbbbbbbb", "bbbbbbbb"]}


def test_state_files(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"promote": [{"hash8": "ABCDEF12", "date": "2024-01-01"}, {"hash": "x", "date": "2024-01-01"}], "demote": [{"hash": "abcdef1299", "date": "2024-01-01", "action": "demote"}, {"hash": "abcdef1299", "date": "soon"}]}')
    assert [(r["hash8"], r["day"], r["action"]) for r in ST.selection_overrides(spark, str(tmp_path / "o.json")).collect()] == [("abcdef12", "2024-01-01", "demote")]
    (tmp_path / "bad.json").write_text("{not json")
    assert ST.selection_overrides(spark, str(tmp_path / "bad.json")).count() == 0 == ST.selection_overrides(spark, str(tmp_path / "missing.json")).count()
    (tmp_path / "r.json").write_text('{"entities": [{"id": "a", "type": "plant", "aliases": ["x"]}, {"id": "a", "type": "company"}, {"type": "plant"}]}')
    assert [(r["id"], r["type"]) for r in ST.registry(spark, str(tmp_path / "r.json")).collect()] == [("a", "plant")]
    (tmp_path / "s.json").write_text('{"tier1": [{"name": "IAEA", "domain": "IAEA.org"}], "tier3": [{"name": "B", "rank_tier": 2, "aliases": ["Bee"]}]}')
    assert sorted((r["publisher"], r["tier"]) for r in ST.sources(spark, str(tmp_path / "s.json")).collect()) == [("B", 2), ("IAEA", 1)]
    (tmp_path / "c.json").write_text('{"h": {"countries": [" kr ", ""]}, "g": {"summary": "x"}}')
    assert [(r["hash"], r["countries"]) for r in ST.country_repairs(spark, str(tmp_path / "c.json")).collect()] == [("h", ["KR"])]
    assert ST.table_or_empty(spark, str(tmp_path / "none"), "k string").count() == 0 and ST.settings({"a": 1}, {"a": 2, "_x": 3}) == {"a": 2} and ST.settings({"a": 1}, None) == {"a": 1}
    rows = spark.createDataFrame([("b", "a", "approved", None), ("a", "b", "rejected", False), ("c", "d", "approved", None), ("e", "f", "approved", True)], "left string, right string, verdict string, disabled boolean")
    yes, no = ST.match_overrides(rows)
    assert [tuple(r) for r in yes.collect()] == [("c", "d")] and [tuple(r) for r in no.collect()] == [("a", "b")]
    assert ST.admin_store(spark, str(tmp_path / "bad.json")).first()["version"] == 0
    assert feeds.report_stats("- Reddit: 12 items\n- X: 3 items\n- Reddit: 4 items") == [("Reddit", 4), ("X", 3)]


@pytest.mark.parametrize("text", ["", "short", "a" * 40, "one\n\ntwo three four\nfive six\n\nseven", "\n\nx" * 20, "w " * 30])
def test_chunks_in_the_jvm_equal_those_of_python(spark, text):
    from tidewire.functions import text as X

    assert one(spark, X.chunks_col(F.col("t"), 16), t=text) == X.chunks(text, 16)


@pytest.mark.parametrize("url", [None, " ", "http://www.m.twitter.com/a/?ref=x&b=&c=1#z", "HTTPS://Youtu.be/v?t=1&T=2", "example.com/x?a=%20b&a=~*", "ftp://h/p//", "https://h.com?source=a&q=ü"])
def test_post_urls_in_the_jvm_equal_those_of_python(spark, url):
    from tidewire.functions import urls as U

    assert one(spark, U.post_url_col(F.col("u").cast("string")), u=url) == U.post_url(url)
