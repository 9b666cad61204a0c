import json

from pyspark.sql import functions as F

from tidewire.operators import external as E
from tidewire.sources import feeds, jsonl, sinks
from tidewire.streaming import state


def test_lenient_archive_and_logs(spark, tmp_path):
    lines = [{"hash": "a", "title": "one", "tags": ["x"], "source_tier": 2}, "not json", {"title": "no hash"}, {"hash": "b", "domain": "spam.com"}, [1], {"hash": "c"}]
    (tmp_path / "2024-01.jsonl").write_text("\n".join(x if x == "not json" else json.dumps(x) for x in lines) + "\n\n{broken")
    rows = jsonl.read_archive(spark, str(tmp_path), F.col("domain") == "spam.com").collect()
    assert {(r["hash"], tuple(r["tags"])) for r in rows} == {("a", ("x",)), ("c", ())}
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"hash": "a", "date": "2024-01-01", "score": 1}, {"record_type": "selection_stats", "date": "2024-01-01", "pipeline_status": "partial", "generated_at": "2"}, {"record_type": "selection_stats", "date": "2024-01-01", "pipeline_status": "ok", "generated_at": "1"}, {"hash": "a", "date": "2024-01-30", "score": 2}, {"date": "2024-01-30"}, {"hash": "z", "date": "2024-01-02"}]
    (log / "l.jsonl").write_text("\n".join(map(json.dumps, rows)))
    raw = jsonl.read_lines(spark, str(log), jsonl.DELIVERY)
    last = {r["hash"]: r["date"] for r in jsonl.deliveries(raw).collect()}
    assert last == {"a": "2024-01-30", "z": "2024-01-02"}
    assert [r["pipeline_status"] for r in jsonl.selection_stats(raw).collect()] == ["ok"]
    archive = jsonl.read_archive(spark, str(tmp_path / "2024-01.jsonl"))
    assert [r["hash"] for r in jsonl.delivered_window(archive, jsonl.deliveries(raw)).collect()] == ["a"]


RSS = """<rss><channel><item><title>A - Press</title><link>https://news.google.com/x</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><source>Press</source></item>
<item><title>No date</title><link>http://l</link></item><item><title>B &amp;amp; c</title><link>http://l/2</link><updated>2024-01-02T00:00:00Z</updated></item></channel></rss>"""
REPORT = "### 1. First (score 10, 2 items, sources: X, Reddit)\n- URL: http://a\n  - Evidence: one\n  - Evidence: two\n### 2. Second (score 30, 1 item, source: X)\n"


def test_parsers(spark):
    docs = spark.createDataFrame([("s", RSS), ("bad", "<rss"), ("none", None)], "source string, body string")
    got = [tuple(r) for r in feeds.parse(docs, "body", ["source"], feeds.feed_entries).collect()]
    assert got == [("s", "A", "https://news.google.com/x", "2024-01-01T00:00:00+00:00", "Press", ""), ("s", "B & c", "http://l/2", "2024-01-02T00:00:00Z", "", "")]
    board = '<tr><a href="/v?1">[보도] 제목</a><td>2024.01.02</td></tr><tr><td>2024.01.03</td></tr>'
    assert feeds.board_entries(board, "<tr>.*?</tr>", ">([^<]+)</a>", 'href="([^"]+)"', r"(\d{4}\.\d\d\.\d\d)", "http://b") == [("제목", "http://b/v?1", "2024-01-02T00:00:00+09:00", "", "")]
    assert [c[0] for c in feeds.cluster_entries(REPORT)] == ["Second", "First"] and feeds.cluster_entries(REPORT)[1][4] == "one two"
    assert len(feeds.newsletter_entries(f"<p>{'word ' * 20}<a href='http://x'>y</a></p><p>short <a href='http://z'>y</a></p>")) == 1
    j = spark.createDataFrame([('{"list":[{"BBS_SEQ":"7","TITLE":"t","REG_DATE":"2024-01-01"},{"TITLE":"x"}]}',), ("no",)], "body string")
    assert [r["link"] for r in feeds.json_board(j, "body", [], "http://b/%s").collect()] == ["http://b/7"]
    e = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "src string, n int")
    fresh, marks = feeds.above_mark(e, "n", spark.createDataFrame([("a", 5), ("c", 3)], "src string, mark int"), "src")
    assert sorted((r["src"], r["n"]) for r in fresh.collect()) == [("a", 9), ("b", 1)]
    assert {r["src"]: r["mark"] for r in marks.collect()} == {"a": 9, "b": 1, "c": 3}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("1", "u1", "t1")], "hash string, url string, title string")
    new = spark.createDataFrame([("r", "2", "u1", "t9"), ("r", "3", "u3", "t3"), ("r", "4", "u4", "t3"), ("r", "5", "u4", "t5")], "run string, hash string, url string, title string")
    assert {r["hash"] for r in sinks.new_records(new, old, ["url", "title"], ["hash"], "run").collect()} == {"3", "5"}
    assert sinks.append_once(new, new.where("hash < '4'"), ["hash"]).count() == 2
    t = spark.createDataFrame([("w1", "a", 1), ("w2", "b", 1)], "k string, body string, at int")
    up = spark.createDataFrame([("w2", "b", 2), ("w1", "z", 2), ("w3", "c", 2)], "k string, body string, at int")
    assert {tuple(r) for r in sinks.upsert(t, up, ["k"], ["body"]).collect()} == {("w1", "z", 2), ("w2", "b", 1), ("w3", "c", 2)}
    assert {r["k"] for r in sinks.keep_latest(t, "k", 1).collect()} == {"w2"}
    assert {tuple(r) for r in sinks.enrich(spark.createDataFrame([("a", ""), ("b", "x")], "k string, v string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, v string"), "k", ["v"]).collect()} == {("a", "1"), ("b", "x"), ("c", "3")}
    e = spark.createDataFrame([("a", "2024-01-01"), ("b", None), ("c", "2024-02-01")], "k string, at string")
    assert {r["k"] for r in sinks.expire(e, "at", F.lit("2024-02-03").cast("date"), 14).collect()} == {"b", "c"}
    store = spark.createDataFrame([("1", "pair", "x", False, 3)], "id string, kind string, value string, disabled boolean, version int")
    ops = spark.createDataFrame([("1", "toggle", None, None, None), ("2", "add", "k", "v", None)], "id string, op string, kind string, value string, disabled boolean")
    v, after = sinks.compare_and_set(store, 3, ops)
    assert v == 4 and {(r["id"], r["disabled"]) for r in after.collect()} == {("1", True), ("2", False)}
    path = str(tmp_path / "t")
    sinks.replace_table(t, path)
    sinks.replace_table(up, path)
    assert spark.read.parquet(path).count() == 3
    sinks.append_by_month(e, str(tmp_path / "m"), "at")
    assert {r["month"] for r in spark.read.parquet(str(tmp_path / "m")).collect()} >= {"2024-01", "2024-02"}
    items = sinks.rss_items(spark.createDataFrame([("2024-01-01", 1, "a<b", "l", None), ("2024-01-02", 1, "c", "l", "s")], "day string, rank int, title string, link string, summary string"), "day", "title", "link", "summary", days=1)
    assert "a&lt;b" not in sinks.render_rss(spark, items, "day", "T") and "<title>c</title>" in sinks.render_rss(spark, items, "day", "T")


def run_stream(spark, tmp_path, transform, batches, schema, mode="append"):
    src = tmp_path / "in"
    src.mkdir()
    df = transform(spark.readStream.schema(schema).json(str(src)))
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate(batches):
            (src / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
            q.processAllAvailable()
        return [tuple(r) for r in spark.sql("select * from out").collect()]
    finally:
        q.stop()


def test_seen_set(spark, tmp_path):
    got = run_stream(spark, tmp_path, lambda s: state.seen_once(s, "k", "at"), [[{"k": "a", "at": "2024-01-01T00:00:00"}, {"k": "a", "at": "2024-01-01T01:00:00"}], [{"k": "a", "at": "2024-01-02T00:00:00"}, {"k": "b", "at": "2024-01-02T00:00:00"}]], "k string, at timestamp")
    assert sorted(g[0] for g in got) == ["a", "b"]


def test_cool_down(spark, tmp_path):
    run = lambda k, d, n: {"q": k, "at": f"2024-01-0{d}T00:00:00", "new": n}
    batches = [[run("x", 1, 0), run("x", 2, 0), run("y", 1, 1)], [run("x", 3, 0), run("y", 2, 0)], [run("x", 4, 5)]]
    src = tmp_path / "in"
    src.mkdir()
    got = []
    for i, rows in enumerate(batches):  # each run of the job is a restart from the checkpoint
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema("q string, at timestamp, new int").json(str(src))
        q = state.cool_down(stream, "q", "at", "new").writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp"))
        q = q.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start()
        assert q.awaitTermination(120)
    assert ("x", 3, 3, "2024-01-10 00:00:00") in got and ("x", 4, 0, None) in got and ("y", 2, 1, None) in got


def test_idempotent_sink_and_admission(spark, tmp_path):
    write = state.idempotent_sink(str(tmp_path / "sink"), ["k"])
    a, b = (spark.createDataFrame(x, "k string") for x in ([("a",), ("a",)], [("a",), ("b",)]))
    for _ in range(2):
        write(a, 0)
        write(b, 1)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == ["a", "b"]
    rows = spark.createDataFrame([("rss", "2024-01-01 00:00:00"), ("search", "2024-01-01 00:00:00")], "kind string, at string").withColumn("at", F.to_timestamp("at"))
    assert [r["kind"] for r in state.admit(rows, "at", F.to_timestamp(F.lit("2024-01-01 12:00:00")), "kind", {"rss": "24 HOURS", "search": "6 HOURS"}).collect()] == ["rss"]


def test_external_functions(spark):
    rows = spark.createDataFrame([(i, f"t{i}", i / 10) for i in range(20)], "k int, t string, s double").repartition(2)

    def f(batch):
        if len(batch) > 1 and any(r["k"] == 7 for r in batch):
            raise ValueError
        return {r["k"]: {"v": r["t"].upper()} for r in batch if r["k"] != 3} | {999: {"v": "?"}}

    got = {r["k"]: r["v"] for r in E.apply_batches(rows, f, "k", "v string", size=8).collect()}
    assert got == {i: f"T{i}" for i in range(20) if i != 3}
    cache = spark.createDataFrame([(1, "t1", "p1"), (2, "old", "p1"), (4, "t4", "p0")], "k int, t string, p string")
    todo = {r["k"] for r in E.due(rows, cache, "k", "t", "p", "p1", "s", most=100).collect()}
    assert todo == set(range(20)) - {1}
    assert {r["k"] for r in E.head_groups(rows, [F.desc("s")], "k", 2, lambda head: [[19, 18], [17]]).collect()} == set(range(20)) - {18}
    assert E.head_groups(rows, [F.desc("s")], "k", 2, lambda head: 1 / 0).count() == 20
