import base64
import hashlib

import pytest

from tidewire.llm import warc


def test_arc_versions_declared_lengths_and_dates():
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nline\n\nfiledesc://x 0 0 0 3\n"
        records = [warc.arc_record(f"http://x/{i}", body * i, version, 0, "n") for i in range(4)]
        plain = warc.arc_opening("n", version) + b"".join(records)
        zipped = warc.member(warc.arc_opening("n", version)) + b"".join(map(warc.member, records))
        for data in (plain, zipped):
            got = list(warc.parse_arc(data, "n"))
            assert [(h["URL"], c) for _, h, c in got] == [(f"http://x/{i}", body * i) for i in range(4)]
            assert len(got[0][1]) == (5 if version == 1 else 10)
            assert len({o for o, _, _ in got}) == 4
        with pytest.raises(ValueError):
            list(warc.parse_arc(plain[:-5], "n"))
    assert warc.warc_date("199607011234") == "1996-07-01T12:34:00Z"


def test_warc_round_trip():
    block = warc.http_response(5, "é\r\n\r\nx".encode())
    header = {"URL": "http://x", "IP-address": "0.0.0.0", "Archive-date": warc.CRAWLED}
    data = warc.member(warc.convert_record("f", 1, header, block, None)) + warc.member(warc.convert_record("f", 2, header, block, "<urn:uuid:1>"))
    (h1, b1), (h2, b2) = warc.parse_warc(data)
    assert b1 == block and h1["warc-type"] == "response" and h2["warc-type"] == "revisit"
    assert warc.split_http(b2)[1]["content-length"] == str(len("é\r\n\r\nx".encode())) and h1["warc-record-id"] != h2["warc-record-id"]


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, f"http://x y/{i}", ["", None, "<p>é\n</p>", "b" * 70000, f"own {i}"][i % 5]) for i in range(60)]
    rows += [(7, None, "twice"), (7, None, "twice"), (None, "", "null id"), (None, "u", None), (1000, "u", "\x00\r\n\r\nz")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in warc.op5_warc(spark, str(tmp_path)).collect()), key=str)
    want, first = [], {}
    for k, (i, _, h) in enumerate(rows):
        first.setdefault(h or "", []).append((-1 if i is None else i, k))
    for k, (i, _, h) in enumerate(rows):
        best = max(first[h or ""])
        is_best = best == (-1 if i is None else i, k)
        want.append((i, len((h or "").encode()), digest(h), "response" if is_best else "revisit", None if is_best else best[0]))
    assert got == sorted(want, key=str)


def test_minimum_size_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.read_warc(warc.archive(spark, pages, revisit_from=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    pages.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op5_warc(spark, str(tmp_path)).count() == 0
