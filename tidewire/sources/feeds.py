"""Parsers of fetched documents: RSS and Atom, HTML and JSON boards, newsletters, cluster reports. Fetching is the caller's.

Input is a DataFrame with the document in a column; output has one row for each entry. A document that can't be parsed
gives no rows and never fails the others.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import split_outlet

ENTRY = "title string, link string, published string, publisher string, summary string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _time(text: str) -> str | None:
    text = (text or "").strip()
    try:
        return parsedate_to_datetime(text).isoformat()
    except (ValueError, TypeError):
        return text if re.match(r"\d{4}-\d{2}-\d{2}", text) else None


def feed_entries(document: str | None, most: int = 1000) -> list[tuple]:
    """Entries with a title, a link and a date; published before updated."""
    try:
        root = ET.fromstring((document or "").strip())
    except ET.ParseError:
        return []
    out = []
    for node in root.iter():
        if _local(node.tag) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for x in node:
            name = _local(x.tag)
            value = x.get("href") if name == "link" and x.get("href") else "".join(x.itertext())
            got.setdefault(name, html.unescape(value or "").strip())
        when = next((t for n in ("pubdate", "published", "date", "updated") if (t := _time(got.get(n, "")))), None)
        if not (got.get("title") and got.get("link") and when):
            continue
        title, publisher = split_outlet(got["title"], got.get("source", "")) if "news.google." in got["link"] or got.get("source") else (got["title"], "")
        out.append((title, got["link"], when, publisher, re.sub(r"<[^>]*>", " ", got.get("description") or got.get("summary") or "").strip()))
        if len(out) == most:
            break
    return out


def board_entries(document: str | None, row: str, title: str, link: str, day: str, base: str) -> list[tuple]:
    """Rows of an HTML board by patterns with one group each; rows without title, link or day are skipped."""
    out = []
    for m in re.finditer(row, document or "", re.S | re.I):
        t, a, d = (re.search(p, m[0], re.S | re.I) for p in (title, link, day))
        if t and a and d:
            text = re.sub(r"^(\s*\[[^\]]{1,12}\])+", "", re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", t[1])))).strip()
            out.append((text, base + a[1], f"{re.sub(r'[./]', '-', d[1])}T00:00:00+09:00", "", ""))
    return out


class _Blocks(HTMLParser):
    """Text and links of each run of a page between ends of block elements."""

    ENDS = {"p", "td", "li", "div", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[str, list[str]]] = []
        self.text: list[str] = []
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.text.append(" ")
        self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        self.text.append(" ")
        if tag in self.ENDS:
            self.flush()

    def handle_data(self, data):
        self.text.append(data)

    def flush(self):
        self.done.append((" ".join("".join(self.text).split()), self.links))
        self.text, self.links = [], []


#: Parts of links in newsletters that lead to no article.
NO_ARTICLE = ("unsubscribe", "mailto:", "facebook.com", "twitter.com", "linkedin.com", "instagram.com", "preferences", "viewinbrowser", "view-in-browser")


def newsletter_entries(document: str | None, least: int = 60, most: int = 25) -> list[tuple]:
    """Blocks of a newsletter with an article's link and at least `least` characters, at most `most`; a block's last link counts."""
    blocks = _Blocks()
    blocks.feed(document or "")
    blocks.flush()
    good = ((text, links[-1].strip()) for text, links in blocks.done if links and len(text) >= least)
    return [(text, link, None, "", "") for text, link in good if link.lower().startswith("http") and not any(x in link.lower() for x in NO_ARTICLE)][:most]


_REPORT_LINES = (
    ("head", re.compile(r"^###\s+\d+\.\s+(?P<title>.+?)\s+\(score\s+(?P<score>\d+),[^)]*?sources?:\s*(?P<sources>[^)]*)\)", re.I)),
    ("url", re.compile(r"^\s*-\s+URL:\s+(?P<value>\S+)")),
    ("note", re.compile(r"^\s*-\s+Evidence:\s+(?P<value>.+?)\s*$")),
    ("stat", re.compile(r"^\s*-\s+(?P<source>[A-Za-z][\w ]*):\s+(?P<count>\d+)\s+items?\b")),
)


def report_lines(document: str | None) -> Iterator[tuple[str, dict[str, str]]]:
    """The lines of a markdown report that say something, with what they say."""
    for line in (document or "").splitlines():
        for kind, pattern in _REPORT_LINES:
            if m := pattern.match(line):
                yield kind, m.groupdict()
                break


def cluster_entries(document: str | None, evidence: int = 3000) -> list[tuple]:
    """Clusters of a markdown report (title, score, sources, url, evidence), the highest score first; lines before the first head belong to none."""
    found: list[dict] = []
    for kind, said in report_lines(document):
        if kind == "head":
            found.append({"title": said["title"].strip(), "score": int(said["score"]), "sources": [x for s in said["sources"].split(",") if (x := s.strip())], "url": [], "note": []})
        elif found and kind in found[-1]:
            found[-1][kind].append(said["value"].strip())
    ranked = sorted(found, key=lambda c: c["score"], reverse=True)
    return [(c["title"], c["score"], c["sources"], next(iter(c["url"]), None), " ".join(c["note"])[:evidence]) for c in ranked]


def report_stats(document: str | None) -> list[tuple]:
    """(source, items) of a report's statistics lines, the last of a source."""
    return list({said["source"]: int(said["count"]) for kind, said in report_lines(document) if kind == "stat"}.items())


def parse(documents: DataFrame, column: str, keep: list[str], parser: Callable[[str | None], list[tuple]], schema: str = ENTRY) -> DataFrame:
    """Rows of `keep` with each entry of the parser; documents are parsed in Arrow batches."""
    names = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", schema)]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*keep).schema)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(*r[:-1], *e) for r in pdf[[*keep, column]].itertuples(index=False, name=None) for e in parser(r[-1])]
            yield pd.DataFrame(rows, columns=[*keep, *names])

    return documents.select(*keep, column).mapInPandas(run, f"{kept}, {schema}" if kept else schema)


def json_board(documents: DataFrame, column: str, keep: list[str], template: str) -> DataFrame:
    """Rows of a JSON board {list: [{BBS_SEQ, TITLE, REG_DATE}]}; the link is the template with the number."""
    got = F.from_json(column, "list array<struct<BBS_SEQ:string,TITLE:string,REG_DATE:string>>")
    rows = documents.select(*keep, F.explode(got["list"]).alias("r")).where("r.BBS_SEQ is not null and r.TITLE is not null and r.REG_DATE is not null")
    return rows.select(*keep, F.col("r.TITLE").alias("title"), F.format_string(template, "r.BBS_SEQ").alias("link"), F.col("r.REG_DATE").alias("published"))


def above_mark(entries: DataFrame, number: str, marks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Entries above each source's high-water mark, and the new marks, which are taken before any other filter."""
    fresh = entries.join(F.broadcast(marks), key, "left").where(F.col(number) > F.coalesce("mark", F.lit(0)))
    new = entries.groupBy(key).agg(F.max(number).alias("__m")).join(marks, key, "full").select(key, F.greatest("__m", "mark").alias("mark"))
    return fresh.drop("mark"), new
