"""Main text of HTML pages by consensus host paths.

Pass 1 scores the containers of each page (text outside links, weighed by tag and class hints) and votes for the
generalised tag-class path of the best one; votes are summed per host in Spark. Pass 2 extracts from the containers that
have the host's winning path, or from the page's own best container where it has none with text.

A page's best container gives way to the one around it while that holds enough other running text, so an article of
several blocks stays whole. Pages are read once into flat lists, without recursion and in time linear in their length:
places from which a tag is known to have no end are marked, so malformed pages cost no more than others. A "<" that
opens no tag is text, as is a tag that the page's end cuts off.

Null and empty pages give an empty text, null urls have no host and no vote, equal scores go to the first container and
equal votes to the path that sorts last. Rows, repeated ones too, and other columns are kept. No table is too small.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import cut, without
from tidewire.llm.url_filter import split_url

#: Hosts up to this number get their winning paths by broadcast (about 100 bytes each); beyond it by a shuffle join.
BROADCAST_HOSTS = 100_000
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=[\s>])))?+|=)*+)>""")
_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_SEPARATORS = re.compile(r"[\s/]*+")
_ONE = re.compile(r"""([^\s/>=][^\s/>=]*+|=)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=[\s>])))?+""")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "html", "body", "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CONTAINER = {"html", "body", "article", "main", "section", "div", "td", "center", "blockquote", "fieldset", "form", "aside", "nav", "header", "footer"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "head"} | _RAW
_KEPT = {"html", "body", "main", "article"}
#: Words of class, id and role that name what isn't the article.
_BOILERPLATE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing",
    "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "complementary", "contentinfo",
}
_HINT = {"article", "content", "main", "post", "entry", "story", "text"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


#: A container gives way to the one around it if that has at least this many other characters of running text, and this share of its own.
OTHER_TEXT, OTHER_SHARE = 25, 0.1


class Tags:
    """The tags of a source, found in time linear in its length."""

    def __init__(self, source: str):
        self.source, self.dead, self.no_end = source, None, len(source)

    def at(self, start: int) -> re.Match | None:
        """The tag that begins at this "<", if it ends anywhere."""
        if self.dead is None:
            if m := _TAG.match(self.source, start):
                return m
            if not _NAME.match(self.source, start):
                return None
            self.dead = bytearray(len(self.source) + 1)
        return _TAG.match(self.source, start) if self._ends(start) else None

    def _ends(self, start: int) -> bool:
        """Whether a tag begins here and ends. If not, marks all places of its names and separators: a tag that begins there meets the same fate."""
        if self.dead[start] or not (m := _NAME.match(self.source, start)):
            return False
        seen, at = [(start, m.end())], m.end()
        while at < len(self.source) and not self.dead[at]:
            after = _SEPARATORS.match(self.source, at).end()
            if self.source.startswith(">", after):
                return True
            seen.append((at, after))
            if not (m := _ONE.match(self.source, after)):
                break
            seen.append((after, m.end(1)))
            at = m.end()
        for a, b in seen:
            self.dead[a:b] = b"\1" * (b - a)
        return False

    def declaration(self, start: int) -> int:
        """The end of the comment, CDATA section, declaration or instruction that begins here; start if there is none."""
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if self.source.startswith(opening, start):
                end = self.source.find(closing, start + len(opening))
                return len(self.source) if end < 0 else end + len(closing)
        if self.source[start + 1 : start + 2] in ("!", "?") and start < self.no_end:
            end = self.source.find(">", start)
            if end >= 0:
                return end + 1
            self.no_end = start
        return start


class Page:
    """tag, parent, label, skip, link, container and article of each element; texts: (element, block, text) in page order."""

    def __init__(self, source: str):
        self.parent, self.label, self.skip, self.link, self.container, self.tag, self.article = [-1], [""], [False], [False], [0], [""], [False]
        self.texts: list[tuple[int, int, str]] = []
        stack, block, at, n = [0], 0, 0, len(source)
        open_count: dict[str, int] = {}
        tags = Tags(source)

        def close(k: int) -> None:
            nonlocal block
            for i in stack[k:]:
                open_count[self.tag[i]] -= 1
                block += self.tag[i] in _BLOCK
            del stack[k:]

        while at < n:
            start = source.find("<", at)
            start = n if start < 0 else start
            if start > at:
                self.texts.append((stack[-1], block, source[at:start]))
            if start == n:
                break
            m = tags.at(start)
            if m is None:
                at = tags.declaration(start)
                if at == start:
                    self.texts.append((stack[-1], block, "<"))
                    at += 1
                elif source.startswith("<![CDATA[", start):
                    self.texts.append((stack[-1], block, source[start + 9 : at].removesuffix("]]>")))
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if open_count.get(tag, 0) > 0:
                    k = len(stack) - 1
                    while self.tag[stack[k]] != tag:
                        k -= 1
                    close(k)
                elif tag in _BLOCK:
                    block += 1
                continue
            if tag in _BLOCK and tag != "html" and tag != "body" and open_count.get("p", 0) > 0:
                k = len(stack) - 1  # a block ends an open paragraph of the same container
                while self.tag[stack[k]] != "p" and self.tag[stack[k]] not in _CONTAINER and k:
                    k -= 1
                if self.tag[stack[k]] == "p":
                    close(k)
            if tag in _CLOSES:
                k = len(stack) - 1
                while k and self.tag[stack[k]] not in _CLOSES[tag] and self.tag[stack[k]] not in ("ul", "ol", "dl", "table", "tbody", "select") and self.tag[stack[k]] not in _CONTAINER - {"td"}:
                    k -= 1
                if self.tag[stack[k]] in _CLOSES[tag]:
                    close(k)
            block += tag in _BLOCK
            if tag in _VOID:
                if tag == "br":
                    self.texts.append((stack[-1], block, " "))
                continue
            i, up = len(self.parent), stack[-1]
            names = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
            label = tag + "".join(sorted("." + _DIGITS.sub("#", x) for x in set(names.get("class", "").split())))
            said = {w.lower() for w in _WORDS.findall(" ".join(names.get(a, "") for a in ("class", "id", "role")))}
            hidden = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
            own = self.article[up]
            if own:  # an article's own head is part of it
                said.discard("header")
            self.article.append(own or tag == "article")
            self.parent.append(up)
            self.tag.append(tag)
            self.label.append(label)
            self.skip.append(self.skip[up] or tag in _DROPPED and not (own and tag == "header") or tag not in _KEPT and (hidden or bool(said & _BOILERPLATE)))
            self.link.append(self.link[up] or tag == "a")
            self.container.append(i if tag in _CONTAINER else self.container[up])
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else n
            elif not m[3].endswith("/") or tag in _BLOCK or tag == "a":
                stack.append(i)
                open_count[tag] = open_count.get(tag, 0) + 1

    def path(self, i: int) -> str:
        out = []
        while i > 0:
            out.append(self.label[i])
            i = self.parent[i]
        return ">".join(reversed(out))

    def best(self) -> tuple[int, float]:
        """The container of the highest score, the first of equals; 0 and 0.0 if no text is outside what is dropped."""
        scores: dict[int, float] = {}
        for i, _, text in self.texts:
            if not self.skip[i] and (size := len(text.strip())):
                c = self.container[i]
                worth = -size if self.link[i] else size
                scores[c] = scores.get(c, 0.0) + worth
                if c:
                    up = self.container[self.parent[c]]
                    scores[up] = scores.get(up, 0.0) + worth / 2
        for c in scores:
            words = {w.lower() for w in _WORDS.findall(self.label[c])}
            scores[c] *= 2.0 if words & _HINT else 1.0
        c = min(scores, key=lambda c: (-scores[c], c), default=0)
        score = scores.get(c, 0.0)
        return (self._around(c) if score else c), score

    def _around(self, c: int) -> int:
        """c, or the container around it that holds enough other running text; never beyond an article or main element."""
        total = [0] * len(self.parent)  # characters below each element, less those of links
        for i, _, text in self.texts:
            if not self.skip[i]:
                total[i] += len(text.strip()) * (-1 if self.link[i] else 1)
        for i in range(len(total) - 1, 0, -1):
            total[self.parent[i]] += total[i]
        at = c
        while at > 0 and self.tag[at] not in ("article", "main", "body"):
            at = self.container[self.parent[at]]
            if total[at] - total[c] >= max(OTHER_TEXT, OTHER_SHARE * total[c]):
                c = at
        return c

    def text(self, roots: set[int]) -> str:
        inside = [False] * len(self.parent)
        for i in range(len(self.parent)):
            inside[i] = i in roots or i > 0 and inside[self.parent[i]]
        blocks: list[list] = []
        for i, block, text in self.texts:
            if inside[i] and not self.skip[i]:
                if not blocks or blocks[-1][0] != block:
                    blocks.append([block, []])
                blocks[-1][1].append(text)
        lines = (" ".join(html.unescape("".join(parts)).split()) for _, parts in blocks)
        return "\n".join(x for x in lines if x)

    def with_path(self, path: str) -> set[int]:
        """Elements of this path; elements inside them don't count again."""
        want = path.split(">")
        depth = [0] * len(self.parent)
        out: set[int] = set()
        for i in range(1, len(self.parent)):
            up = self.parent[i]
            ok = depth[up] >= 0 and depth[up] < len(want) and self.label[i] == want[depth[up]]
            depth[i] = depth[up] + 1 if ok else -1
            if depth[i] == len(want):
                out.add(i)
        return out


def extract(source: str | None, path: str | None = None) -> str:
    """The main text: of the containers with this path, if they have any, else of the best container."""
    page = Page(source or "")
    if path and (found := page.with_path(path)) and (text := page.text(found)):
        return text
    return page.text({page.best()[0]})


def vote(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path) -> the winning path of each host: most pages, then the highest score, then the path's order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for host, text in zip(*batch.columns, strict=True):
                page = Page(text.as_py())
                best, score = page.best()
                if best:
                    rows.append((host.as_py(), page.path(best), score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], names=["host", "path", "score"])

    host = split_url(F.col(url))[0]
    votes = pages.select(host.alias("host"), F.col(source).alias("h")).where("host <> '' and h is not null").mapInArrow(run, "host string, path string, score double")
    summed = votes.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum(F.round("score")).alias("score"))
    return summed.groupBy("host").agg(F.max(F.struct("pages", "score", "path")).alias("best")).select("host", "best.path")


def extract_text(pages: DataFrame, url: str = "url", source: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of every row's whole page; empty if there is none. Null html is empty, a null url has no host
    and so no vote. Rows are kept, repeated ones too; a column of the new name is replaced."""
    pages = without(pages, out)
    winners = cut(vote(pages, url, source), "paths")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    named = pages.withColumn("__host", split_url(F.col(url))[0])
    joined = named.join(winners.select(F.col("host").alias("__host"), F.col("path").alias("__path")), "__host", "left").drop("__host")
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])
    place, names = pages.columns.index(source), schema.names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                texts = [extract(h.as_py(), p.as_py()) for h, p in zip(batch.column(place), batch.columns[-1], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=names)

    return joined.mapInArrow(run, schema)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Every page with its main text; see extract_text for nulls, repeated rows and malformed pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
