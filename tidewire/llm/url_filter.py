"""URL filtering by a bit-parallel wildcard automaton.

All rules run at once over each canonical URL: every pattern is a run of bits in a
multiword Shift-And mask, one step per character, vectorised over the URLs of a batch.

Canonical form: "." + host + path, where the host stands after the first "://" up to "/", "?", "#"
or the end (A-Z lower-cased) and the path goes on up to "?", "#" or the end. A null url, or one without
"://", has an empty host and path; only rules that fit the lone "." could match it.

Pattern syntax: "*" any run of characters, "?" any one character, "^" any run of characters without "/".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the query's contract (verdict, host, path).
CONTRACT_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Site patterns that decide where no host rule fits; the pattern is matched against the canonical form.
SITE_GLOBS = (
    ("block", "^casino^"),
    ("block", "^.free-bets.^"),
    ("block", "^.adult-?.^"),
    ("block", "^.spam-farm.^"),
    ("block", "*/click?track*"),
)


@dataclass(frozen=True)
class Rule:
    """verdict is allow or block; text is what reports name; length orders rules, the longest that fits wins."""

    verdict: str
    pattern: str
    text: str
    length: int
    named: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the url's path starts with path."""
    return Rule(verdict, f"^.{host}{path}*", f"{host}{path}", len(host) + len(path), True)


def glob_rule(verdict: str, pattern: str) -> Rule:
    if pattern[:1] not in ("*", "^"):
        pattern = f"^.{pattern}"
    if pattern[-1:] != "*":
        pattern += "*"
    return Rule(verdict, pattern, pattern, sum(c not in "*^?" for c in pattern), False)


def production_rules() -> list[Rule]:
    return [host_rule(*r) for r in CONTRACT_RULES] + [glob_rule(*g) for g in SITE_GLOBS]


class ShiftAnd:
    """The rules' automaton: a start bit and one bit for each literal per pattern, packed into 64-bit words.

    Characters above U+007F share one code that only "?", "*" and "^" match, so rules are ASCII.
    """

    def __init__(self, patterns: list[str]):
        steps: list[list[tuple[str, set[str]]]] = []
        for p in patterns:
            if not p.isascii():
                raise ValueError(f"patterns are ASCII: {p!r}")
            states: list[tuple[str, set[str]]] = [("", set())]
            for c in p:
                if c in "*^":
                    states[-1][1].add(c)
                else:
                    states.append((c, set()))
            steps.append(states)
        bits = sum(map(len, steps))
        self.words = max(1, -(-bits // 64))
        self.patterns = len(patterns)
        self.start = np.zeros(self.words, np.uint64)
        self.match = np.zeros((129, self.words), np.uint64)
        self.loop = np.zeros((129, self.words), np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        slash = ord("/")
        for states in steps:
            for k, (c, loops) in enumerate(states):
                word, bit = divmod(at, 64)
                one = np.uint64(1) << np.uint64(bit)
                if k == 0:
                    self.start[word] |= one
                elif c == "?":
                    self.match[:, word] |= one
                else:
                    self.match[ord(c), word] |= one
                if "*" in loops:
                    self.loop[:, word] |= one
                elif "^" in loops:
                    self.loop[:slash, word] |= one
                    self.loop[slash + 1 :, word] |= one
                if k == len(states) - 1:
                    self.final.append((word, one))
                at += 1

    def accepts(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each pattern."""
        n = len(texts)
        out = np.zeros((n, self.patterns), bool)
        if not n:
            return out
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        ends = lengths[order]
        flat = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le"), "<u4")
        flat = np.minimum(flat, 128).astype(np.uint8)
        begins = np.concatenate([[0], np.cumsum(ends)[:-1]])
        states = np.repeat(self.start[None, :], n, axis=0)
        one, last = np.uint64(1), np.uint64(63)
        live = n
        for at in range(int(ends[0])):
            live = int(np.searchsorted(-ends[:live], -at, side="left"))  # the texts longer than at
            codes = flat[begins[:live] + at]
            now = states[:live]
            moved = now << one
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> last
            states[:live] = (moved & self.match[codes]) | (now & self.loop[codes])
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (states[:, word] & bit) != 0
        return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path by the rules at the top of this module."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule, verdict, fits to every row.

    Among the host rules that fit, the longest (then the first listed) gives rule and verdict. Where none
    fits, rule is null and the longest glob that fits decides, else default. fits lists all rules that fit.
    Rows are kept as they are, repeated ones too; null urls get the default. Columns of these names are replaced. Equal
    lengths go to the rule listed first. Long urls cost as many steps as characters, in memory of a batch. No rows give no rows.
    """
    rules = production_rules() if rules is None else rules
    machine = ShiftAnd([r.pattern for r in rules])
    order = sorted(range(len(rules)), key=lambda k: (not rules[k].named, -rules[k].length, k))

    @F.pandas_udf("rule string, verdict string, fits array<string>")
    def judged(canonical: pd.Series) -> pd.DataFrame:
        got = machine.accepts(canonical.tolist())
        rows = []
        for row in got:
            fits = [k for k in order if row[k]]
            best = fits[0] if fits else None
            rows.append((rules[best].text if best is not None and rules[best].named else None, default if best is None else rules[best].verdict, [rules[k].text for k in fits]))
        return pd.DataFrame(rows, columns=["rule", "verdict", "fits"])

    host, path = split_url(F.col(url))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "fits")]
    named = pages.withColumns({"__host": host, "__path": path})
    return named.withColumn("__j", judged(F.concat(F.lit("."), "__host", "__path"))).select(*(F.col(f"`{c}`") for c in kept), F.col("__host").alias("host"), F.col("__path").alias("path"), "__j.rule", "__j.verdict", "__j.fits")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict by the production rules; urls of any length take one step per character."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), rules(verdict, h, r) AS (
  VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')
), fit AS (
  SELECT page_id, h || r AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || r) DESC) AS k
  FROM (SELECT DISTINCT page_id, host, path FROM p) p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r)
)
SELECT p.page_id, p.host, p.path, fit.rule,
  CASE WHEN fit.verdict IS NOT NULL THEN fit.verdict
       WHEN host LIKE '%casino%' OR contains('.' || host, '.free-bets.') OR contains('.' || host, '.spam-farm.')
         OR regexp_matches('.' || host, '\.adult-[^/]\.') OR regexp_matches(path, '/click.track') THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND fit.k = 1
"""
