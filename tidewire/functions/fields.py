"""Projections of a record: what is shown for publisher, link, section, countries, reasons, stages and lines of change."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import gates as G
from tidewire.functions import text as X

#: Hosts of home sections, legacy country buckets, scopes that are no countries.
HOME_HOSTS = (".kr", "khnp", "nssc", "motie", "kaeri", "kins", "korad", "yna", "korea")
LEGACY_BUCKETS = ("EU_ETC", "OTHER")
NO_COUNTRY = ("OTHER", "UNSPECIFIED", "GLOBAL", "EUROPE", "EU")
#: Badges of events.
EVENT_BADGES = {
    "policy_decision": "정책 결정", "regulatory_action": "규제 조치", "contract_award": "계약 체결", "project_milestone": "사업 진전",
    "incident_safety": "안전 사건", "corporate_move": "기업 동향", "research_report": "연구·보고서", "market_signal": "시장 신호",
}
#: Stages of an event by pattern, and what makes a statement tentative or final.
STAGES = {
    "mou": "mou|moa|양해각서", "agreement": "협약|합의|계약|서명", "approval": "승인|허가|인가|의결", "review": "검토|심사|심의|평가", "construction": r"착공|건설\s*(?:시작|개시)", "grid": "(?:전력망|계통).{0,8}(?:연결|접속)",
    "criticality": r"(?:첫\s*)?임계", "operation": r"상업\s*운전|가동\s*(?:개시|시작)", "shutdown": "(?:가동|운전).{0,8}(?:중단|정지)", "launch": "출범|설립", "declaration": "선포|공표",
}
TENTATIVE, FINAL = r"검토|예정|계획|전망|가능성|수\s*있", "최종|공식|결정|의결|체결|서명|달성|개시|시작|선포"
#: Endings that join clauses, and what they become where a clause ends the sentence.
CLAUSE_ENDS = (("고 있으며", "고 있습니다."), ("해 왔으며", "해 왔습니다."), ("했으며", "했습니다."), ("됐으며", "됐습니다."), ("였으며", "였습니다."), ("이며", "입니다."), ("하고", "했습니다."), ("되고", "됐습니다."), ("되어", "됐습니다."))
def filled(*columns: Column) -> Column:
    """The first that is neither null nor blank, else ''."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))


def display_publisher(publisher: Column, site_name: Column) -> Column:
    """A page's own name stands in for a publisher that is blank or a host."""
    site, p = F.trim(F.coalesce(site_name, F.lit(""))), F.coalesce(publisher, F.lit(""))
    return F.when((site != "") & ((F.trim(p) == "") | G.looks_like_host(p)), site).otherwise(p)


def display_url(resolved: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(resolved), F.lit("")), url, F.lit(""))


def default_section(host: Column, title: Column) -> Column:
    """Section of a record that has none: by the host, then by Hangul in the title."""
    h = F.lower(F.coalesce(host, F.lit("")))
    home = F.exists(F.array(*map(F.lit, HOME_HOSTS)), lambda x: F.contains(h, x))
    return F.when(home, F.when(F.contains(h, F.lit("khnp")), "khnp").otherwise("domestic")).when(F.coalesce(title, F.lit("")).rlike("[가-힣]"), "domestic").otherwise("international")


def taxonomy_text(*columns: Column) -> Column:
    """What topics and countries are read from, in lower case; arrays are joined by blanks by the caller."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns)))


def source_identity(publisher: Column, host: Column, key: Column) -> Column:
    """One key for all articles of an outlet: the publisher, else the host; an aggregator's article stands for itself."""
    p = G.search_key(publisher)
    h = F.lower(F.coalesce(host, F.lit("")))
    return F.when(p != "", F.concat(F.lit("pub:"), p)).when((h == "") | F.contains(h, F.lit("news.google.")), F.concat(F.lit("hash:"), key)).otherwise(F.concat(F.lit("dom:"), h))


def countries_of_text(text: Column, rules: dict[str, tuple[list[str], list[str]]], european: list[str], union: list[str], europe: list[str], world: list[str]) -> Column:
    """Codes that a text in lower case names by needle or by whole ASCII token, in the order of the rules, at most two.

    More than two become EUROPE if all are European, else GLOBAL; EU follows where one of its bodies is named; without
    any, the words for Europe or the world count.
    """
    empty = F.array().cast("array<string>")

    def hits(needles: list[str], tokens: list[str]) -> Column:
        by_token = text.rlike("(?<![a-z0-9])(" + "|".join(re.escape(t) for t in tokens) + ")(?![a-z0-9])") if tokens else F.lit(False)
        return G._any(text, needles) | by_token

    named = F.array_compact(F.array(*(F.when(hits(*r), F.lit(code)) for code, r in rules.items()))) if rules else empty
    wide = F.when(F.size(F.array_except(named, F.array(*map(F.lit, european)) if european else empty)) == 0, "EUROPE").otherwise("GLOBAL")
    scopes = F.when(F.size(named) > 2, F.array(wide)).otherwise(named)
    scopes = F.when(G._any(text, union), F.concat(scopes, F.array(F.lit("EU")))).otherwise(scopes)
    return F.when(F.size(scopes) > 0, F.slice(F.array_distinct(scopes), 1, 2)).when(G._any(text, europe), F.array(F.lit("EUROPE"))).when(G._any(text, world), F.array(F.lit("GLOBAL"))).otherwise(empty)


def countries(repair: Column, native: Column, of_text: Column, region: Column, names_union: Column, alias: dict[str, str], home: str = "KR") -> Column:
    """struct(values, source): a repair, else the record's own codes (old buckets and a loose EU are read anew), else those of the text."""
    empty = F.array().cast("array<string>")
    raw = F.filter(F.transform(F.coalesce(native, empty), lambda c: F.upper(F.trim(c))), lambda c: c != "")
    table = F.create_map(*(F.lit(x) for kv in alias.items() for x in kv)) if alias else None
    norm = F.transform(raw, lambda c: F.coalesce(F.try_element_at(table, c), c)) if alias else raw
    some = lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit("UNSPECIFIED")))
    legacy = F.arrays_overlap(raw, F.array(*map(F.lit, LEGACY_BUCKETS)))
    loose = F.array_contains(norm, F.lit("EU")) & ~names_union
    kept = F.slice(F.array_distinct(norm), 1, 2)
    answer = lambda values, source: F.struct(values.alias("values"), source.alias("source"))
    fallback = F.when(F.size(of_text) > 0, of_text).when(region == "domestic", F.array(F.lit(home))).otherwise(F.array(F.lit("UNSPECIFIED")))
    return (
        F.when(F.size(F.coalesce(repair, empty)) > 0, answer(repair, F.lit("manual-repair")))
        .when((F.size(raw) > 0) & legacy, answer(some(of_text), F.lit("legacy-refined-v2")))
        .when((F.size(raw) > 0) & loose, answer(some(F.slice(F.array_distinct(F.concat(F.array_remove(norm, "EU"), of_text)), 1, 2)), F.lit("eu-refined-v2")))
        .when(F.size(raw) > 0, answer(kept, F.when(kept == F.slice(F.array_distinct(raw), 1, 2), "native").otherwise("native-normalized-v2")))
        .otherwise(answer(fallback, F.lit("heuristic-v2")))
    )


def selection_reasons(delivered: Column, parts: Column, score: Column, role: Column, source_type: Column) -> Column:
    """At most two badges: the strongest event's, then one of six about source, relevance, policy or evidence; else a general one."""
    labels = F.create_map(*(F.lit(x) for kv in EVENT_BADGES.items() for x in kv))
    at = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(0.0))
    events = F.filter(F.map_entries(parts), lambda e: e["key"].startswith("event:") & F.try_element_at(labels, F.substring(e["key"], 7, 100)).isNotNull())
    ranked = F.array_max(F.transform(events, lambda e: F.struct(e["value"].alias("v"), F.element_at(labels, F.substring(e["key"], 7, 100)).alias("l"))))
    second = (
        F.when(role == "primary", "공식 원문").when((source_type == "specialist_media") & (at("source_tier1") > 0), "전문 매체").when(at("korea_relevance") >= 2.4, "국내 관련성 높음")
        .when(at("policy_materiality") >= 2, "정책 영향 큼").when(at("evidence_strength") >= 1.6, "근거 강도 높음")
    )
    found = F.array_distinct(F.array_compact(F.array(ranked["l"], second)))
    general = F.when(score.isNotNull(), F.array(F.lit("브리핑 우선순위"))).otherwise(F.array().cast("array<string>"))
    return F.when(~F.coalesce(delivered, F.lit(False)), F.array().cast("array<string>")).when(F.size(found) > 0, F.slice(found, 1, 2)).otherwise(general)


def stage_signature(c: Column) -> Column:
    """struct(stages, certainty): the stages of an event that a sentence names, and whether it is tentative or final."""
    low = F.lower(F.coalesce(c, F.lit("")))
    stages = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(k)) for k, p in STAGES.items())))
    return F.struct(stages.alias("stages"), F.when(low.rlike(TENTATIVE) & ~low.rlike(FINAL), "tentative").otherwise("final").alias("certainty"))


def restatement(before: Column, after: Column, threshold: float = 0.45) -> Column:
    """The same facts again, by words, by containment, or by a like sentence about the same stage; never across stages or certainty."""
    a, b = X.words(before), X.words(after)
    s, t = stage_signature(before), stage_signature(after)
    staged = (F.size(s["stages"]) > 0) & (F.size(t["stages"]) > 0)
    same = (s["stages"] == t["stages"]) & (s["certainty"] == t["certainty"])
    both = F.size(F.array_intersect(a, b))
    alike = (both >= threshold * F.size(F.array_union(a, b))) | (X.containment(a, b) >= 0.8)
    plain = lambda c: X.loose_key(F.replace(F.coalesce(c, F.lit("")), F.lit("양해각서"), F.lit("mou")))
    close = (F.size(s["stages"]) > 0) & same & ((X.containment(a, b) >= 0.35) | (X.ratio(plain(before), plain(after)) >= 0.4))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), True).when(staged & ~same, False).otherwise(alike | close)


def split_interpretation(implication: Column, why: Column) -> Column:
    """struct(implication, why_important): hollow ones go; of two that restate each other the longer stays."""
    i, w = G.without_hollow(implication), G.without_hollow(why)
    twice = (i != "") & (w != "") & restatement(i, w)
    return F.struct(F.when(twice & (F.length(w) > F.length(i)), "").otherwise(i).alias("implication"), F.when(twice & (F.length(w) <= F.length(i)), "").otherwise(w).alias("why_important"))


def takeaway(direction: Column, most: int = 86, least: int = 28) -> Column:
    """The first sentence; a longer one than `most` gives its first clause, ended, if that has an ending that can be and fits; else it stays whole."""
    first = F.coalesce(F.get(F.split(F.trim(F.regexp_replace(F.coalesce(direction, F.lit("")), r"(?U)\s+", " ")), r"(?<=[.!?])\s+"), F.lit(0)), F.lit(""))
    clause = F.trim(F.regexp_extract(first, "^[^,;]*", 0))
    ended = F.coalesce(*(F.when(clause.endswith(a), F.concat(F.substring(clause, F.lit(1), F.length(clause) - len(a)), F.lit(b))) for a, b in CLAUSE_ENDS))
    return F.when((F.length(first) > most) & (F.length(clause) >= least) & (F.length(ended) <= most), ended).otherwise(first)


def clause_cut(c: Column, most: int) -> Column:
    """At most `most` characters, cut behind the last comma or blank that fits, with an ellipsis."""
    head = F.substring(c, 1, most - 1)
    at_comma = F.regexp_extract(head, r"^(.*[,，·;])", 1)
    at_blank = F.regexp_extract(head, r"^(.*)\s", 1)
    cut = F.when(F.length(at_comma) >= most / 2, F.regexp_replace(at_comma, r"[,，·;]$", "")).when(at_blank != "", at_blank).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def change_line(previous: Column, current: Column, most: int = 200, before_least: int = 30) -> Column:
    """'before → now.' in at most `most` characters; '' without a previous state, or where nothing has changed.

    What is too long is clipped from the earlier state first, but not below `before_least` characters.
    """
    bare = lambda c, n: F.regexp_replace(F.trim(takeaway(c, n)), "[.!?]+$", "")
    b, a = bare(previous, 48), bare(current, 112)
    room = most - 4
    over = F.length(b) + F.length(a) > room
    budget = F.greatest(F.lit(before_least), room - F.length(a))
    clip = lambda c, n: F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, F.lit(1), F.greatest(F.lit(1), n - 1).cast("int"))), F.lit("…")))
    b2 = F.when(over, clip(b, budget)).otherwise(b)
    a2 = F.when(F.length(b2) + F.length(a) > room, clip(a, room - F.length(b2))).otherwise(a)
    return F.when((b == "") | (a == "") | restatement(b, a), "").otherwise(F.concat(b2, F.lit(" → "), a2, F.lit(".")))


def without_org(title: Column, *orgs: Column) -> Column:
    """A title without the leading '... (ORG)' whose bracket holds an organisation's acronym, if anything is left behind it."""
    t = F.trim(F.coalesce(title, F.lit("")))
    names = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(o, F.lit("")), F.lit(r"([A-Z]{2,})"), F.lit(1)) for o in orgs))))
    inside, rest = F.regexp_extract(t, r"^[^()]{0,40}\(([^()]{1,40})\)", 1), F.trim(F.regexp_extract(t, r"^[^()]{0,40}\([^()]{1,40}\)\s*[:·\-–—]?\s*(.*)$", 1))
    return F.when((inside != "") & F.exists(names, lambda n: F.contains(inside, n)) & (rest != ""), rest).otherwise(t)


def publication_id(url: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(url, F.lit(""))), 1, 12)


def date_in_text(c: Column) -> Column:
    """The first date of a text: 2024-05-06, 2024.5.6, 2024년 5월 6일, or 6 May 2024."""
    parts = lambda p: F.try_make_timestamp(*(F.regexp_extract(c, p, i).try_cast("int") for i in (1, 2, 3)), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    numeric = parts(r"(\d{4})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})")
    english = F.coalesce(*(F.try_to_date(F.regexp_extract(c, r"(\d{1,2} [A-Z][a-z]+ \d{4})", 1), f) for f in ("d MMM yyyy", "d MMMM yyyy")))
    return F.coalesce(numeric, english)


def undoubled(c: Column) -> Column:
    """A text that says itself twice, said once."""
    t = X.clean(c)
    half = (F.length(t) / 2).cast("int")
    first = F.trim(F.substring(t, F.lit(1), half))
    return F.when((F.length(t) > 1) & (first == F.trim(F.substring(t, F.length(t) - F.length(first) + 1, F.length(first)))) & (F.length(t) - 2 * F.length(first) <= 1), first).otherwise(t)


def search_variants(query: Column, synonyms: list[tuple[str, str]], unit: str = r"^(.{2,}?)\d+호기$") -> Column:
    """A query as the search compares it, without its unit number, and with each synonym in place of its pair."""
    q = F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"[\s\-–—·./]+", "")
    swaps = [F.when(F.contains(q, F.lit(a)), F.regexp_replace(q, "^(.*?)" + re.escape(a), "$1" + b)) for p in synonyms for a, b in (p, p[::-1])]
    return F.array_distinct(F.filter(F.array_compact(F.array(q, F.nullif(F.regexp_extract(q, unit, 1), F.lit("")), *swaps)), lambda x: x != ""))


def unsourced_names(text: Column, source: Column, surnames: str, titles: str) -> Column:
    """Names before a title of office whose surname the source gives to another person become the title alone.

    Only a contradiction is redacted: the source must name someone of that title, by another surname. Both texts are
    compared in NFC.
    """
    pattern = re.compile(rf"([{surnames}][가-힣]{{1,2}})\s*({titles})")
    short = re.compile(rf"([{surnames}])[가-힣]{{0,2}}\s*({titles})")

    def one(t: str | None, s: str | None) -> str:
        t, s = (unicodedata.normalize("NFC", x or "") for x in (t, s))
        said: dict[str, set[str]] = {}
        for family, title in short.findall(s):
            said.setdefault(title, set()).add(family)
        return pattern.sub(lambda m: m[2] if said.get(m[2]) and m[1][0] not in said[m[2]] else m[0], t)

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(text, source)
