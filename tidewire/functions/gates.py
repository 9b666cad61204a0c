"""Gates of a record on its way to the reader: who may speak, what may be said, what is asked again, what is shown."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions import urls as U

#: The limit and the sources of an open question, phrases that forecast, phrases that leave a matter open.
QUESTION_LIMIT = 60
QUESTION_SOURCES = ("title", "description", "article_text")
FORECAST = ("것으로 보인다", "것으로 예상", "전망이다", "전망된다", "가능성이 있다", "우려된다", "관측된다", "분석된다", "기대된다")
OPEN = ("조사 중", "조사중", "확인되지 않", "확인 중", "확인중", "결정되지 않", "정해지지 않", "밝혀지지 않", "미정", "발표되지 않", "공개되지 않")
#: Endings of an interpretation that say nothing, and quantities that make up for one.
HOLLOW = (
    r"(?:시사(?:한다|합니다|해\s*준다|하고\s*있다)|보여\s*(?:준다|줍니다|주고\s*있다)|기대(?:된다|됩니다|를\s*모은다)|전망(?:된다|됩니다|이다|입니다)|예상(?:된다|됩니다)"
    r"|기여할\s*것(?:이다|입니다|으로\s*(?:보인다|전망된다|예상된다))|중요(?:하다|합니다|성이\s*(?:크다|부각된다|증대된다))|필요(?:하다|합니다|가\s*있다|가\s*있습니다|성이\s*(?:크다|제기된다))"
    r"|(?:주목|주시|점검|검토|모니터링)(?:이|을|를|해야|할)?\s*(?:필요(?:가\s*)?(?:하다|합니다|있다|있습니다)|된다|됩니다|한다|합니다)"
    r"|참고(?:할\s*수\s*)?(?:있다|있습니다|해야\s*한다|해야\s*합니다)|파악(?:할\s*수\s*)?(?:있다|있습니다)|요구(?:된다|됩니다))\s*[.。]?\s*$"
)
HOLLOW_QUANTITY = r"\d\s*(?:년|월|일|분기|%|퍼센트|억|조|만|천|배|MW|GW|kW|TWh|MWh|기|개|건|차|호기|명|달러|원|유로)"
#: Words that alone say nothing.
VAGUE = (
    "국내", "해외", "국내외", "원자력", "원전", "에너지", "정책", "현실", "동향", "다양", "다양한", "여러", "각종", "전반", "관련", "논의", "상황", "변화", "진행", "확인",
    "이슈", "사안", "분야", "부문", "있었습니다", "있었다", "이어졌습니다", "나타났습니다", "및", "대한", "대해", "함께",
)
#: Events strong enough for a report, and how alike a rejected example may be.
STRONG_EVENTS = ("policy_decision", "regulatory_action", "contract_award", "incident_safety")
NEGATIVE_RATIO = 0.7
FEATURE_ATTEMPTS = 2
SHOWN_DAYS = 60


def _any(c: Column, needles: tuple[str, ...] | list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(c, n)) if needles else F.lit(False)


def keyword_gate(title: Column, description: Column, required: Column) -> Column:
    """A source without required keywords passes all; else one must occur in title or description."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    wanted = F.coalesce(required, F.array().cast("array<string>"))
    return (F.size(wanted) == 0) | F.exists(wanted, lambda k: F.contains(text, F.lower(k)))


def hollow(implication: Column) -> Column:
    """An interpretation that ends in a set phrase and names no quantity; blank ones aren't hollow."""
    t = X.clean(implication)
    return (t != "") & t.rlike(HOLLOW) & ~t.rlike(HOLLOW_QUANTITY)


def without_hollow(implication: Column) -> Column:
    return F.when(hollow(implication), "").otherwise(X.clean(implication))


def without_body(body: Column, interpretation: Column) -> Column:
    """Nothing is interpreted where no body was read."""
    return F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "").otherwise(X.clean(interpretation))


def needs_recuration(errors: Column, attempts: Column) -> Column:
    """Errors ask again; if only the features are missing, at most FEATURE_ATTEMPTS times."""
    alone = (F.size(errors) == 1) & (F.get(errors, 0) == "features:missing")
    return (F.size(errors) > 0) & (~alone | (F.coalesce(attempts, F.lit(0)) < FEATURE_ATTEMPTS))


def question_reason(question: Column, source: Column, importance: Column, event: Column) -> Column:
    """Why an open question isn't shown, the first of seven reasons; '' if it is."""
    t, s = X.clean(question), F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return (
        F.when(F.coalesce(importance, F.lit("")) != "must_read", "not_must_read").when(t == "", "llm_null").when(~s.isin(*QUESTION_SOURCES), "no_source").when(F.length(t) > QUESTION_LIMIT, "too_long")
        .when(t.endswith("?"), "is_question").when(_any(t, FORECAST), "forecast").when((F.coalesce(event, F.lit("")) == "incident_safety") & ~_any(t, OPEN), "incident_no_uncertainty").otherwise("")
    )


def open_question(question: Column, source: Column, importance: Column, event: Column) -> Column:
    """struct(question, source, reason): what passes, else '' and unknown."""
    reason = question_reason(question, source, importance, event)
    good = reason == ""
    return F.struct(F.when(good, X.clean(question)).otherwise("").alias("question"), F.when(good, F.lower(F.trim(source))).otherwise("unknown").alias("source"), reason.alias("reason"))


def visible(importance: Column, day: Column, today: Column, days: int = SHOWN_DAYS) -> Column:
    """Neither noise nor market news, with a date, at most `days` old."""
    return ~F.coalesce(importance, F.lit("")).isin("noise", "market") & day.isNotNull() & (day >= F.date_sub(today, days))


def scheduled(schedule: Column, day: Column, biweekly: bool = True) -> Column:
    """Topics of every week, and those of odd or even ISO weeks in such a week."""
    odd = F.weekofyear(day) % 2 == 1
    plan = F.coalesce(schedule, F.lit("weekly"))
    return (plan == "weekly") | (F.lit(biweekly) & (((plan == "biweekly_odd") & odd) | ((plan == "biweekly_even") & ~odd)))


def report_candidate(has_features: Column, importance: Column, worthiness: Column, policy: Column, event: Column) -> Column:
    """Worth a report and strong; records without features only if they are must-reads."""
    must = importance == "must_read"
    strong = must | (policy >= 2) | event.isin(*STRONG_EVENTS)
    return F.coalesce(F.when(has_features, (worthiness >= 2) & strong).otherwise(must), F.lit(False))


def unlike_examples(rows: DataFrame, title: str, examples: DataFrame, example: str, ratio: float = NEGATIVE_RATIO, least: int = 6) -> DataFrame:
    """Rows whose title isn't alike any rejected example of at least `least` characters. The examples are a small checked-in list."""
    known = [r[0] for r in examples.where(F.length(F.trim(example)) >= least).select(F.trim(example)).distinct().limit(10_000).collect()]

    @F.pandas_udf("boolean")
    def alike(titles: pd.Series) -> pd.Series:
        matchers = []
        for e in known:
            m = difflib.SequenceMatcher()
            m.set_seq2(e)
            matchers.append(m)

        def one(t: str | None) -> bool:
            for m in matchers:
                m.set_seq1((t or "").strip())
                if t and m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio:
                    return True
            return False

        return titles.map(one, na_action=None).astype(bool)

    return rows.where(~alike(F.col(title))) if known else rows


def substantive(sentence: Column, sources: Column, vague: tuple[str, ...] = VAGUE, least: int = 2) -> Column:
    """The sentence shares at least two words, vague ones aside, with what it is said to rest on."""
    words = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([0-9A-Za-z가-힣]{2,})"), F.lit(1))), F.array(*map(F.lit, vague)) if vague else F.array().cast("array<string>"))
    return F.size(F.array_intersect(words(sentence), words(sources))) >= least


def needs_insight(implication: Column, articles: Column, least: int = 2) -> Column:
    """An issue of several articles whose interpretation is blank or hollow."""
    return (articles >= least) & ((X.clean(implication) == "") | hollow(implication))


def restates_title(insight: Column, title: Column, ratio: float = 0.55) -> Column:
    """An insight that says the title again; a quantity that the title lacks rescues it."""
    adds = insight.rlike(HOLLOW_QUANTITY) & ~F.coalesce(title, F.lit("")).rlike(HOLLOW_QUANTITY)
    return (X.ratio(X.loose_key(insight), X.loose_key(title)) >= ratio) & ~adds


def looks_like_host(publisher: Column) -> Column:
    p = F.trim(F.coalesce(publisher, F.lit("")))
    return (p != "") & F.contains(p, F.lit(".")) & ~F.contains(p, F.lit(" "))


def needs_backfill(record_done: Column, importance: Column, dropped: Column, site_name: Column, resolved: Column, publisher: Column, url: Column) -> Column:
    """Shown records whose publisher is a host, or whose link is an aggregator's, unless both are known or were tried."""
    known = (F.coalesce(site_name, F.lit("")) != "") & (F.coalesce(resolved, F.lit("")) != "")
    shown = (F.coalesce(importance, F.lit("")) != "noise") & ~F.coalesce(dropped, F.lit(False))
    return ~F.coalesce(record_done, F.lit(False)) & shown & ~known & (looks_like_host(publisher) | aggregator(url))


def aggregator(url: Column) -> Column:
    return F.coalesce(U.host_plain(url).rlike(r"(^|\.)news\.google\.com$"), F.lit(False))


def primary_source(role: Column, tier: Column) -> Column:
    return F.coalesce(role == "primary", F.lit(False)) | F.coalesce(tier == 1, F.lit(False))


def official_source(role: Column, source_type: Column) -> Column:
    return F.coalesce(role == "primary", F.lit(False)) | F.coalesce(source_type == "official", F.lit(False))


def independent_source(role: Column) -> Column:
    return F.coalesce(role == "independent", F.lit(False))


def search_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z가-힣]+", "")


def bracketless_key(title: Column) -> Column:
    """A title as collectors compare it: without bracketed parts, letters and digits only."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"\[[^\]]+\]|\([^)]+\)", ""), r"(?U)[^\w가-힣]", ""))


def may_replace(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """An aggregator's link gives way to the article's own if title, publisher and domain agree (keys link, title, publisher, domain)."""
    same = (bracketless_key(old["title"]) == bracketless_key(new["title"])) & (search_key(old["publisher"]) == search_key(new["publisher"]))
    domain = F.coalesce(F.nullif(new["domain"], F.lit("")), U.registered_domain(new["link"]))
    return F.coalesce(aggregator(old["link"]) & ~aggregator(new["link"]) & same & (F.coalesce(old["domain"], F.lit("")) != "") & (old["domain"] == domain), F.lit(False))
