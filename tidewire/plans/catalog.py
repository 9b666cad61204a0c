"""All queries over the harness's tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans import contracts, logs, lookups, measures, records

_MODULES = (measures, lookups, contracts, records, logs)
#: Columns that hold days; both sides show them as YYYY-MM-DD strings.
_DAYS = {
    "bucket_timeline_from_end": ("first_day", "last_day"), "pick_daily_stats": ("day",), "weekly_movers": ("last_seen",), "issue_lifecycle": ("first_seen", "last_seen"), "issue_catalog": ("first_seen", "last_seen"),
    "entity_rollup_with_zero": ("latest",), "story_construction": ("day",), "briefing_rollup": ("day",), "period_fanout_prev_null": ("from", "to"), "period_fanout_orders": ("from", "to"),
}


def _shown(f: Callable, days: tuple[str, ...]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in days})

    return run


def queries() -> dict[str, Callable]:
    return {k: _shown(f, _DAYS[k]) if k in _DAYS else f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    shown = lambda s, days: f"SELECT * REPLACE ({', '.join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in days)}) FROM ({s})"
    return {k: shown(s, _DAYS[k]) if k in _DAYS else s for m in _MODULES for k, s in m.SQL.items()}
