"""Streaming state: seen sets with a time to live, cool-down of queries, windows with late data, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seen_once(stream: DataFrame, key: str, at: str, ttl: str = "14 days") -> DataFrame:
    """The first row of each key within the time to live; keys are forgotten once the watermark has passed it."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, keys: list[str], size: str = "1 day", slide: str | None = None, late: str = "6 hours") -> DataFrame:
    """Counts by event-time window; rows later than `late` behind the watermark are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def cool_down(stream: DataFrame, key: str, at: str, new: str, streak: int = 3, days: int = 7, keep_days: int = 60) -> DataFrame:
    """(key, runs, zero_streak, next_eligible_at) after each micro-batch: `streak` runs without yield in a row put a query to
    sleep for `days`, any yield wakes it; state that isn't touched for keep_days of event time expires."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        runs, zero, until = state.get if state.exists else (0, 0, None)
        last = pd.Timestamp(0)
        for pdf in batches:
            for t, n in sorted(zip(pdf[at], pdf[new], strict=True)):
                last, runs, zero = max(last, t), runs + 1, 0 if n > 0 else zero + 1
                until = str(t + pd.Timedelta(days=days)) if zero >= streak else None
        state.update((runs, zero, until))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_days * 86_400_000)
        yield pd.DataFrame({key: [group[0]], "runs": [runs], "zero_streak": [zero], "next_eligible_at": [until]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.withWatermark(at, f"{days} days").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, runs int, zero_streak int, next_eligible_at string", "runs int, zero int, until string", "update", GroupStateTimeout.EventTimeTimeout)


def idempotent_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: each batch has a folder of its own that a retry overwrites, and keys already written are skipped."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
            done = spark.read.parquet(path).where(F.col("epoch") < epoch)
            rows = rows.join(done.select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def admit(rows: DataFrame, at: str, now, kind: str, limits: dict[str, str]) -> DataFrame:
    """Late-data admission by kind of source: rows older than the kind's interval are left out."""
    keep = F.lit(False)
    for k, span in limits.items():
        keep = keep | ((F.col(kind) == k) & (F.col(at) >= now - F.expr(f"INTERVAL {span}")))
    return rows.where(keep)


def send_due(outbox: DataFrame, now, hours: float = 36.0) -> DataFrame:
    """Pending briefs get send, those older than `hours` stale; others keep their status."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 3600
    return outbox.withColumn("action", F.when(F.col("status") != "pending", F.col("status")).when(age > hours, "stale").otherwise("send"))
