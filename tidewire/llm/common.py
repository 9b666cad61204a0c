"""What the operators share: the shared scratch folder and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local master (tests) gets a temporary one; a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewire-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


#: Paths made in each open scope, the innermost last.
_scopes: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; the innermost open scope deletes it at its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables and files made inside once the caller has written what it needs of them.

    DataFrames returned by operators read scratch lazily, so write or collect them inside the scope.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later steps neither recompute it nor depend on one executor.

    Without a codec: hashes and keys don't shrink, and codecs hold native memory in every column of every writer.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "uncompressed").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables made by cut that nothing reads any more, and lets Spark drop shuffle files that no plan holds."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """From here on the session sends at most so many rows at once to Python: texts may be long, and a batch is held several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Queries run inside send at most so many rows at once to Python: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before))) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path by the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def without(docs: DataFrame, *added: str) -> DataFrame:
    """docs without columns of these names, in whatever case: an operator's own columns replace them."""
    names = {c.lower() for c in added}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names))


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names renamed, and a function that gives a result the columns of docs under their own names."""
    wanted = {n.lower() for n in names}
    held = {c: f"__aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in wanted}
    columns = [F.col(f"`{held.get(c, c)}`").alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(held), lambda out: out.select(*columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
