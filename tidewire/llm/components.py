"""Connected components of a graph that stays distributed.

Each round every node points to the neighbour (or itself) of least random rank; the graph is contracted along the
pointers, so a constant share of the nodes goes each round whatever the shape. No neighbourhood is gathered: pointers
are minima with partial aggregation, the other steps are joins that AQE splits where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut, free


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, root), a row for each node of an edge; root is some node of the component.

    Nulls are no nodes. Loops and repeated edges are allowed. No edges give no rows.
    """
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    for r in range(rounds):
        if left.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(str(r))).alias("h"), F.col(c).alias("n"))  # noqa: E731 a text, so that every round has the same generated code
        both = left.select(F.col("a").alias("x"), F.least(rank("a"), rank("b")).alias("y")).unionAll(left.select(F.col("b").alias("x"), F.least(rank("a"), rank("b")).alias("y")))
        to = cut(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.col("y.n").alias("y")), "pointers")
        contracted = cut(
            left.join(to.select(F.col("x").alias("a"), F.col("y").alias("p")), "a").join(to.select(F.col("x").alias("b"), F.col("y").alias("q")), "b")
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a <> b").distinct(),
            "edges",
        )
        free(left)
        left = contracted
        if labels is None:
            labels = cut(to.select(F.col("x").alias("node"), F.col("y").alias("root")), "labels")
        else:
            renamed = cut(labels.join(to, labels["root"] == to["x"], "left").select("node", F.coalesce("y", "root").alias("root")), "labels")
            free(labels)
            labels = renamed
        free(to)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
