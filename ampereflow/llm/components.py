"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _star(edges: DataFrame, larger: bool) -> tuple[DataFrame, DataFrame]:
    """One star step over undirected ``edges (u, v)``, u < v, and the table of minima that it reads.

    The large star links each node's larger neighbours to the smallest node of its neighbourhood, the
    small star its smaller neighbours and itself. Minima are pre-aggregated and written; a hub's rows
    meet its minimum in a join of two plain tables, which Spark can split.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = both.filter("v > u") if larger else both.filter("v < u")
    lowest = both if larger else rows
    lowest = materialize(lowest.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("k"), "m"), "minima")
    linked = rows.join(lowest, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        linked = linked.union(lowest.select(F.col("k"), F.col("m")))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return linked.filter("a <> b").select(low.alias("u"), high.alias("v")).distinct(), lowest


def _same(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables of distinct links have the same rows; rows are compared only where counts and hashes agree."""
    sums = [t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for t in (one, other)]
    return sums[0] == sums[1] and not one.join(other, ["u", "v"], "left_anti").limit(1).count()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``; root is the smallest node of its component.

    Rounds of a large and a small star follow one another until the links are stars whose centres are
    roots; each is written to the shared folder, so that no lineage grows. The number of rounds grows
    with the logarithm of the size of a component; running out of ``rounds`` is an error, never a
    partial result. Self links and repeated links are fine; an empty table gives no rows.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    current = materialize(edges.filter("u <> v").select(low.alias("u"), high.alias("v")).distinct(), "links")
    for _ in range(rounds):
        if not current.limit(1).count():
            break
        large, first = _star(current, True)
        small, second = _star(large, False)
        step = materialize(small, "links")
        settled = _same(current, step)
        for table in (current, first, second):
            drop_table(table)
        current = step
        if settled:
            break
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("v").alias("node"), F.col("u").alias("root")).union(current.select("u", "u").distinct())
