"""Connected components of a table of edges, by alternating star steps.

Each step is a grouped minimum (with map-side sums) and a join with it; edges are written to
the shared checkpoint folder after every round, so lineage stays short and
lost executors cost one round.  Nothing is collected but a count and a sum.
A large component's least node has its edges in one key; the minima are grouped by another form
of the key than the joins', so both sides of a join have exchanges of their own and Spark can split such a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _least(e: DataFrame) -> DataFrame:
    """u, m: the least v of each u."""
    return e.groupBy(F.struct("u").alias("g")).agg(F.min("v").alias("m")).select("g.u", "m")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(e)
    rest = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node of an edge that is not the least of its component, and that least node.

    Takes columns u and v of one type (long); loops and repeated edges don't matter."""
    e = durable(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = sign(e)
    while last[0]:
        e = durable(_small_star(_large_star(e)))
        now = sign(e)
        if now == last:
            break
        last = now
    return e
