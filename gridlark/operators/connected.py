"""Connected components of any graph, without a driver-side or one-task step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.session import drop_table, stored_table

SMALL_ROWS = 100_000


def _beside(stored: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if a count proves it small."""
    return F.broadcast(stored) if stored.count() <= SMALL_ROWS else stored


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; root is the least node.

    Nodes may be of any type with an order; null ends and links of a node to itself say
    nothing. Each round hooks the larger neighbours of every node to its least neighbour
    and then the node and its smaller neighbours to the least of those, so that trees
    keep flattening and only stars are left after about the logarithm of the longest
    path. It goes on until a round changes nothing. Neighbours are never gathered: a
    round is minima per node and joins on them. A round's tables are written, read with
    a plan of their own and deleted once the next round is written.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = stored_table(edges)

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select("lo", "hi")).toDF("at", "to")
        first = stored_table(both.groupBy("at").agg(F.min("to").alias("m")).select("at", F.least("at", "m").alias("m")))
        # larger neighbours go to the least one
        big = both.where(F.col("to") > F.col("at")).join(_beside(first), "at").select(F.col("to").alias("hi"), F.col("m").alias("lo")).distinct()
        big = stored_table(big)
        second = stored_table(big.groupBy("hi").agg(F.min("lo").alias("m")))
        # smaller neighbours and the node itself do too
        seen = big.join(_beside(second), "hi").where(F.col("lo") > F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        hooked = stored_table(seen.union(second.select("hi", F.col("m").alias("lo"))).distinct())
        before, now = now, state(hooked)
        for table in (edges, first, big, second):
            drop_table(table)
        edges = hooked
        if before == now:
            break
    roots = edges.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
