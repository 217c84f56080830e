"""Connected components of a distributed edge table (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import keep_table


def _state(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node with an edge; a component is named by
    its smallest node.

    Each round links every node to the least node it knows (large star), then
    the smaller neighbours of a node to the least of them (small star); edges
    become stars in a logarithmic number of rounds.  Tables are written between
    rounds and only counts reach the driver.  No edges give no rows."""
    x, y = F.col(a), F.col(b)
    e = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    e = keep_table(e, "edges")
    state = _state(e)
    for _ in range(max_rounds):
        # dealt by u once: its least neighbour and the join with it need no further shuffle
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").repartition("u")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        stars = small.select("u", F.col("m").alias("v")).union(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = keep_table(stars, "stars")
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def joined(groups: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """``groups`` (``node, component``, every node of ``links`` without an entry being
    alone) after further ``links`` between its nodes: only the links between different
    components are followed."""
    def placed(side: str, out: str) -> DataFrame:
        return groups.select(F.col("node").alias(side), F.col("component").alias(out))
    ends = (links.select(a, b).join(placed(a, "x"), a, "left").join(placed(b, "y"), b, "left")
            .select(F.coalesce("x", a).alias("x"), F.coalesce("y", b).alias("y")).where("x != y"))
    ends = keep_table(ends.distinct(), "between")
    more = keep_table(components(ends, "x", "y"), "merged").select(F.col("node").alias("old"), F.col("component").alias("new"))
    both = groups.join(more, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = more.join(groups, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return both.union(alone)
