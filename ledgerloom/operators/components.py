"""Connected components by alternating large-star and small-star rounds.

The least neighbour of every node is an aggregation that is combined before its shuffle. Links then meet it by a join
that leaves the links of a hub in place, so neither a component nor the links of one node are gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import scratch, settle
from .counted import join_counted


def _with_least(links: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The links (u, v) with ``m``, the least v of their u; and (u, m, n) itself."""
    least = settle(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    return join_counted(links, least, "u", total), least


def _round(links: DataFrame, total: int) -> DataFrame:
    both = links.union(links.select(F.col("v"), F.col("u")))
    near, _ = _with_least(both, 2 * total)
    large = settle(near.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large-stars")
    near, least = _with_least(large, total)
    small = near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return settle(small.distinct(), "stars")


def _stars(links: DataFrame) -> bool:
    """Does every node but the centres have one link, to a centre?"""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select(F.col("v"), F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 OR (up > 0 AND down > 0)").limit(1).count()


def roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (u, v of one ordered type) -> (u, v) with v the least node of u's component, for every u that isn't it.

    Empty edges give an empty frame; loops, nulls and repeated edges change nothing.
    """
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    with scratch(edges.sparkSession) as keep:
        current = settle(oriented, "links")
        for _ in range(rounds):
            if _stars(current):
                return keep(current)
            with scratch(edges.sparkSession) as onward:
                current = onward(_round(current, current.count()))
    raise RuntimeError("components did not settle")
