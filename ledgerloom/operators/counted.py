"""Joins of skewed rows with a table that tells how often each key occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a larger share of the rows than one in HUBS carries are broadcast: by count there are fewer than HUBS.
HUBS = 10_000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which is unique by ``key`` and has ``n``: how many of the ``total`` rows carry it.

    The rows of a frequent key stay where they are, all others are few per key and are shuffled. ``how``: inner or
    left. Null keys meet nothing.
    """
    bound = total // HUBS
    frequent = F.broadcast(keyed.where(F.col("n") > bound))
    if not bound:
        return rows.join(frequent, key, how)
    rest = rows.join(F.broadcast(keyed.where(F.col("n") > bound).select(key)), key, "left_anti")
    return rows.join(frequent, key).unionByName(rest.join(keyed.where(F.col("n") <= bound), key, how))
