"""First-loaded-wins deduplication as a fixpoint over sets.

A row is loaded if no row loaded before it has its record id or its business key. A row that shares neither with another
is loaded at once. Among the contested rest, in each round the rows that come first in both their groups are loaded, and
rows that share an id or key with a loaded row leave. Verdicts are given once, at the end, against what was loaded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import scratch, settle


def dedupe(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """rows: record_id, business_key (nullable), content_hash, ord (unique, orderable) and others; stored: the first
    four for records that are there already, with smaller ord.

    Returns rows with ``verdict`` (LOADED, DUPLICATE_ROW, CONFLICT_RECORD_ID, CONFLICT_BUSINESS_KEY) and
    ``conflicts_with`` (the ord of the record that stood in the way).
    """
    key = ["record_id", "business_key", "content_hash", "ord"]
    spark = rows.sparkSession
    with scratch(spark) as keep:
        rows = keep(settle(rows, "rows"))
        every = rows.select(*key)
        contested = settle(_contested(every, stored), "contested")
        loaded = pending = contested
        if stored is None:
            loaded = contested.limit(0)
        else:
            loaded = settle(_sharing(stored.select(*key), contested), "stored")
            pending = settle(_free(pending, loaded), "pending")
        while pending.limit(1).count():
            by_id = pending.groupBy("record_id").agg(F.min("ord").alias("first"))
            by_key = pending.where("business_key IS NOT NULL").groupBy("business_key").agg(F.min("ord").alias("first_key"))
            ranked = pending.join(by_id, "record_id").join(by_key, "business_key", "left")
            won = settle(ranked.where("ord = first AND (first_key IS NULL OR ord = first_key)").select(*key), "won")
            loaded = loaded.unionByName(won)
            pending = settle(_free(pending, won), "pending")
        loaded = settle(loaded, "loaded")
        judged = keep(settle(_judged(contested, loaded), "judged"))
    verdict = F.coalesce("verdict", F.lit("LOADED")).alias("verdict")
    return rows.join(judged, "ord", "left").select(*rows.columns, verdict, "conflicts_with")


def _contested(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows that share their id or key with another row or a stored record."""
    out = []
    for c in ("record_id", "business_key"):
        known = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        if stored is not None:
            met = stored.where(F.col(c).isNotNull()).select(c).join(known.select(c), c, "left_semi")
            known = known.unionByName(met.select(c, F.lit(2).cast("bigint").alias("n")))
        shared = known.where("n > 1").select(c).distinct()
        out.append(rows.join(shared, c, "left_semi").select(*rows.columns))
    return out[0].unionByName(out[1]).dropDuplicates(["ord"])


def _sharing(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored records that share id or key with one of the rows."""
    out = [stored.join(rows.where(F.col(c).isNotNull()).select(c).distinct(), c, "left_semi").select(*stored.columns) for c in ("record_id", "business_key")]
    return out[0].unionByName(out[1]).dropDuplicates(["ord"])


def _judged(rows: DataFrame, loaded: DataFrame) -> DataFrame:
    """(ord, verdict, conflicts_with) of the contested rows."""
    same = loaded.select("record_id", F.col("ord").alias("id_ord"), F.col("content_hash").alias("id_hash"))
    other = loaded.where("business_key IS NOT NULL").select("business_key", F.col("ord").alias("key_ord"))
    judged = rows.join(same, "record_id", "left").join(other, "business_key", "left")
    by_id = F.col("id_ord") < F.col("ord")
    verdict = (
        F.when(F.col("id_ord") == F.col("ord"), "LOADED")
        .when(by_id & (F.col("id_hash") == F.col("content_hash")), "DUPLICATE_ROW")
        .when(by_id, "CONFLICT_RECORD_ID")
        .otherwise("CONFLICT_BUSINESS_KEY")
    )
    blocker = F.when(F.col("id_ord") == F.col("ord"), None).when(by_id, F.col("id_ord")).otherwise(F.col("key_ord"))
    return judged.select("ord", verdict.alias("verdict"), blocker.alias("conflicts_with"))


def _free(pending: DataFrame, loaded: DataFrame) -> DataFrame:
    ids = loaded.select("record_id")
    keys = loaded.where("business_key IS NOT NULL").select("business_key")
    return pending.join(ids, "record_id", "left_anti").join(keys, "business_key", "left_anti").select(
        "record_id", "business_key", "content_hash", "ord"
    )
