"""Settlement batches from provider items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(psp: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row per batch: sums, the values of the item of the smallest id, and the problem, if there is one.

    Sums over several currencies would mean nothing; they are 0. An inconsistent batch outranks a blocked item.
    """
    bad = blocked.where("source = 'psp'").select("record_id", F.lit(1).alias("bad"))
    least = lambda c: F.min_by(c, "record_id").alias(c)
    grouped = (
        psp.where("batch_id IS NOT NULL").join(bad, "record_id", "left").groupBy("batch_id").agg(
            least("bank_account"), least("currency"), least("settlement_date"), least("merchant_account"),
            F.sum("gross_minor").alias("gross"), F.sum("fee_minor").alias("fee"), F.sum("net_minor").alias("net"),
            F.count("*").alias("items"),
            (F.min("currency") != F.max("currency")).alias("currencies"),
            (F.min("bank_account") != F.max("bank_account")).alias("accounts"),
            (F.min("settlement_date") != F.max("settlement_date")).alias("days"),
            (F.min("merchant_account") != F.max("merchant_account")).alias("merchants"),
            F.max("bad").alias("bad"),
        )
    )
    mixed = F.col("currencies") | F.col("accounts") | F.col("days") | F.col("merchants")
    amount = lambda c: F.when(F.col("currencies"), F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c)
    return grouped.select(
        "batch_id", "bank_account", "currency", "settlement_date", "merchant_account", amount("gross"), amount("fee"),
        amount("net"), "items",
        F.when(mixed, "BATCH_INCONSISTENT").when(F.col("bad") == 1, "SOURCE_CONFLICT").alias("problem"),
    )


def bridge(settlements: DataFrame) -> DataFrame:
    """Gross less fees is net, per currency; inconsistent batches have no sums to add."""
    whole = settlements.where("problem IS NULL OR problem <> 'BATCH_INCONSISTENT'")
    return whole.groupBy("currency").agg(
        F.count("*").alias("batches"), F.sum("gross").alias("gross_minor"), F.sum("fee").alias("fee_minor"),
        F.sum("net").alias("net_minor"),
    )
