"""Records as known on a business date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATES = {"ledger": "event_date", "psp": "created_date", "bank": "value_date"}


def visible(records: DataFrame, source: str, as_of: date) -> DataFrame:
    """Rows dated on or before ``as_of``. A provider item that settles later counts as not settled yet."""
    kept = records.where(F.col(DATES[source]) <= F.lit(as_of))
    if source != "psp":
        return kept
    later = F.col("batch_id").isNotNull() & (F.col("settlement_date") > F.lit(as_of))
    return kept.withColumn("__later", later).withColumns({
        "batch_id": F.when(~F.col("__later"), F.col("batch_id")),
        "settlement_date": F.when(~F.col("__later"), F.col("settlement_date")),
    }).drop("__later")


def excluded(ledger: DataFrame, psp: DataFrame, bank: DataFrame, as_of: date) -> DataFrame:
    """(source, excluded): rows that the cut-off leaves out, and settlements that it hides."""
    day = F.lit(as_of)

    def count(df: DataFrame, name: str, after) -> DataFrame:
        return df.agg(F.count_if(after).alias("excluded")).select(F.lit(name).alias("source"), "excluded")

    hidden = (F.col("created_date") <= day) & F.col("batch_id").isNotNull() & (F.col("settlement_date") > day)
    return (
        count(ledger, "ledger", F.col("event_date") > day)
        .unionByName(count(psp, "psp", F.col("created_date") > day))
        .unionByName(count(bank, "bank", F.col("value_date") > day))
        .unionByName(count(psp, "psp_settlement_after_as_of", hidden))
    )


def default_as_of(ledger: DataFrame, psp: DataFrame, bank: DataFrame, today: date) -> DataFrame:
    """The latest business date; bank lines dated after ``today`` do not count."""
    days = (
        ledger.select(F.col("event_date").alias("day"))
        .unionAll(psp.select("created_date"))
        .unionAll(bank.where(F.col("value_date") <= F.lit(today)).select("value_date"))
    )
    return days.agg(F.max("day").alias("as_of"))
