"""Per-chain, per-currency summaries. Nothing is ever summed across currencies."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import to_plain
from ..functions.text import age_days
from ..operators.asof import DATES
from ..operators.results import union
from ..operators.settlements import bridge
from ..rules import SLA_DAYS
from .engine import Outcome


def status_breakdown(states: DataFrame) -> DataFrame:
    return states.groupBy("chain", "record_type", "currency", "status").agg(
        F.count("*").alias("n"), F.sum("amount_minor").alias("amount_minor")
    )


def side_rollup(states: DataFrame) -> DataFrame:
    """Total, matched and unmatched by chain, source and currency."""
    matched = F.col("status") == "MATCHED"
    pick = lambda c: F.sum(F.when(c, F.col("amount_minor")).otherwise(0))
    return states.groupBy("chain", "record_type", "currency").agg(
        F.count("*").alias("total_count"), F.sum("amount_minor").alias("total_amount"),
        F.count_if(matched).alias("matched_count"), pick(matched).alias("matched_amount"),
        F.count_if(~matched).alias("unmatched_count"), pick(~matched).alias("unmatched_amount"),
    )


def groups_by_rule(groups: DataFrame) -> DataFrame:
    return groups.groupBy("chain", "rule", "currency").agg(F.count("*").alias("n_groups"), F.sum("left_total").alias("amount_minor"))


def exceptions_by_type(exceptions: DataFrame) -> DataFrame:
    """Signed sums, as a run reports them."""
    return exceptions.groupBy("chain", "case_type", "currency").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("amount_minor"))


def open_exposure(cases: DataFrame) -> DataFrame:
    """Absolute sums of unresolved cases: opposite sides must not cancel."""
    live = cases.where("status <> 'Resolved'") if "status" in cases.columns else cases
    return live.groupBy("chain", "case_type", "currency").agg(F.count("*").alias("n"), F.sum(F.abs("amount_minor")).alias("exposure_minor"))


def ageing(cases: DataFrame, as_of: date) -> DataFrame:
    """Cases with age and whether they are overdue."""
    age = age_days(F.col("anchor_date"), F.lit(as_of))
    late = age > SLA_DAYS
    if "status" in cases.columns:
        late = late & (F.col("status") != "Resolved")
    return cases.withColumns({"age_days": age, "overdue": late})


def input_ranges(ledger: DataFrame, psp: DataFrame, bank: DataFrame) -> DataFrame:
    return union([
        df.agg(F.count("*").alias("n"), F.min(DATES[name]).alias("first_day"), F.max(DATES[name]).alias("last_day"))
        .select(F.lit(name).alias("source"), "n", "first_day", "last_day")
        for name, df in (("ledger", ledger), ("psp", psp), ("bank", bank))
    ])


def control_totals(ledger: DataFrame, psp: DataFrame, bank: DataFrame) -> DataFrame:
    """Count and amount per source and currency: ledger gross, provider net, bank amount."""
    return union([
        df.groupBy("currency").agg(F.count("*").alias("n"), F.sum(c).alias("amount_minor")).select(F.lit(name).alias("source"), "currency", "n", "amount_minor")
        for name, df, c in (("ledger", ledger, "gross_minor"), ("psp", psp, "net_minor"), ("bank", bank, "amount_minor"))
    ])


def run_counts(o: Outcome) -> DataFrame:
    return union([
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        for name, df in (("groups", o.groups), ("exceptions", o.exceptions), ("ledger", o.ledger), ("psp", o.psp), ("bank", o.bank), ("settlements", o.settlements))
    ])


def as_json(o: Outcome, as_of: date) -> str:
    """The run's summary for programs: aggregates per chain and currency, a few rows each."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    return json.dumps({
        "as_of": as_of.isoformat(), "rules": asdict(o.rules), "status_breakdown": rows(status_breakdown(o.states)), "sides": rows(side_rollup(o.states)),
        "bridge": rows(bridge(o.settlements)), "groups_by_rule": rows(groups_by_rule(o.groups)), "exceptions": rows(exceptions_by_type(o.exceptions)),
        "excluded": rows(o.excluded), "counts": {r.what: r.n for r in run_counts(o).collect()},
    }, default=str, sort_keys=True)


def long_format(o: Outcome) -> DataFrame:
    """The summary as section, chain, source, currency, metric, count, amount (a machine decimal)."""
    return long_rows(o.states, o.groups, o.exceptions, bridge(o.settlements), o.excluded)


def long_rows(states: DataFrame, groups: DataFrame, cases: DataFrame, flows: DataFrame, excluded: DataFrame) -> DataFrame:
    """The long format of stored tables: states, groups, open cases, the settlement bridge, what the cut-off left out."""
    shape = lambda df, section, chain, source, metric, n, amount: df.select(
        F.lit(section).alias("section"), chain.alias("chain"), source.alias("source"), F.col("currency"), metric.alias("metric"),
        n.cast("bigint").alias("count"), to_plain(amount).alias("amount"),
    )
    col = F.col
    chain = F.when(col("chain") == "A", "A (gross)").otherwise("B (net)")
    sides = side_rollup(states)
    parts = [
        shape(sides, "chain", chain, col("record_type"), F.lit("total"), col("total_count"), col("total_amount")),
        shape(sides, "chain", chain, col("record_type"), F.lit("matched"), col("matched_count"), col("matched_amount")),
        shape(status_breakdown(states.where("status <> 'MATCHED'")), "chain", chain, col("record_type"), F.concat(F.lit("status:"), "status"), col("n"), col("amount_minor")),
        *[shape(flows, "settlement_bridge", F.lit("B"), F.lit("psp"), F.lit(m), col("batches"), col(f"{m}_minor")) for m in ("gross", "fee", "net")],
        shape(groups_by_rule(groups), "match_groups", col("chain"), col("rule"), F.lit("groups"), col("n_groups"), col("amount_minor")),
        shape(open_exposure(cases), "open_exceptions", col("chain"), col("case_type"), F.lit("open (abs exposure)"), col("n"), col("exposure_minor")),
    ]
    cut = excluded.select(F.lit("as_of_cutoff").alias("section"), F.lit("").alias("chain"), "source", F.lit("").alias("currency"),
                          F.lit("excluded (dated after as-of)").alias("metric"), F.col("excluded").cast("bigint").alias("count"), F.lit("").alias("amount"))
    return union([*parts, cut])
