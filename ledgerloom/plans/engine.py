"""The whole reconciliation as one plan: records in, states, groups, members, exceptions and evidence out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import settle, settle_all
from ..operators import asof
from ..operators.chain_a import chain_a
from ..operators.chain_b import chain_b
from ..operators.numbering import numbered
from ..operators.results import union
from ..operators.settlements import build
from ..rules import Rules

BLOCKED = "source string, record_id string, issue_ids array<long>"


class InvariantError(AssertionError):
    """A result that must never leave the engine."""


@dataclass
class Inputs:
    """Loaded records, the records that conflicts block, and hints (hint_key, hint) from quarantined rows."""

    ledger: DataFrame
    psp: DataFrame
    bank: DataFrame
    as_of: date
    blocked: DataFrame | None = None
    hints: DataFrame | None = None
    rules: Rules = field(default_factory=Rules)


@dataclass
class Outcome:
    states: DataFrame
    groups: DataFrame
    members: DataFrame
    exceptions: DataFrame
    evidence: DataFrame
    classes: DataFrame
    settlements: DataFrame
    excluded: DataFrame
    ledger: DataFrame
    psp: DataFrame
    bank: DataFrame
    rules: Rules = field(default_factory=Rules)


def reconcile(inputs: Inputs) -> Outcome:
    """Run both chains on the records visible on the as-of date and check the invariants."""
    spark = inputs.ledger.sparkSession
    blocked = inputs.blocked if inputs.blocked is not None else spark.createDataFrame([], BLOCKED)
    sides = {n: asof.visible(getattr(inputs, n), n, inputs.as_of) for n in ("ledger", "psp", "bank")}
    with ThreadPoolExecutor(1) as pool:  # the chains share no result
        other = pool.submit(chain_a, sides["ledger"], sides["psp"], blocked, inputs.hints, inputs.as_of, inputs.rules)
        settlements = settle(build(sides["psp"], blocked), "settlements")
        second = chain_b(sides["psp"], sides["bank"], settlements, blocked, inputs.as_of, inputs.rules)
        found = other.result().joined(second)
    members, groups = settle_all((union(found.members), "members"), (_with_ids(union(found.groups)), "groups"))
    totals = members.groupBy("group_key").agg(
        F.sum(F.when(F.col("side") == "L", F.col("amount_minor")).otherwise(0)).alias("left_total"),
        F.sum(F.when(F.col("side") == "R", F.col("amount_minor")).otherwise(0)).alias("right_total"),
    )
    ids = groups.select("group_key", "group_id")
    evidence = union(found.evidence).withColumn("members", F.coalesce("members", F.lit(1))).distinct()
    states, members, groups, exceptions, evidence, classes = settle_all(
        (union(found.states).join(ids, "group_key", "left").drop("group_key"), "states"),
        (members.join(ids, "group_key").drop("group_key"), "members"),
        (groups.join(totals, "group_key", "left").drop("group_key"), "groups"),
        (union(found.exceptions), "exceptions"), (evidence, "evidence"), (union(found.classes).distinct(), "classes"),
    )
    outcome = Outcome(
        states, groups, members, exceptions, evidence, classes, settlements,
        excluded=asof.excluded(inputs.ledger, inputs.psp, inputs.bank, inputs.as_of), rules=inputs.rules, **sides,
    )
    check(outcome)
    return outcome


def _with_ids(groups: DataFrame) -> DataFrame:
    """Ids in processing order, counted anew in each chain."""
    placed = numbered(groups, ["chain", "phase", "first_key", "second_key"], "number")
    first = placed.groupBy("chain").agg(F.min("number").alias("first"))  # one row per chain
    text = F.format_string("%s-%06d", F.col("chain"), F.col("number") - F.col("first") + 1)
    return placed.join(F.broadcast(first), "chain").withColumn("group_id", text).drop("number", "first", "phase", "first_key", "second_key")


def violations(o: Outcome) -> DataFrame:
    """(invariant, broken): groups that do not conserve or mix currencies, records used or judged twice, case keys
    that are not unique. All zero unless the engine is wrong."""
    count = lambda df, name: df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("invariant"), "broken")
    twice = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    chained = o.members.withColumn("chain", F.substring("group_id", 1, 1))
    own = o.states.where("group_id IS NOT NULL").groupBy("group_id").agg(F.count_distinct("currency").alias("n")).where("n > 1")
    return union([
        count(o.groups.where("left_total IS NULL OR left_total <> right_total"), "conservation"),
        count(own, "one_currency"),
        count(twice(chained, "chain", "record_type", "record_id"), "consumed_once"),
        count(twice(o.states, "chain", "record_type", "record_id"), "one_state"),
        count(twice(o.exceptions, "case_key"), "unique_case_key"),
    ])


def check(o: Outcome) -> None:
    broken = [(r.invariant, r.broken) for r in violations(o).collect() if r.broken]
    if broken:
        raise InvariantError(str(broken))
