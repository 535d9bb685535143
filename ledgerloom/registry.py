"""The engine's queries over the derived views, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle, views
from .functions.money import fmt_minor, parse_amount, to_plain
from .functions.text import csv_safe
from .lineage import settle, settle_all
from .operators import asof, chain_b, dedupe, validate
from .operators.numbering import numbered
from .operators.settlements import bridge
from .plans import cases, summary
from .plans.engine import Inputs, Outcome, reconcile, violations

Query = Callable[[SparkSession, str], DataFrame]
EARLIER = views.AS_OF.replace(day=20)


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """When the order tables changed last: what is kept of them holds no longer than that."""
    path = lambda n: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet")
    system = path("orders").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.sparkContext.applicationId, *(system.getFileStatus(path(n)).getModificationTime() for n in ("orders", "customer", "nation"))


@lru_cache(maxsize=16)
def _sides(stamp: tuple, sf_dir: str, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    ledger, psp = settle_all((views.ledger(spark, sf_dir), "ledger"), (views.psp(spark, sf_dir), "psp"))
    return ledger, psp, settle(views.bank(spark, sf_dir, psp), "bank")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger, provider and bank records, written once per session and state of the directory."""
    return _sides(_stamp(spark, sf_dir), sf_dir, spark)


@lru_cache(maxsize=16)
def _blocked(stamp: tuple, sf_dir: str, spark: SparkSession) -> DataFrame:
    return settle(views.blocked(spark, sf_dir, *sides(spark, sf_dir)[:2]), "blocked")


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocked(_stamp(spark, sf_dir), sf_dir, spark)


@lru_cache(maxsize=16)
def _outcome(stamp: tuple, sf_dir: str, spark: SparkSession, as_of) -> Outcome:
    return reconcile(Inputs(*sides(spark, sf_dir), as_of, blocked(spark, sf_dir)))


def outcome(spark: SparkSession, sf_dir: str, as_of=views.AS_OF) -> Outcome:
    """A run of the engine; its frames are tables, so that queries share them."""
    return _outcome(_stamp(spark, sf_dir), sf_dir, spark, as_of)


def _of(f: Callable[[Outcome], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(outcome(spark, sf_dir))


def _states(where: str) -> Query:
    return _of(lambda o: o.states.where(where).select("record_type", "record_id", "status", "currency", "amount_minor", "rule"))


def _cases(where: str) -> Query:
    return _of(lambda o: o.exceptions.where(where).select("case_key", "case_type", "rule", "currency", "amount_minor", "anchor_date"))


def _groups(where: str) -> Query:
    return _of(lambda o: o.groups.where(where).join(o.members, "group_id").select("group_id", "rule", "currency", "left_total", "side", "record_id", F.col("amount_minor")))


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' ledger rows as file text, with faults that depend on the key. Some rows come twice, alike or with
    another amount or description; some are booked again under another id."""
    k = F.expr("cast(substring(record_id, 3) as bigint)")
    rows = sides(spark, sf_dir)[0].where("record_id RLIKE '^L-[0-9]+$'").withColumn("k", k)
    k = F.col("k")
    minor = F.when(k % 229 == 13, -F.col("gross_minor")).otherwise(F.col("gross_minor"))
    text = F.when(k % 173 == 1, "12.345").when(k % 173 == 2, "1e3").when(k % 173 == 3, "").otherwise(to_plain(minor))
    one = rows.select(
        "k", F.lit(0).alias("copy"), F.col("record_id").alias("ledger_entry_id"), F.col("event_type"),
        F.when(k % 191 == 6, F.concat("business_ref", F.lit("|x"))).otherwise(F.col("business_ref")).alias("business_ref"),
        F.coalesce("original_ref", F.lit("")).alias("original_ref"), "merchant_account",
        F.when(k % 181 == 5, "JPY").otherwise(F.col("currency")).alias("currency"), text.alias("gross_amount"),
        F.when(k % 179 == 4, "2026-13-01").otherwise(F.col("event_date").cast("string")).alias("event_date"), F.lit("").alias("description"), "gross_minor",
    )
    again = one.where((k % 193 == 7) | (k % 197 == 8) | (k % 211 == 12)).withColumns({
        "copy": F.lit(1), "description": F.when(k % 211 == 12, "again").otherwise(""),
        "gross_amount": F.when(k % 197 == 8, to_plain(F.col("gross_minor") + 1)).otherwise(F.col("gross_amount")),
    })
    other = one.where(k % 223 == 11).withColumns({"copy": F.lit(2), "ledger_entry_id": F.concat("ledger_entry_id", F.lit("-B"))})
    return one.unionByName(again).unionByName(other).drop("gross_minor")


@lru_cache(maxsize=16)
def _parsed(stamp: tuple, sf_dir: str, spark: SparkSession) -> DataFrame:
    return settle(validate.ledger(settle(raw_ledger(spark, sf_dir), "raw-ledger")), "parsed-ledger")


def parsed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated once per session and directory, as an import does."""
    return _parsed(_stamp(spark, sf_dir), sf_dir, spark)


def ledger_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_ledger(spark, sf_dir).select(
        "k", F.col("copy").cast("bigint"), F.coalesce("reason", F.lit("")).alias("reason"),
        F.when(F.col("reason").isNull(), F.col("gross_minor")).alias("gross_minor"),
        F.when(F.col("reason").isNull(), F.col("event_day")).alias("event_day"),
    )


def ledger_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parsed_ledger(spark, sf_dir)
    good = validate.records(parsed.withColumn("source_row", F.col("k") * 4 + F.col("copy")), "ledger")
    found = dedupe.dedupe(good.withColumn("ord", F.col("source_row")))
    return found.select("record_id", F.col("ord").cast("bigint"), "verdict", F.col("conflicts_with").cast("bigint"))


def conflict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that conflict with a loaded one, and the record that stands."""
    found = settle(ledger_dedupe(spark, sf_dir), "verdicts")
    stands = found.select(F.col("ord").alias("conflicts_with"), F.col("record_id").alias("stands"))
    return found.where("verdict LIKE 'CONFLICT%'").join(stands, "conflicts_with").select("record_id", "verdict", "ord", "stands")


def blocked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a conflicting row names, by id or by business key."""
    return conflict_rows(spark, sf_dir).select(F.col("stands").alias("record_id")).distinct()


def raw_psp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = sides(spark, sf_dir)[1], F.col("k")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fee = F.when(k % 173 == 1, F.col("fee_minor") + 1).otherwise(F.col("fee_minor"))
    return p.select(
        "k", F.col("record_id").alias("psp_txn_id"), F.when(k % 179 == 4, "payout").otherwise(F.col("type")).alias("type"),
        F.when(k % 191 == 6, "").otherwise(F.col("business_ref")).alias("business_ref"), "merchant_account", "currency",
        to_plain(F.col("gross_minor")).alias("gross_amount"), to_plain(fee).alias("fee_amount"), to_plain(F.col("net_minor")).alias("net_amount"),
        text("created_date").alias("created_date"), F.when(k % 181 == 5, "2026-7-1").otherwise(text("available_on")).alias("available_on"),
        text("batch_id").alias("settlement_batch_id"), F.when(k % 193 == 7, "").otherwise(text("settlement_date")).alias("settlement_date"),
        text("bank_account").alias("bank_account"),
    )


def raw_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n = sides(spark, sf_dir)[2], F.substring("record_id", 10, 8).cast("int") % 101
    return b.select(
        F.col("record_id").alias("bank_txn_id"), F.when(n == 1, "").otherwise(F.col("bank_account")).alias("bank_account"),
        F.lower("currency").alias("currency"), F.when(n == 2, "0.00").when(n == 3, "1,000").otherwise(to_plain(F.col("amount_minor"))).alias("amount"),
        F.when(n == 4, "").otherwise(F.col("value_date").cast("string")).alias("value_date"), "reference",
    )


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and printed amounts of a fixed set of texts, signs and sizes."""
    m = sides(spark, sf_dir)[1].select(F.col("record_id"), F.col("net_minor"))
    shown = m.withColumn("plain", to_plain(F.col("net_minor")))
    return shown.select("record_id", "plain", fmt_minor(F.col("net_minor")).alias("shown"), parse_amount(F.concat(F.lit(" +"), F.abs("net_minor").cast("string"), F.lit(".100 "))).alias("parsed"))


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("k") % 5 == 0, F.concat(F.lit("="), "business_ref")).when(F.col("k") % 5 == 1, F.concat(F.lit("-"), F.col("k").cast("string"))).when(F.col("k") % 5 == 2, F.concat(F.lit("@"), "type")).otherwise(F.col("merchant_account"))
    return sides(spark, sf_dir)[1].select("record_id", csv_safe(cell).alias("cell"))


def reference_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no conflict blocks, and the batches that their references name."""
    o, bad = outcome(spark, sf_dir), blocked(spark, sf_dir).where("source = 'bank'").select("record_id")
    return chain_b.reference_links(o.bank.join(bad, "record_id", "left_anti").withColumnRenamed("record_id", "bank_id"), o.settlements)


def case_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What syncing cases of two runs, two days apart, would do."""
    before = cases.opened(outcome(spark, sf_dir, EARLIER).exceptions, 1)
    return cases.difference(outcome(spark, sf_dir).exceptions, before).select("case_key", "action")


def case_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases and engine events of three runs, two days apart. After the first a person resolves the settlement cases of
    every other scene."""
    days = [views.AS_OF.replace(day=d) for d in (18, 20, 22)]
    first, *later = (outcome(spark, sf_dir, d) for d in days)
    scene = F.regexp_extract("case_key", r"STL-S([0-9]+)-", 1).try_cast("int")
    by_hand = F.coalesce(F.floor(scene / views.SCENE_EVERY) % 2 == 0, F.lit(False))
    known, events = cases.opened(first.exceptions, 1), []
    known = known.withColumns({"status": F.when(by_hand, "Resolved").otherwise(F.col("status")), "disposition": F.when(by_hand, "NO_ACTION_REQUIRED").otherwise("")})
    for number, run in enumerate(later, 2):
        known, told = cases.sync(run.exceptions, settle(known, "cases"), run.states, number)
        events.append(told)
    return known, events[0].unionByName(events[1])


def case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every open case of chain B in the list that a person reads."""
    listed = cases.listed(cases.opened(outcome(spark, sf_dir).exceptions, 1), status="Open", chain="B").select("case_id", "case_key", "anchor_date")
    return numbered(listed, ["anchor_date", "case_id"], "place").select("case_key", F.col("case_id").cast("bigint"), F.col("place").cast("bigint"))


def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's exceptions with the state of the cases that an earlier run had opened."""
    before = cases.opened(outcome(spark, sf_dir, EARLIER).exceptions, 1)
    return cases.snapshot(outcome(spark, sf_dir).exceptions, before).select("case_key", "status", "owner", "disposition")


def component_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements and lines of each component of references, by its first settlement."""
    o, links = outcome(spark, sf_dir), settle(reference_links(spark, sf_dir), "links")
    held = links.join(o.settlements.where("problem IS NOT NULL").select("batch_id"), "batch_id").select("bank_id").distinct()
    usable = links.join(held, "bank_id", "left_anti").join(o.settlements.where("problem IS NULL").select("batch_id"), "batch_id")
    of = chain_b.components(usable.select("bank_id", "batch_id"))
    return of.groupBy("comp").agg(F.min("batch_id").alias("first_batch"), F.count_distinct("batch_id").alias("n_s"), F.count_distinct("bank_id").alias("n_k")).drop("comp")


def _joined_ids(members: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """key -> the records of both sides as one text; sides hold at most a few records."""
    ids = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return members.groupBy(key).agg(F.concat_ws("=", ids(left), ids(right)).alias("pair"))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chain: groups matched among orders' records, those that the generator doesn't confirm, the groups that it
    meant to be matched, and how many of these were. Chain B compares whole groups."""
    o = outcome(spark, sf_dir)
    side = lambda x: F.when(F.col("side") == x, F.col("record_id"))
    of_orders = o.members.where("record_id NOT LIKE '_-S%' AND record_id NOT LIKE 'STL-S%' AND record_id NOT LIKE 'B-CASE%'")
    found = _joined_ids(of_orders.withColumn("chain", F.substring("group_id", 1, 1)), "group_id", side("L"), side("R")).withColumn("chain", F.substring("group_id", 1, 1))
    key = F.col("k").cast("string")
    clean = F.expr("k % 89 <> 5 AND k % 97 <> 3 AND k % 211 <> 9 AND NOT (k % 101 = 11 AND NOT refund) AND k % 83 <> 7 AND k % 199 <> 9 AND k % 197 <> 8 AND k % 227 <> 10")
    orders = views.base(spark, sf_dir).where("k % 89 <> 5 AND k % 97 <> 3 AND k % 199 <> 9")
    chain_a = orders.select(F.lit("A").alias("chain"), F.concat(F.lit("L-"), key, F.lit("=P-"), key).alias("pair"), (clean & (F.date_add("day", 2) <= F.lit(views.AS_OF))).alias("meant"))
    meant = views.payouts(sides(spark, sf_dir)[1])
    pairs = _joined_ids(meant, "event", F.col("batch_id"), F.col("record_id"))
    wanted = meant.groupBy("event").agg(F.max("meant").alias("meant"))
    truth = chain_a.unionByName(pairs.join(wanted, "event").select(F.lit("B").alias("chain"), "pair", "meant"))
    joined = found.select("chain", "pair", F.lit(True).alias("matched")).join(truth.withColumn("true", F.lit(True)), ["chain", "pair"], "full")
    return joined.groupBy("chain").agg(
        F.count_if("matched").alias("matched"), F.count_if(F.col("matched") & F.col("true").isNull()).alias("false_matches"),
        F.count_if("meant").alias("meant"), F.count_if(F.col("meant") & F.col("matched")).alias("found"),
    )


def queries() -> dict[str, Query]:
    side = lambda i: lambda spark, sf: sides(spark, sf)[i]
    on_sides = lambda f: lambda spark, sf: f(*sides(spark, sf))
    return {
        "ledger_view": side(0),
        "psp_view": lambda spark, sf: sides(spark, sf)[1].drop("nation", "k"),
        "bank_view": side(2),
        "amount_formats": amounts,
        "csv_guard": guarded,
        "ledger_validate": ledger_validate,
        "psp_validate": lambda spark, sf: validate.psp(raw_psp(spark, sf)).select("k", F.coalesce("reason", F.lit("")).alias("reason")),
        "bank_validate": lambda spark, sf: validate.bank(raw_bank(spark, sf)).select("record_id", F.coalesce("reason", F.lit("")).alias("reason")),
        "dedupe_rows": ledger_dedupe,
        "conflict_rows": conflict_rows,
        "blocked_records": blocked_records,
        "import_control_totals": on_sides(summary.control_totals),
        "input_ranges": on_sides(summary.input_ranges),
        "default_as_of": on_sides(lambda a, b, c: asof.default_as_of(a, b, c, views.AS_OF)),
        "as_of_counts": _of(lambda o: o.excluded),
        "chain_a_status": _states("chain = 'A'"),
        "chain_a_groups": _groups("chain = 'A'"),
        "chain_a_exceptions": _cases("chain = 'A'"),
        "chain_a_account_mismatch": _cases("chain = 'A' AND case_type = 'ACCOUNT_MISMATCH'"),
        "settlements": _of(lambda o: o.settlements.select("batch_id", "bank_account", "currency", "settlement_date", "gross", "fee", "net", "items", F.coalesce("problem", F.lit("")).alias("problem"))),
        "settlement_bridge": _of(lambda o: bridge(o.settlements)),
        "unsettled_items": _states("chain = 'B' AND record_type = 'psp'"),
        "reference_links": reference_links,
        "reference_matches": _groups("rule LIKE 'B1%' OR rule LIKE 'B2%'"),
        "amount_matches": _groups("rule LIKE 'B3%'"),
        "reference_exceptions": _cases("rule IN ('B-X3_BATCH_PROBLEM', 'B-X7_ACCOUNT_OR_CURRENCY', 'B-X9_DATE', 'B-X10_PARTIAL', 'B-X11_REF_AMOUNT', 'B-X12_REF_GROUP', 'B-X13_COMPLEX')"),
        "duplicate_credits": _cases("rule = 'B-X8_DUP_REF'"),
        "ambiguous": _cases("rule = 'B-X4_AMBIGUOUS'"),
        "group_suggestions": _cases("rule = 'B4_AMOUNT_GROUP_SUGGESTION'"),
        "leftovers": _cases("rule IN ('B-X5_NO_BANK', 'B-X6_NO_SETTLEMENT')"),
        "record_status_all": _states("true"),
        "status_breakdown": _of(lambda o: summary.status_breakdown(o.states)),
        "side_rollup": _of(lambda o: summary.side_rollup(o.states)),
        "groups_by_rule": _of(lambda o: summary.groups_by_rule(o.groups)),
        "exceptions_by_type": _of(lambda o: summary.exceptions_by_type(o.exceptions)),
        "open_exposure": _of(lambda o: summary.open_exposure(o.exceptions)),
        "overdue_cases": _of(lambda o: summary.ageing(o.exceptions, views.AS_OF).where("overdue").select("case_key", F.col("age_days").cast("bigint"))),
        "run_counts": _of(summary.run_counts),
        "summary_long": _of(summary.long_format),
        "settlement_problems": _of(lambda o: o.settlements.where("problem IS NOT NULL").select("batch_id", "problem", "items")),
        "component_shapes": component_shapes,
        "capped_lines": _of(lambda o: o.exceptions.where("rule = 'B-X6_NO_SETTLEMENT' AND explanation LIKE '%too many candidates%'").select("case_key")),
        "filter_values": _of(lambda o: cases.filter_values(o.exceptions)),
        "evidence_rows": _of(lambda o: o.evidence),
        "evidence_classes": _of(lambda o: o.classes),
        "case_sync_diff": case_diff,
        "case_events": lambda spark, sf: case_runs(spark, sf)[1].select("run_id", "case_key", "action"),
        "case_states": lambda spark, sf: case_runs(spark, sf)[0].select("case_key", "status", "disposition", "engine_active", "first_seen_run", "last_seen_run"),
        "case_list": case_list,
        "run_snapshot": run_snapshot,
        "invariants": _of(violations),
        "eval_metrics": eval_metrics,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
