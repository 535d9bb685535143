"""Chain A: ledger gross against provider gross, one full outer join and one decision cascade."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import money
from ..lineage import settle
from ..rules import Rules
from .results import EVIDENCE, EXCEPTION, GROUP, MEMBER, STATE, Found, shaped

RULES = {
    "SOURCE_CONFLICT": "A-X1_CONFLICT",
    "CURRENCY_MISMATCH": "A-X3_CURRENCY",
    "TYPE_MISMATCH": "A-X4_TYPE",
    "AMOUNT_MISMATCH": "A-X5_AMOUNT",
    "DATE_OUT_OF_TOLERANCE": "A-X6_DATE",
    "MATCHED": "A1_EXACT_REF",
    "ACCOUNT_MISMATCH": "A-X2_ACCOUNT",
    "PENDING": "A-T1_GRACE",
    "MISSING_IN_PSP": "A-X7_NO_PSP",
    "MISSING_IN_LEDGER": "A-X8_NO_LEDGER",
}


def _merchants(df: DataFrame, side: str) -> DataFrame:
    """Reference -> its first and last merchant: if any other than a given one has it, one of these two is another."""
    return df.groupBy("business_ref").agg(F.min("merchant_account").alias(f"{side}_first"), F.max("merchant_account").alias(f"{side}_last"))


def _other(side: str) -> Column:
    own = F.col("merchant_account")
    return F.when(F.col(f"{side}_first") != own, F.col(f"{side}_first")).when(F.col(f"{side}_last") != own, F.col(f"{side}_last"))


def _text(status: Column, as_of: date) -> Column:
    """What happened, for a reviewer."""
    led = F.concat(F.lit("ledger "), F.col("l_id"), F.lit(" "), money(F.col("l_gross"), F.col("l_cur")))
    psp = F.concat(F.lit("provider item "), F.col("p_id"), F.lit(" "), money(F.col("p_gross"), F.col("p_cur")))
    both = F.concat(led, F.lit(" and "), psp)
    return (
        F.when(status == "SOURCE_CONFLICT", F.lit("A source row of this reference conflicts with another one; blocked."))
        .when(status == "CURRENCY_MISMATCH", F.concat(both, F.lit(" are in different currencies.")))
        .when(status == "TYPE_MISMATCH", F.concat(both, F.lit(" are of different types: "), F.col("l_type"), F.lit(", "), F.col("p_type")))
        .when(status == "AMOUNT_MISMATCH", F.concat(both, F.lit(" differ by "), money(F.col("l_gross") - F.col("p_gross"), F.col("l_cur"))))
        .when(status == "DATE_OUT_OF_TOLERANCE", F.concat(both, F.lit(" lie "), F.col("days").cast("string"), F.lit(" days apart.")))
        .when(status == "MATCHED", F.concat(both, F.lit(" share reference, currency, type and gross.")))
        .when((status == "ACCOUNT_MISMATCH") & F.col("l_id").isNotNull(), F.concat(led, F.lit(" is booked under another merchant at the provider: "), F.col("p_other")))
        .when(status == "ACCOUNT_MISMATCH", F.concat(psp, F.lit(" is booked under another merchant in the ledger: "), F.col("l_other")))
        .when(F.col("l_id").isNotNull(), F.concat(led, F.lit(f" has no provider item by {as_of}.")))
        .otherwise(F.concat(psp, F.lit(f" has no ledger row by {as_of}.")))
    )


def decide(ledger: DataFrame, psp: DataFrame, blocked: DataFrame, as_of: date, rules: Rules = Rules()) -> DataFrame:
    """One row per (merchant, reference) with both sides, status, exposure and anchor date."""
    bad = blocked.select("source", "record_id", F.lit(True).alias("bad"))
    of = lambda source: bad.where(F.col("source") == source).drop("source")
    items = psp.where("type <> 'fee'")
    left = ledger.join(of("ledger"), "record_id", "left").select(
        "merchant_account", "business_ref", F.col("record_id").alias("l_id"), F.col("event_type").alias("l_type"),
        F.col("currency").alias("l_cur"), F.col("gross_minor").alias("l_gross"), F.col("event_date").alias("l_day"),
        F.col("bad").alias("l_bad"),
    )
    right = items.join(of("psp"), "record_id", "left").select(
        "merchant_account", "business_ref", F.col("record_id").alias("p_id"), F.col("type").alias("p_type"),
        F.col("currency").alias("p_cur"), F.col("gross_minor").alias("p_gross"), F.col("created_date").alias("p_day"),
        F.col("bad").alias("p_bad"),
    )
    pairs = (
        left.join(right, ["merchant_account", "business_ref"], "full")
        .join(_merchants(items, "p"), "business_ref", "left")
        .join(_merchants(ledger, "l"), "business_ref", "left")
        .withColumns({"p_other": _other("p"), "l_other": _other("l")})
        .withColumn("days", F.abs(F.datediff("l_day", "p_day")))
    )
    has_l, has_p = F.col("l_id").isNotNull(), F.col("p_id").isNotNull()
    both = has_l & has_p
    same_type = F.when(F.col("l_type") == "SALE", "charge").otherwise("refund") == F.col("p_type")
    age = F.datediff(F.lit(as_of), F.coalesce("l_day", "p_day"))
    status = (
        F.when(F.coalesce("l_bad", "p_bad", F.lit(False)), "SOURCE_CONFLICT")
        .when(both & (F.col("l_cur") != F.col("p_cur")), "CURRENCY_MISMATCH")
        .when(both & ~same_type, "TYPE_MISMATCH")
        .when(both & (F.col("l_gross") != F.col("p_gross")), "AMOUNT_MISMATCH")
        .when(both & (F.col("days") > rules.a_date_tolerance), "DATE_OUT_OF_TOLERANCE")
        .when(both, "MATCHED")
        .when(has_l & F.col("p_other").isNotNull(), "ACCOUNT_MISMATCH")
        .when(~has_l & F.col("l_other").isNotNull(), "ACCOUNT_MISMATCH")
        .when(age <= rules.a_grace, "PENDING")
        .when(has_l, "MISSING_IN_PSP")
        .otherwise("MISSING_IN_LEDGER")
    )
    rule = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    exposure = (
        F.when(F.col("status") == "SOURCE_CONFLICT", F.coalesce("l_gross", "p_gross"))
        .when(F.col("status") == "AMOUNT_MISMATCH", F.col("l_gross") - F.col("p_gross"))
        .when(has_l, F.col("l_gross"))
        .otherwise(-F.col("p_gross"))
    )
    return (
        pairs.withColumn("status", status)
        .withColumn("rule", rule[F.col("status")])
        .withColumn("exposure", exposure)
        .withColumn("anchor_date", F.coalesce("l_day", "p_day"))
        .withColumn("key", F.concat_ws("|", F.lit("A"), "merchant_account", "business_ref"))
        .withColumn("text", _text(F.col("status"), as_of))
    )


def chain_a(ledger: DataFrame, psp: DataFrame, blocked: DataFrame, hints: DataFrame | None, as_of: date, rules: Rules = Rules()) -> Found:
    pairs = settle(decide(ledger, psp, blocked, as_of, rules), "pairs")
    failed = ~F.col("status").isin("MATCHED", "PENDING")
    key = F.when(failed, F.col("key"))
    group = F.when(F.col("status") == "MATCHED", F.col("key"))
    common = {"chain": "A", "case_key": key, "group_key": group, "detail": F.col("text")}
    side = lambda p, kind: shaped(
        pairs.where(F.col(f"{p}_id").isNotNull()), STATE, record_type=kind, record_id=F.col(f"{p}_id"),
        currency=F.col(f"{p}_cur"), amount_minor=F.col(f"{p}_gross"), **common,
    )
    fees = shaped(
        psp.where("type = 'fee'"), STATE, chain="A", record_type="psp", status="OUT_OF_SCOPE", rule="A0_FEE_ROW",
        amount_minor=F.col("gross_minor"), detail="Provider fee; no ledger counterpart is expected.",
    )
    broken = pairs.where(failed)
    if hints is not None:
        noted = broken.join(hints.withColumnRenamed("hint_key", "key"), "key", "left")
        broken = noted.withColumn("text", F.concat_ws(" ", "text", "hint"))
    exceptions = shaped(
        broken, EXCEPTION, case_key=F.col("key"), chain="A", case_type=F.col("status"),
        anchor_type=F.when(F.col("l_id").isNotNull(), "ledger").otherwise("psp"), anchor_id=F.coalesce("l_id", "p_id"),
        currency=F.coalesce("l_cur", "p_cur"), amount_minor=F.col("exposure"), explanation=F.col("text"),
    )
    matched = pairs.where("status = 'MATCHED'")
    groups = shaped(
        matched, GROUP, group_key=F.col("key"), chain="A", currency=F.col("l_cur"), phase=F.lit(0),
        first_key=F.array("merchant_account", "business_ref"), second_key=F.array().cast("array<string>"),
        explanation=F.col("text"),
    )
    members = [
        shaped(matched, MEMBER, group_key=F.col("key"), side=s, record_type=kind, record_id=F.col(f"{p}_id"), amount_minor=F.col(f"{p}_gross"))
        for s, p, kind in (("L", "l", "ledger"), ("R", "p", "psp"))
    ]
    shown = [
        shaped(pairs.where(failed & F.col(f"{p}_id").isNotNull()), EVIDENCE, case_key=F.col("key"), record_type=kind, record_id=F.col(f"{p}_id"), role=kind)
        for p, kind in (("l", "ledger"), ("p", "psp"))
    ]
    for p, kind in (("l", "ledger"), ("p", "psp")):
        stands = pairs.where("status = 'SOURCE_CONFLICT'").select(F.col("key").alias("case_key"), F.col(f"{p}_id").alias("record_id"))
        issues = blocked.where(F.col("source") == kind).join(stands, "record_id").select("case_key", F.explode("issue_ids").alias("issue"))
        shown.append(shaped(issues, EVIDENCE, record_type="row_issue", record_id=F.col("issue").cast("string"), role="conflicting_row"))
    return Found([side("l", "ledger"), side("p", "psp"), fees], [exceptions], [groups], members, shown)
