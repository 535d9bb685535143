"""Row rules of the three sources. The first rule that a row breaks gives its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_amount
from ..functions.text import IDENTIFIER, iso_date, stripped
from ..rules import CURRENCIES

#: The columns of each source's files, those that must be there first.
REQUIRED = {
    "ledger": ["ledger_entry_id", "event_type", "business_ref", "original_ref", "merchant_account", "currency",
               "gross_amount", "event_date"],
    "psp": ["psp_txn_id", "type", "business_ref", "merchant_account", "currency", "gross_amount", "fee_amount",
            "net_amount", "created_date", "available_on", "settlement_batch_id", "settlement_date", "bank_account"],
    "bank": ["bank_txn_id", "bank_account", "currency", "amount", "value_date", "reference"],
}
OPTIONAL = {"ledger": ["description"], "psp": [], "bank": ["description"]}


def _prepared(raw: DataFrame, source: str, *amounts: str) -> DataFrame:
    """Cells without outer white space and parsed amounts, each computed once, beside the raw columns."""
    given = [*REQUIRED[source], *(c for c in OPTIONAL[source] if c in raw.columns)]
    cells = raw.withColumns({f"__{c}": stripped(F.col(c)) for c in given})
    return cells.withColumns({f"__{c}_minor": parse_amount(F.col(f"__{c}")) for c in amounts})


def _note(raw: DataFrame) -> Column:
    """The description, which is free text and may be missing."""
    return (_cell("description") if "description" in raw.columns else F.lit("")).alias("note")


def _cell(name: str) -> Column:
    return F.col(f"__{name}")


def _minor(name: str) -> Column:
    return F.col(f"__{name}_minor")


Rule = tuple[Column, str, str]  # what breaks it, the reason, the cell to blame


def _first(*rules: Rule) -> tuple[Column, Column]:
    """The first broken rule's reason, and the cell that broke it with its text; null if none is broken."""
    reason = field = F
    for broken, code, cell in rules:
        reason, field = reason.when(broken, F.lit(code)), field.when(broken, F.lit(cell))
    cells = F.create_map(*[x for c in dict.fromkeys(r[2] for r in rules) for x in (F.lit(c), _cell(c))])
    blamed = field.otherwise(F.lit(None).cast("string"))
    shown = F.concat(blamed, F.lit(": '"), cells[blamed], F.lit("'"))
    return reason.otherwise(F.lit(None).cast("string")).alias("reason"), shown.alias("detail")


def _ident(name: str, required: bool = True) -> list[Rule]:
    v = _cell(name)
    blank = [(v == "", "MISSING_VALUE", name)] if required else []
    return [*blank, ((v != "") & ~v.rlike(IDENTIFIER), "BAD_IDENTIFIER", name)]


def _date(name: str, required: bool = True) -> list[Rule]:
    v = _cell(name)
    blank = [(v == "", "MISSING_VALUE", name)] if required else []
    return [*blank, ((v != "") & iso_date(v).isNull(), "BAD_DATE", name)]


def _currency() -> list[Rule]:
    v = F.upper(_cell("currency"))
    return [(v == "", "MISSING_VALUE", "currency"), (~v.isin(*CURRENCIES), "UNSUPPORTED_CURRENCY", "currency")]


def _amount(name: str) -> list[Rule]:
    return [(_minor(name).isNull(), "BAD_AMOUNT", name)]


def ledger(raw: DataFrame) -> DataFrame:
    """Text columns of a ledger file -> parsed columns and ``reason`` (null if the row is good)."""
    kind, gross = F.upper(_cell("event_type")), _minor("gross_amount")
    reason = _first(
        *_currency(),
        (kind == "", "MISSING_VALUE", "event_type"),
        (~kind.isin("SALE", "REFUND"), "BAD_VALUE", "event_type"),
        *_amount("gross_amount"),
        (((kind == "SALE") & (gross <= 0)) | ((kind == "REFUND") & (gross >= 0)), "SIGN_RULE", "gross_amount"),
        *_ident("original_ref", False),
        ((kind == "REFUND") & (_cell("original_ref") == ""), "MISSING_VALUE", "original_ref"),
        *_ident("ledger_entry_id"),
        *_ident("business_ref"),
        *_ident("merchant_account"),
        *_date("event_date"),
    )
    return _prepared(raw, "ledger", "gross_amount").select(
        *[F.col(c) for c in raw.columns],
        _cell("ledger_entry_id").alias("record_id"),
        kind.alias("kind"),
        _cell("business_ref").alias("ref"),
        _cell("original_ref").alias("original"),
        _cell("merchant_account").alias("merchant"),
        F.upper(_cell("currency")).alias("cur"),
        gross.alias("gross_minor"),
        iso_date(_cell("event_date")).alias("event_day"),
        _note(raw),
        *reason,
    )


def psp(raw: DataFrame) -> DataFrame:
    """Text columns of a provider file -> parsed columns and ``reason``."""
    kind = F.lower(_cell("type"))
    gross, fee, net = (_minor(f"{x}_amount") for x in ("gross", "fee", "net"))
    batch, day, account = (_cell(x) for x in ("settlement_batch_id", "settlement_date", "bank_account"))
    sign = ((kind == "charge") & (gross <= 0)) | ((kind == "refund") & (gross >= 0)) | ((kind == "fee") & (gross != 0))
    reason = _first(
        *_currency(),
        (kind == "", "MISSING_VALUE", "type"),
        (~kind.isin("charge", "refund", "fee"), "BAD_VALUE", "type"),
        *_amount("gross_amount"),
        *_amount("fee_amount"),
        *_amount("net_amount"),
        (net != gross - fee, "NET_MISMATCH", "net_amount"),
        (sign, "SIGN_RULE", "gross_amount"),
        *_ident("business_ref", False),
        ((kind != "fee") & (_cell("business_ref") == ""), "MISSING_VALUE", "business_ref"),
        *_ident("settlement_batch_id", False),
        *_date("settlement_date", False),
        *_ident("bank_account", False),
        ((batch != "") & (day == ""), "MISSING_VALUE", "settlement_date"),
        ((batch != "") & (account == ""), "MISSING_VALUE", "bank_account"),
        ((batch == "") & (day != ""), "BAD_VALUE", "settlement_date"),
        *_ident("psp_txn_id"),
        *_ident("merchant_account"),
        *_date("created_date"),
        *_date("available_on"),
    )
    return _prepared(raw, "psp", "gross_amount", "fee_amount", "net_amount").select(
        *[F.col(c) for c in raw.columns],
        _cell("psp_txn_id").alias("record_id"),
        kind.alias("kind"),
        _cell("business_ref").alias("ref"),
        _cell("merchant_account").alias("merchant"),
        F.upper(_cell("currency")).alias("cur"),
        gross.alias("gross_minor"),
        fee.alias("fee_minor"),
        net.alias("net_minor"),
        iso_date(_cell("created_date")).alias("created_day"),
        iso_date(_cell("available_on")).alias("available_day"),
        F.nullif(batch, F.lit("")).alias("batch_id"),
        iso_date(day).alias("settlement_day"),
        F.nullif(account, F.lit("")).alias("account"),
        *reason,
    )


def bank(raw: DataFrame) -> DataFrame:
    """Text columns of a bank file -> parsed columns and ``reason``."""
    amount = _minor("amount")
    reason = _first(
        *_currency(), *_amount("amount"), (amount == 0, "BAD_AMOUNT", "amount"), *_ident("bank_txn_id"), *_ident("bank_account"),
        *_date("value_date"),
    )
    return _prepared(raw, "bank", "amount").select(
        *[F.col(c) for c in raw.columns],
        _cell("bank_txn_id").alias("record_id"),
        _cell("bank_account").alias("account"),
        F.upper(_cell("currency")).alias("cur"),
        amount.alias("amount_minor"),
        iso_date(_cell("value_date")).alias("value_day"),
        _cell("reference").alias("memo"),
        _note(raw),
        *reason,
    )


PARSERS = {"ledger": ledger, "psp": psp, "bank": bank}
#: The parsed columns that make a record's content, and how records are stored.
CONTENT = {
    "ledger": {"kind": "event_type", "ref": "business_ref", "original": "original_ref", "merchant": "merchant_account",
               "cur": "currency", "gross_minor": "gross_minor", "event_day": "event_date", "note": "description"},
    "psp": {"kind": "type", "ref": "business_ref", "merchant": "merchant_account", "cur": "currency",
            "gross_minor": "gross_minor", "fee_minor": "fee_minor", "net_minor": "net_minor",
            "created_day": "created_date", "available_day": "available_on", "batch_id": "batch_id",
            "settlement_day": "settlement_date", "account": "bank_account"},
    "bank": {"account": "bank_account", "cur": "currency", "amount_minor": "amount_minor", "value_day": "value_date",
             "memo": "reference", "note": "description"},
}


def records(parsed: DataFrame, source: str) -> DataFrame:
    """Good rows as records: record_id, business key (null where there is none), content hash, stored columns."""
    names = CONTENT[source]
    keyed = F.struct(F.col("merchant"), F.col("ref")) if source != "bank" else F.lit(None).cast("struct<merchant:string,ref:string>")
    key = F.when(F.col("kind") != "fee", keyed) if source == "psp" else keyed
    content = F.sha2(F.to_json(F.struct("record_id", *sorted(names)), {"ignoreNullFields": "false"}), 256)
    extra = [c for c in ("import_id", "source_row", "raw") if c in parsed.columns]
    return parsed.where("reason IS NULL").select(
        "record_id", *[F.col(k).alias(v) for k, v in names.items()], key.alias("business_key"),
        content.alias("content_hash"), *extra,
    )
