import random

from ledgerloom.operators import validate
from ledgerloom.operators.dedupe import dedupe

GOOD = {
    "ledger": dict(ledger_entry_id="L1", event_type="sale", business_ref="R1", original_ref="", merchant_account="M1", currency="sgd", gross_amount="10", event_date="2026-07-01", description=None),
    "psp": dict(psp_txn_id="P1", type="Charge", business_ref="R1", merchant_account="M1", currency="USD", gross_amount="10.00", fee_amount="1", net_amount="9.0",
                created_date="2026-07-01", available_on="2026-07-02", settlement_batch_id="B1", settlement_date="2026-07-05", bank_account="K1"),
    "bank": dict(bank_txn_id="B1", bank_account="K1", currency="EUR", amount="-3", value_date="2026-07-01", reference="x", description=None),
}
CASES = {
    "ledger": [
        ({}, None), ({"currency": ""}, "MISSING_VALUE"), ({"currency": "JPY"}, "UNSUPPORTED_CURRENCY"), ({"event_type": " "}, "MISSING_VALUE"),
        ({"event_type": "VOID"}, "BAD_VALUE"), ({"gross_amount": "x"}, "BAD_AMOUNT"), ({"gross_amount": "0"}, "SIGN_RULE"),
        ({"event_type": "REFUND", "gross_amount": "1", "original_ref": "R0"}, "SIGN_RULE"), ({"original_ref": "a b"}, "BAD_IDENTIFIER"),
        ({"event_type": "REFUND", "gross_amount": "-1"}, "MISSING_VALUE"), ({"ledger_entry_id": ""}, "MISSING_VALUE"), ({"business_ref": "a|b"}, "BAD_IDENTIFIER"),
        ({"merchant_account": "M" * 65}, "BAD_IDENTIFIER"), ({"event_date": ""}, "MISSING_VALUE"), ({"event_date": "2026-7-1"}, "BAD_DATE"),
        ({"currency": "JPY", "gross_amount": "x"}, "UNSUPPORTED_CURRENCY"), ({"currency": None}, "MISSING_VALUE"),
    ],
    "psp": [
        ({}, None), ({"type": "payout"}, "BAD_VALUE"), ({"net_amount": "9.01"}, "NET_MISMATCH"), ({"fee_amount": ""}, "BAD_AMOUNT"),
        ({"gross_amount": "-10", "net_amount": "-11"}, "SIGN_RULE"), ({"type": "fee"}, "SIGN_RULE"), ({"type": "fee", "gross_amount": "0", "net_amount": "-1", "business_ref": ""}, None),
        ({"business_ref": ""}, "MISSING_VALUE"), ({"settlement_batch_id": "a/b"}, "BAD_IDENTIFIER"), ({"settlement_date": "x"}, "BAD_DATE"),
        ({"bank_account": ""}, "MISSING_VALUE"), ({"settlement_batch_id": ""}, "BAD_VALUE"), ({"settlement_batch_id": "", "settlement_date": ""}, None),
        ({"psp_txn_id": "-x"}, "BAD_IDENTIFIER"), ({"available_on": ""}, "MISSING_VALUE"),
    ],
    "bank": [({}, None), ({"amount": "0.00"}, "BAD_AMOUNT"), ({"bank_txn_id": ""}, "MISSING_VALUE"), ({"value_date": "01/07/2026"}, "BAD_DATE"), ({"reference": None}, None)],
}


def test_the_first_broken_rule_gives_the_reason(spark):
    for source, cases in CASES.items():
        columns = validate.REQUIRED[source] + validate.OPTIONAL[source]
        rows = [(i, *[(GOOD[source] | change)[c] for c in columns]) for i, (change, _) in enumerate(cases)]
        frame = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} string" for c in columns))
        got = {r.i: r.reason for r in validate.PARSERS[source](frame).collect()}
        assert [got[i] for i in range(len(cases))] == [want for _, want in cases], source


def test_content_is_what_was_parsed(spark):
    columns = validate.REQUIRED["ledger"] + validate.OPTIONAL["ledger"]
    rows = [tuple((GOOD["ledger"] | c)[x] for x in columns) for c in ({}, {"gross_amount": "10.00", "currency": " SGD "}, {"gross_amount": "10.01"})]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    hashes = [r.content_hash for r in validate.records(validate.ledger(frame), "ledger").collect()]
    assert len(set(hashes)) == 2


def test_a_description_is_content(spark):
    """Rows alike but for their description conflict, and an empty one is none."""
    for source in ("ledger", "bank"):
        columns = validate.REQUIRED[source] + validate.OPTIONAL[source]
        rows = [tuple((GOOD[source] | {"description": d})[x] for x in columns) for d in (None, " ", "one", " one ", "two")]
        frame = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
        hashes = [r.content_hash for r in validate.records(validate.PARSERS[source](frame), source).collect()]
        assert [hashes.index(h) for h in hashes] == [0, 0, 2, 2, 4]
        bare = validate.records(validate.PARSERS[source](frame.drop("description").limit(1)), source).first()
        assert bare.content_hash == hashes[0] and bare.description == ""


def test_dedupe_against_stored_records(spark):
    rng = random.Random(18)
    rows = [(i, f"r{rng.randrange(60)}", rng.choice([None, *(f"k{j}" for j in range(40))]), rng.choice("ab")) for i in range(160)]
    want = sequential(rows)
    schema = "ord int, record_id string, business_key string, content_hash string"
    stored = spark.createDataFrame([r for r in rows[:80] if want[r[0]][0] == "LOADED"], schema)
    got = {r.ord: (r.verdict, r.conflicts_with) for r in dedupe(spark.createDataFrame(rows[80:], schema), stored).collect()}
    assert got == {r[0]: want[r[0]] for r in rows[80:]}


def test_the_cell_to_blame_is_shown(spark):
    columns = validate.REQUIRED["psp"]
    rows = [tuple((GOOD["psp"] | c)[x] for x in columns) for c in ({"net_amount": "9.01"}, {"bank_account": ""}, {})]
    got = [r.detail for r in validate.psp(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))).collect()]
    assert got == ["net_amount: '9.01'", "bank_account: ''", None]


def sequential(rows):
    """Load one after another."""
    ids, keys, out = {}, {}, {}
    for order, ident, key, content in sorted(rows):
        if ident in ids:
            out[order] = ("DUPLICATE_ROW" if ids[ident][1] == content else "CONFLICT_RECORD_ID", ids[ident][0])
        elif key is not None and key in keys:
            out[order] = ("CONFLICT_BUSINESS_KEY", keys[key])
        else:
            ids[ident] = (order, content)
            if key is not None:
                keys[key] = order
            out[order] = ("LOADED", None)
    return out


def test_dedupe_equals_loading_in_order(spark):
    rng = random.Random(8)
    for n in (0, 40, 200):
        rows = [(i, f"r{rng.randrange(n // 2 + 1)}", rng.choice([None, *(f"k{j}" for j in range(n // 3 + 1))]), rng.choice("ab")) for i in range(n)]
        frame = spark.createDataFrame(rows, "ord int, record_id string, business_key string, content_hash string")
        got = {r.ord: (r.verdict, r.conflicts_with) for r in dedupe(frame.repartition(3)).collect()}
        assert got == sequential(rows)
