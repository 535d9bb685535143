from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.engine import Inputs, InvariantError, check, reconcile
from ledgerloom.rules import Rules

D = date(2026, 7, 10)
LEDGER = "record_id string, event_type string, business_ref string, original_ref string, merchant_account string, currency string, gross_minor bigint, event_date date"
PSP = ("record_id string, type string, business_ref string, merchant_account string, currency string, gross_minor bigint, fee_minor bigint, net_minor bigint, "
       "created_date date, available_on date, batch_id string, settlement_date date, bank_account string")  # fmt: skip
BANK = "record_id string, bank_account string, currency string, amount_minor bigint, value_date date, reference string"


def day(n):
    return D + timedelta(n)


def batch(name, net, at=0, account="BK1", currency="SGD", merchant="M1", n=0):
    return (f"P-{name}-{n}", "charge", f"R-{name}-{n}", merchant, currency, net, 0, net, day(at - 2), day(at - 1), name, day(at), account)


def line(name, amount, at=0, ref="", account="BK1", currency="SGD"):
    return (name, account, currency, amount, day(at), ref)


def run(spark, ledger=(), psp=(), bank=(), as_of=day(10), rules=Rules(), blocked=None, hints=None):
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((ledger, LEDGER), (psp, PSP), (bank, BANK))]
    return reconcile(Inputs(*frames, as_of, blocked, hints, rules))


def states(o, chain="B"):
    return {(r.record_type[0], r.record_id): r.status for r in o.states.where(F.col("chain") == chain).collect()}


def groups(o):
    members = o.members.join(o.groups.select("group_id", "rule"), "group_id").collect()
    out = {}
    for m in members:
        out.setdefault((m.group_id, m.rule), set()).add(m.record_id)
    return {(rule, frozenset(ids)) for (_, rule), ids in out.items()}


def scenarios():
    """Independent cases, each on a bank account of its own."""
    psp, bank, want, matched = [], [], {}, set()

    def case(account, batches, lines, expect, *found):
        psp.extend(batch(*b[:2], *b[2:3], account=account, **(b[3] if len(b) > 3 else {})) for b in batches)
        bank.extend(line(*k, **({"account": account} if len(k) < 5 else {})) for k in lines)
        want.update(expect)
        matched.update((rule, frozenset(ids)) for rule, *ids in found)

    unsure = "AMBIGUOUS_CANDIDATES"
    case("trap", [("T1", 10000, 0), ("T2", 10000, 3)], [("t1", 10000, 2), ("t2", 10000, 5)], {"T1": unsure, "T2": unsure, "t1": "AMBIGUOUS", "t2": "AMBIGUOUS"})
    case("rank", [("R1", 10000, 0), ("R2", 10000, 0)], [("r1", 10000, 0, "x R1"), ("r2", 10000, 0)], {"R1": "MATCHED", "r2": "MATCHED"}, ("B1_REF_1TO1", "R1", "r1"), ("B3_AMOUNT_DATE_UNIQUE", "R2", "r2"))
    case("contest", [("C1", 100, 0), ("C2", 200, 0), ("C3", 150, 0), ("C4", 150, 0)], [("c1", 300, 0)], {**dict.fromkeys(("C1", "C2", "C3", "C4"), unsure), "c1": "SUGGESTED"})
    case("suggest", [("G1", 111, 0), ("G2", 222, 0)], [("g1", 333, 0)], {"G1": "SUGGESTED_GROUP", "G2": "SUGGESTED_GROUP", "g1": "SUGGESTED"})
    case("parts", [("H1", 900, 0)], [("h1", 500, 0), ("h2", 400, 1)], {"H1": "SUGGESTED_GROUP", "h1": "SUGGESTED", "h2": "SUGGESTED"})
    case("rival", [("V1", 9000, 0)], [("v1", 4000, 0, "V1"), ("v2", 5000, 0, "V1"), ("v3", 9000, 0, "V1")], {"V1": unsure, "v1": "AMBIGUOUS", "v3": "AMBIGUOUS"})
    case("twice", [("W1", 5000, 0)], [("w1", 5000, 0, "W1"), ("w2", 5000, 9, "W1")], {"w2": "DUPLICATE_REFERENCE_CREDIT"}, ("B1_REF_1TO1", "W1", "w1"))
    case("several", [("E1", 5000, 0)], [("e1", 5000, 0, "E1"), ("e2", 5000, 1, "E1")], {"E1": unsure, "e1": "AMBIGUOUS"})
    case("split", [("L1", 5000, 0)], [("l1", 3000, 0, "L1"), ("l2", 2000, 1, "l1 L1")], {"L1": "MATCHED"}, ("B2S_REF_SPLIT", "L1", "l1", "l2"))
    case("merge", [("J1", 970, 0), ("J2", 485, 1)], [("j1", 1455, 1, "J1/J2")], {"J1": "MATCHED"}, ("B2M_REF_MERGED", "J1", "J2", "j1"))
    case("group", [("N1", 970, 0), ("N2", 485, 0)], [("n1", 1400, 0, "N1 N2")], {"N1": "AMOUNT_MISMATCH", "N2": "AMOUNT_MISMATCH", "n1": "HELD_FOR_REVIEW"})
    case("complex", [("X1", 100, 0), ("X2", 200, 0)], [("x1", 100, 0, "X1 X2"), ("x2", 200, 0, "X1,X2")], {"X1": "COMPLEX_REFERENCE", "X2": "COMPLEX_REFERENCE", "x1": "HELD_FOR_REVIEW"})
    case("part", [("Q1", 2000, 0)], [("q1", 1200, 0, "Q1")], {"Q1": "PARTIAL_RECEIPT", "q1": "HELD_FOR_REVIEW"})
    case("more", [("O1", 2000, 0)], [("o1", 2100, 0, "O1")], {"O1": "AMOUNT_MISMATCH"})
    case("late", [("D1", 2000, 0)], [("d1", 2000, 5, "D1")], {"D1": "DATE_OUT_OF_WINDOW"})
    case("own", [("A1", 2000, 0)], [("a1", 2000, 0, "A1", "other")], {"A1": "ACCOUNT_MISMATCH"})
    case("money", [("M1", 2000, 0)], [("m1", 2000, 0, "M1", "money", "USD")], {"M1": "CURRENCY_MISMATCH"})
    case("token", [("S1", 700, 0), ("S10", 800, 0)], [("s1", 800, 0, "s10")], {"S1": "MISSING_IN_BANK"}, ("B1_REF_1TO1", "S10", "s1"))
    case("left", [("Z1", 700, 9)], [("z1", -50, 0)], {"Z1": "IN_TRANSIT", "z1": "UNEXPECTED_BANK_DEBIT"})
    case("mixed", [("I1", 700, 0), ("I1", 100, 0, {"currency": "USD", "n": 1})], [("i1", 700, 0, "I1")], {"I1": "BATCH_INCONSISTENT", "i1": "HELD_FOR_REVIEW"})
    for off, match in ((-2, False), (-1, True), (0, True), (3, True), (4, False)):
        name = f"Y{off + 9}"
        case(name, [(name, 321, 0)], [(name.lower(), 321, off)], {name: "MATCHED" if match else "MISSING_IN_BANK"}, *([("B3_AMOUNT_DATE_UNIQUE", name, name.lower())] if match else []))
    return psp, bank, want, matched


def test_chain_b_scenarios_in_any_order(spark):
    psp, bank, want, matched = scenarios()
    o = run(spark, psp=psp, bank=bank)
    got = {ident: status for (_, ident), status in states(o).items()}
    assert {k: got[k] for k in want} == want
    assert groups(o) == matched
    again = run(spark, psp=psp[::-1], bank=bank[::-1])
    assert sorted(map(tuple, again.states.collect()), key=str) == sorted(map(tuple, o.states.collect()), key=str)
    assert sorted(map(tuple, again.groups.collect()), key=str) == sorted(map(tuple, o.groups.collect()), key=str)
    case = {r.case_key: r for r in o.exceptions.collect()}
    assert case["B|STL|Q1"].amount_minor == 800 and case["B|STL|N1"].amount_minor == 55 and case["B|STL|O1"].amount_minor == -100
    shown = {(r.record_type, r.record_id, r.role) for r in o.evidence.where("case_key = 'B|STL|Q1'").collect()}
    assert shown == {("settlement", "Q1", "settlement"), ("psp", "P-Q1-0", "settlement_item"), ("bank", "q1", "partial_receipt")}


def test_too_many_candidates_are_not_searched(spark):
    psp = [batch(f"S{i}", 100 + i) for i in range(6)]
    bank = [line("k", 203)]
    o = run(spark, psp=psp, bank=bank, rules=Rules(max_candidates=5))
    assert states(o)["b", "k"] == "UNEXPECTED_BANK_CREDIT"
    assert "too many" in o.exceptions.where("case_key = 'B|BANK|k'").first().explanation


def test_chain_a_cascade(spark):
    led = lambda n, gross=100, at=0, kind="SALE", cur="SGD", mer="M1": (f"L{n}", kind, f"R{n}", None, mer, cur, gross, day(at))
    psp = lambda n, gross=100, at=0, kind="charge", cur="SGD", mer="M1": (f"P{n}", kind, f"R{n}", mer, cur, gross, 0, gross, day(at), day(at), None, None, None)
    ledger = [led(1), led(2), led(3), led(4), led(5), led(6), led(7), led(8, at=7), led(9, at=8), led(10), led(13, at=30)]
    items = [psp(1), psp(2, cur="USD"), psp(3, kind="refund"), psp(4, gross=99), psp(5, at=2), psp(6, at=3), psp(7, mer="M2"), psp(11, at=8), psp(12, at=7)]
    items += [("F1", "fee", None, "M1", "SGD", 0, 5, -5, day(0), day(0), None, None, None), psp(10)]
    blocked = spark.createDataFrame([("psp", "P10", [4, 5])], "source string, record_id string, issue_ids array<long>")
    hints = spark.createDataFrame([("A|M1|R8", "see row 4")], "hint_key string, hint string")
    o = run(spark, ledger, items, blocked=blocked, hints=hints)
    got = states(o, "A")
    want = {"1": "MATCHED", "2": "CURRENCY_MISMATCH", "3": "TYPE_MISMATCH", "4": "AMOUNT_MISMATCH", "5": "MATCHED", "6": "DATE_OUT_OF_TOLERANCE", "7": "ACCOUNT_MISMATCH", "10": "SOURCE_CONFLICT"}
    assert {n: got["l", f"L{n}"] for n in want} == want == {n: got["p", f"P{n}"] for n in want}
    assert (got["l", "L8"], got["l", "L9"], got["p", "P11"], got["p", "P12"], got["p", "F1"]) == ("MISSING_IN_PSP", "PENDING", "PENDING", "MISSING_IN_LEDGER", "OUT_OF_SCOPE")
    assert ("l", "L13") not in got and {r.source: r.excluded for r in o.excluded.collect()}["ledger"] == 1
    cases = {r.case_key: (r.amount_minor, r.explanation) for r in o.exceptions.where("chain = 'A'").collect()}
    assert cases["A|M1|R4"][0] == 1 and cases["A|M1|R12"][0] == -100 and cases["A|M1|R8"][1].endswith("see row 4")
    assert o.evidence.where("record_type = 'row_issue'").count() == 2


def test_as_of_masks_later_settlements(spark):
    loose = ("P-2", *batch("S9", 500, at=-1)[1:10], None, None, None)
    psp = [batch("S1", 500, at=2), batch("S2", 500, at=1), loose]
    o = run(spark, psp=psp, as_of=day(1))
    assert states(o) == {("p", "P-S1-0"): "NOT_DUE", ("s", "S2"): "IN_TRANSIT", ("p", "P-2"): "UNSETTLED_OVERDUE"}


def test_no_records_and_broken_invariants(spark):
    o = run(spark)
    assert o.states.count() == o.groups.count() == o.exceptions.count() == 0
    full = run(spark, psp=[batch("S1", 500)], bank=[line("k", 500)])
    full.groups = full.groups.withColumn("right_total", F.lit(1))
    with pytest.raises(InvariantError, match="conservation"):
        check(full)


def test_evidence_grows_with_the_records_not_with_their_pairs(spark):
    """Hundreds of equal amounts on one day, and one reference that joins many settlements with many lines."""
    n = 300
    psp = [batch(f"E{i:04d}", 500) for i in range(n)] + [batch(f"C{i:02d}", 100 + i, account="BK2") for i in range(40)]
    names = " ".join(f"C{i:02d}" for i in range(40))
    bank = [line(f"e{i:04d}", 500) for i in range(n)] + [line(f"c{i:02d}", 7, ref=names, account="BK2") for i in range(50)]
    o = run(spark, psp=psp, bank=bank)
    assert {r.case_type for r in o.exceptions.where("chain = 'B'").collect()} == {"AMBIGUOUS_CANDIDATES", "COMPLEX_REFERENCE"}
    assert o.evidence.where("case_key LIKE 'B%'").count() <= 4 * (n + 40) and o.classes.count() == n + 50
    shown = o.evidence.where("record_type = 'class'").groupBy("record_id", "members", "role").count().collect()
    assert {(r.record_id, r.members, r.role, r["count"]) for r in shown} == {
        (f"U|BK1|SGD|500|{D}", n, "candidate", n), ("R|c00", 50, "referencing_line", 40),
    }
    assert {r.record_id for r in o.classes.where("class_key = 'R|c00'").collect()} == {f"c{i:02d}" for i in range(50)}


def test_other_merchants_of_a_reference_many_share(spark):
    ledger = [(f"L{i}", "SALE", "SAME", None, f"M{i:03d}", "SGD", 100, day(0)) for i in range(200)]
    psp = [("P1", "charge", "SAME", "M999", "SGD", 100, 0, 100, day(0), day(0), None, None, None)]
    o = run(spark, ledger=ledger, psp=psp)
    assert {r.status for r in o.states.where("chain = 'A'").collect()} == {"ACCOUNT_MISMATCH"}
    assert "M000" in o.exceptions.where("anchor_id = 'P1'").first().explanation
