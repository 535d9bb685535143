import csv
import io
import json
from datetime import date

import pytest

from ledgerloom import cli
from ledgerloom.plans.cases import WorkflowError
from ledgerloom.plans.reports import SECTIONS, Report, write_page
from ledgerloom.store import Store
from ledgerloom.streaming.landing import watch

LEDGER = """ledger_entry_id,event_type,business_ref,original_ref,merchant_account,currency,gross_amount,event_date,extra
L1,SALE,R1,,M1,SGD,1000,2026-07-01,x
L2,SALE,R2,,M1,SGD,200.00,2026-07-01,
L1,SALE,R1,,M1,SGD,1000.00,2026-07-01,
L2,SALE,R2,,M1,SGD,201,2026-07-01,

L3,SALE,R3,,M1,SGD,abc,2026-07-02,
L4,SALE,R4,,M1,SGD,1
"""
PSP = """﻿psp_txn_id,type,business_ref,merchant_account,currency,gross_amount,fee_amount,net_amount,created_date,available_on,settlement_batch_id,settlement_date,bank_account
P1,charge,R1,M1,SGD,1000.00,20,980.00,2026-07-01,2026-07-02,STL-1,2026-07-03,BK
P3,charge,R3,M1,SGD,50,0,50,2026-07-02,2026-07-02,STL-2,2026-07-05,BK
"""
BANK = "bank_txn_id,bank_account,currency,amount,value_date,reference,description\nB1,BK,SGD,980,2026-07-03,pay STL-1,\n"
LATE = "bank_txn_id,bank_account,currency,amount,value_date,reference\nB2,BK,SGD,50,2026-07-06,STL-2\n"


@pytest.fixture()
def files(tmp_path):
    for name, text in (("ledger", LEDGER), ("psp", PSP), ("bank", BANK), ("late", LATE), ("short", "bank_txn_id,amount\n1,2\n"), ("none", ""), ("twice", BANK.replace("description", "amount"))):
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    (tmp_path / "latin.csv").write_bytes(BANK.encode() + b"\xff\xfe")
    return tmp_path


def test_from_files_to_reports(spark, files, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    done = store.import_file("ledger", f"{files}/ledger.csv")
    assert (done.status, done.read, done.loaded, done.duplicate, done.quarantined) == ("PARTIAL", 6, 2, 1, 3)
    reasons = {(r.source_row, r.reason) for r in store.table("issues").collect()}
    assert reasons == {(4, "DUPLICATE_ROW"), (5, "CONFLICT_RECORD_ID"), (6, "BAD_AMOUNT"), (7, "BAD_ROW_SHAPE")} and "extra" in done.message
    assert store.import_file("bank", f"{files}/ledger.csv").status == "DUPLICATE_FILE"
    for name in ("short", "none", "twice", "latin"):
        assert store.import_file("bank", f"{files}/{name}.csv").status == "REJECTED", name
    assert store.import_file("psp", f"{files}/psp.csv").status == "LOADED"
    assert store.import_file("bank", f"{files}/bank.csv").status == "LOADED"

    run, o = store.reconcile(date(2026, 7, 10))
    state = {r.record_id: r.status for r in o.states.collect() if r.chain == "A" or r.record_type != "psp"}
    assert state == {"L1": "MATCHED", "P1": "MATCHED", "L2": "SOURCE_CONFLICT", "P3": "MISSING_IN_LEDGER", "STL-1": "MATCHED", "B1": "MATCHED", "STL-2": "MISSING_IN_BANK"}
    case = {r.case_key: r for r in store.list_cases().collect()}
    assert set(case) == {"A|M1|R2", "A|M1|R3", "B|STL|STL-2"} and "quarantined" in case["A|M1|R3"].explanation
    shown = store.evidence_rows(run).collect()
    assert {r.file_name for r in shown if r.record_type != "settlement"} == {"ledger.csv", "psp.csv"}
    assert {(r.record_id, r.source_row) for r in shown if r.case_key == "A|M1|R2" and r.record_type == "ledger"} == {("L2", 3)}
    assert [r.source_row for r in shown if r.record_type == "row_issue"] == [5]
    assert {r.record_id for r in store.evidence_rows(run, "B|STL|STL-2").collect()} == {"STL-2", "P3"}

    missing = case["B|STL|STL-2"].case_id
    with pytest.raises(WorkflowError):
        store.set_status(missing, "Resolved", "ann", "NO_ACTION_REQUIRED", "short")
    with pytest.raises(WorkflowError):
        store.set_status(missing, "Resolved", "system", "NO_ACTION_REQUIRED", "long enough reason")
    store.assign(missing, "bob", "ann")
    store.add_note(missing, "called the bank", "ann")
    store.set_status(missing, "In review", "ann")
    store.set_status(case["A|M1|R2"].case_id, "Resolved", "ann", "SOURCE_DATA_CORRECTED", "source fixed, resend asked")
    listed = store.list_cases(chain="B").collect()
    assert [(r.owner, r.status, r.note_count) for r in listed] == [("bob", "In review", 1)]

    report = Report(store)
    assert report.live and report.exceptions().count() == 3
    assert store.import_file("bank", f"{files}/late.csv").status == "LOADED"
    old = Report(store, run)
    assert not old.live and {r.case_key for r in old.exceptions().collect()} == set(case)
    store.reconcile(date(2026, 7, 11))
    after = {r.case_key: (r.status, r.disposition, r.engine_active) for r in store.cases().collect()}
    assert after["B|STL|STL-2"] == ("Resolved", "AUTO_CLEARED", False)
    assert after["A|M1|R2"] == ("Resolved", "SOURCE_DATA_CORRECTED", True)
    versions = store.table("cases").count()
    back, _ = store.reconcile(date(2026, 7, 5))
    assert store.table("cases").count() == versions and not store.table("runs").where(f"run_id = {back}").first().case_sync
    made = Report(store).files()
    assert len(made) == 3 and all(name.startswith("eod_2026-07-05_run3_snapshot") for name in made)
    assert any("A (gross),ledger,SGD,matched,1,1000.00" in text for text in made.values())
    text = next(v for k, v in made.items() if k.endswith("summary.csv"))
    table = list(csv.DictReader(io.StringIO(text)))
    order = [SECTIONS.index(r["section"]) for r in table]
    assert order == sorted(order) and set(range(len(SECTIONS))) - set(order) <= {SECTIONS.index("match_groups")}
    bridge = {r["metric"]: (r["count"], r["amount"]) for r in Report(store, run).summary().where("section = 'settlement_bridge'").collect()}
    assert bridge == {"gross": ("2", "1050.00"), "fee": ("2", "20.00"), "net": ("2", "1030.00")}
    held = {r["source_row"]: (r["reason_code"], r["detail"]) for r in csv.DictReader(io.StringIO(next(v for k, v in made.items() if k.endswith("data_quality.csv"))))}
    assert held["6"] == ("BAD_AMOUNT", "gross_amount: 'abc'") and "cells" in held["7"][1] and held["5"][0] == "CONFLICT_RECORD_ID"
    about = json.loads(store.table("runs").where(f"run_id = {run}").first().summary)
    assert about["counts"]["settlements"] == 2 and about["rules"]["max_candidates"] == 12
    assert {r.value for r in store.filter_values().where("filter = 'currency'").collect()} == {"SGD"}
    actions = {r.action for r in store.table("audit").collect()}
    assert {"CASE_OPENED", "CASE_AUTO_CLEARED", "CASE_RESOLVED", "CASE_ASSIGNED", "NOTE_ADDED", "RUN_COMPLETED", "IMPORT_REJECTED"} <= actions


def test_strict_imports_are_all_or_nothing(spark, files, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.import_file("ledger", f"{files}/ledger.csv", strict=True).status == "REJECTED"
    assert store.table("ledger").count() == store.table("issues").count() == 0
    assert store.import_file("ledger", f"{files}/ledger.csv").status == "PARTIAL"


def test_a_stream_equals_the_batch(spark, files, tmp_path):
    for source in ("ledger", "psp", "bank"):
        folder = tmp_path / "landing" / source
        folder.mkdir(parents=True)
        (folder / f"{source}.csv").write_bytes((files / f"{source}.csv").read_bytes())
    store = Store(spark, str(tmp_path / "store"))
    watch(store, str(tmp_path / "landing"), date(2026, 7, 10)).awaitTermination()
    assert {r.case_key for r in store.cases().collect()} == {"A|M1|R2", "A|M1|R3", "B|STL|STL-2"}


def test_command_line(spark, files, tmp_path, capsys):
    root = ["--root", str(tmp_path / "store")]
    assert cli.main([*root, "import", "bank", f"{files}/short.csv"]) == 1
    assert cli.main([*root, "import", "bank", f"{files}/bank.csv"]) == 0
    assert cli.main([*root, "report", "--out", str(tmp_path)]) == 1
    assert "LOADED" in capsys.readouterr().out


def test_the_demo_and_paged_lists(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path / "new")]
    assert cli.main([*root, "demo", "--out", str(tmp_path / "out" / "deep")]) == 0
    assert len(list((tmp_path / "out" / "deep").iterdir())) == 4
    assert "<h2>settlement_bridge</h2>" in next((tmp_path / "out" / "deep").glob("*.html")).read_text()
    assert cli.main([*root, "demo", "--out", str(tmp_path)]) == 2
    capsys.readouterr()
    assert cli.main([*root, "cases", "--limit", "2", "--offset", "1"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    store = Store(spark, str(tmp_path / "new"))
    got = {r.case_key: r.case_type for r in store.list_cases().collect()}
    assert got == {
        "A|SHOP-1|ORD-01": "SOURCE_CONFLICT", "A|SHOP-1|ORD-04": "AMOUNT_MISMATCH", "A|SHOP-1|ORD-10": "MISSING_IN_LEDGER",
        "B|STL|BATCH-3": "MISSING_IN_BANK", "B|BANK|B-4": "UNEXPECTED_BANK_DEBIT",
    }
    assert {r.rule for r in store.table("groups").where("chain = 'B'").collect()} == {"B1_REF_1TO1", "B2S_REF_SPLIT", "B3_AMOUNT_DATE_UNIQUE"}
    assert cli.main(["--root", str(tmp_path / "void"), "init-db"]) == 0 and Store(spark, str(tmp_path / "void")).exists()


def test_cells_are_escaped(spark):
    write_page(file := io.StringIO(), "t", iter([("x", ["h"], iter([["<script>"]]))]))
    assert "<script>" not in file.getvalue()
