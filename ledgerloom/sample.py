"""A small sample: three files of invented records that meet most rules, for trying the engine out."""

from __future__ import annotations

import csv
import os
from datetime import date, timedelta

from .operators.validate import OPTIONAL, REQUIRED

AS_OF = date(2026, 3, 20)
_DAY = date(2026, 3, 2)


def _on(n: int) -> str:
    return (_DAY + timedelta(n)).isoformat()


def rows() -> dict[str, list[dict[str, str]]]:
    """source -> cells by column: twelve orders in four batches, one of each common fault."""
    ledger, psp, bank = [], [], []
    for i in range(12):
        gross, ref, batch = 100 + 5 * i, f"ORD-{i:02d}", i // 3
        sale = {"ledger_entry_id": f"L-{i:02d}", "event_type": "SALE", "business_ref": ref, "merchant_account": "SHOP-1", "currency": "EUR",
                "gross_amount": f"{gross}.00", "event_date": _on(i // 3)}
        item = {"psp_txn_id": f"P-{i:02d}", "type": "charge", "business_ref": ref, "merchant_account": "SHOP-1", "currency": "EUR", "gross_amount": str(gross),
                "fee_amount": "2.5", "net_amount": f"{gross - 2.5:.2f}", "created_date": _on(i // 3), "available_on": _on(i // 3 + 1),
                "settlement_batch_id": f"BATCH-{batch}", "settlement_date": _on(batch + 3), "bank_account": "IBAN-1"}
        if i != 10:  # booked by the provider alone
            ledger.append(sale)
        psp.append(item | ({"gross_amount": str(gross - 1), "net_amount": f"{gross - 3.5:.2f}"} if i == 4 else {}))
    ledger += [ledger[0], ledger[1] | {"gross_amount": "106.00"}, ledger[2] | {"ledger_entry_id": "L-90", "business_ref": "ORD-90", "gross_amount": "1e3"}]
    psp.append(psp[0] | {"psp_txn_id": "P-90", "business_ref": "ORD-91", "net_amount": "1"})
    nets = [sum(float(p["net_amount"]) for p in psp[3 * b : 3 * b + 3]) for b in range(4)]
    line = lambda i, amount, day, ref: {"bank_txn_id": f"B-{i}", "bank_account": "IBAN-1", "currency": "EUR", "amount": f"{amount:.2f}",
                                        "value_date": _on(day), "reference": ref}
    bank += [line(0, nets[0], 3, "payout batch-0"), line(1, nets[1] - 50, 4, "BATCH-1"), line(2, 50, 5, "BATCH-1 rest"), line(3, nets[2], 6, "incoming"), line(4, -7, 6, "account fee")]
    return {"ledger": ledger, "psp": psp, "bank": bank}


def write(folder: str) -> dict[str, str]:
    """Write the files; source -> path."""
    os.makedirs(folder, exist_ok=True)
    paths = {}
    for source, cells in rows().items():
        paths[source] = os.path.join(folder, f"{source}.csv")
        with open(paths[source], "w", encoding="utf-8", newline="") as file:
            writer = csv.DictWriter(file, REQUIRED[source] + OPTIONAL[source], restval="", lineterminator="\n")
            writer.writeheader()
            writer.writerows(cells)
    return paths
