"""Command line: python -m ledgerloom.cli --root DIR COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import SparkSession

from . import sample
from .plans.cases import WorkflowError
from .plans.reports import Report
from .store import SOURCES, Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerloom")
    top.add_argument("--root", required=True, help="folder of the store, shared by all executors")
    sub = top.add_subparsers(dest="command", required=True)
    load = sub.add_parser("import")
    load.add_argument("source", choices=SOURCES)
    load.add_argument("file")
    load.add_argument("--strict", action="store_true")
    sub.add_parser("reconcile").add_argument("--as-of", type=date.fromisoformat)
    report = sub.add_parser("report")
    report.add_argument("--run", type=int)
    report.add_argument("--out", required=True)
    sub.add_parser("init-db")
    sub.add_parser("load-sample")
    sub.add_parser("demo").add_argument("--out", required=True)
    cases = sub.add_parser("cases")
    cases.add_argument("--limit", type=int, help="rows to show, all without it")
    cases.add_argument("--offset", type=int, default=0)
    for name in ("status", "chain", "case_type", "currency"):
        cases.add_argument(f"--{name.replace('_', '-')}")
    for name in ("case-note", "case-status", "case-assign"):
        work = sub.add_parser(name)
        work.add_argument("case_id", type=int)
        work.add_argument("value")
        work.add_argument("--actor", required=True)
        work.add_argument("--disposition", default="")
        work.add_argument("--reason", default="")
    sub.add_parser("watch").add_argument("folder")
    return top


def _load_sample(store: Store) -> None:
    for source, path in sample.write(f"{store.root}/sample").items():
        print(source, store.import_file(source, path).message)


def _demo(store: Store, out: str) -> int:
    """The sample from files to reports, in a store that is not there yet."""
    if store.exists():
        print(f"{store.root} exists already; a demo needs a new one", file=sys.stderr)
        return 2
    _load_sample(store)
    print("run", store.reconcile(sample.AS_OF)[0])
    print(*Report(store).write(out), sep="\n")
    return 0


def _show_cases(store: Store, a: argparse.Namespace) -> None:
    """One case a line, streamed, however many there are."""
    listed = store.list_cases(status=a.status, chain=a.chain, case_type=a.case_type, currency=a.currency).offset(a.offset)
    listed = listed.limit(a.limit) if a.limit is not None else listed
    names = ["case_id", "status", "owner", "case_type", "currency", "amount_minor", "anchor_date", "case_key", "note_count"]
    print(*names, sep="\t")
    for row in listed.select(*names).toLocalIterator():
        print(*row, sep="\t")


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    store = Store(SparkSession.builder.getOrCreate(), a.root)
    try:
        if a.command == "init-db":
            store.create()
        elif a.command == "import":
            done = store.import_file(a.source, a.file, a.strict)
            print(done.status, done.message)
            return int(done.status == "REJECTED")
        elif a.command == "load-sample":
            _load_sample(store)
        elif a.command == "demo":
            return _demo(store, a.out)
        elif a.command == "reconcile":
            print("run", store.reconcile(a.as_of)[0])
        elif a.command == "report":
            print(*Report(store, a.run).write(a.out), sep="\n")
        elif a.command == "cases":
            _show_cases(store, a)
        elif a.command == "case-note":
            store.add_note(a.case_id, a.value, a.actor)
        elif a.command == "case-status":
            store.set_status(a.case_id, a.value, a.actor, a.disposition, a.reason)
        elif a.command == "case-assign":
            store.assign(a.case_id, a.value, a.actor)
        else:
            from .streaming.landing import watch

            watch(store, a.folder).awaitTermination()
    except (WorkflowError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
