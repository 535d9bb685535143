"""A reconciliation store in Parquet: append-only tables, committed by the event written last.

Records, issues, states and the like are written once under their import or run. Imports and runs become visible with
their own event, so readers never see the half of one; cases are versions, of which the last counts.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import settle
from .operators import dedupe, validate
from .operators.asof import default_as_of
from .plans import cases as case_plan
from .plans.engine import Inputs, Outcome, reconcile
from .plans.summary import as_json
from .rules import RULES_VERSION, Rules
from .sources.files import identities, scan

SOURCES = ("ledger", "psp", "bank")
#: Names of stored columns and of audit actions that readers of the tables rely on.
_KEY = "record_id string, business_key struct<merchant:string,ref:string>, content_hash string, import_id bigint, source_row int"
SCHEMAS = {
    "imports": "import_id bigint, source string, file_name string, sha256 string, status string, message string, rows_read bigint, "
    "rows_loaded bigint, rows_duplicate bigint, rows_quarantined bigint, totals string",
    "issues": "issue_id bigint, import_id bigint, source string, source_row int, kind string, reason string, detail string, record_id string, conflicts_with string, raw string",
    "ledger": "event_type string, business_ref string, original_ref string, merchant_account string, currency string, gross_minor bigint, event_date date, description string, " + _KEY,
    "psp": "type string, business_ref string, merchant_account string, currency string, gross_minor bigint, fee_minor bigint, net_minor bigint, "
    "created_date date, available_on date, batch_id string, settlement_date date, bank_account string, " + _KEY,
    "bank": "bank_account string, currency string, amount_minor bigint, value_date date, reference string, description string, " + _KEY,
    "runs": "run_id bigint, as_of date, rules string, high_water bigint, fingerprint string, case_sync boolean, elapsed_ms bigint, summary string",
    "states": "run_id bigint, chain string, record_type string, record_id string, status string, currency string, amount_minor bigint, rule string, "
    "case_key string, detail string, group_id string",
    "groups": "run_id bigint, group_id string, chain string, rule string, currency string, explanation string, left_total bigint, right_total bigint",
    "members": "run_id bigint, group_id string, side string, record_type string, record_id string, amount_minor bigint",
    "run_exceptions": "run_id bigint, case_key string, case_id bigint, chain string, case_type string, rule string, anchor_type string, anchor_id string, "
    "currency string, amount_minor bigint, anchor_date date, explanation string, status string, owner string, disposition string",
    "evidence": "run_id bigint, case_key string, record_type string, record_id string, role string, members bigint",
    "classes": "run_id bigint, class_key string, record_type string, record_id string",
    "cases": "event_id bigint, " + case_plan.CASE,
    "notes": "case_id bigint, actor string, text string",
    "audit": case_plan.AUDIT,
}


@dataclass
class ImportResult:
    import_id: int
    status: str
    message: str
    read: int = 0
    loaded: int = 0
    duplicate: int = 0
    quarantined: int = 0


class Store:
    """Tables under ``root``, a path that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def table(self, name: str) -> DataFrame:
        fs, path = self._path(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def append(self, name: str, df: DataFrame) -> None:
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(f"{self.root}/{name}")

    def _next(self, name: str, column: str) -> int:
        return (self.table(name).agg(F.max(column)).first()[0] or 0) + 1

    def _event(self, name: str, row: dict) -> None:
        self.append(name, self.spark.createDataFrame([tuple(row.get(f.split(" ")[0]) for f in SCHEMAS[name].split(", "))], SCHEMAS[name]))

    def records(self, source: str, high_water: int | None = None) -> DataFrame:
        """Records of committed imports up to the high-water mark."""
        done = self.table("imports").where("status IN ('LOADED', 'PARTIAL')").select("import_id")
        kept = self.table(source).join(done, "import_id", "left_semi")
        return kept if high_water is None else kept.where(F.col("import_id") <= high_water)

    # ------------------------------------------------------------ imports

    def import_file(self, source: str, path: str, strict: bool = False) -> ImportResult:
        """Load one file: refuse it as a whole, skip it as known, or load its good rows and quarantine the rest."""
        number = self._next("imports", "import_id")
        file = identities(self.spark, path)
        row = file.select("path", "sha256").first()  # a file without bytes has no row
        name, sha = row or (path, hashlib.sha256(b"").hexdigest())
        base = {"import_id": number, "source": source, "file_name": name.rsplit("/", 1)[-1], "sha256": sha}
        base |= dict.fromkeys(("rows_read", "rows_loaded", "rows_duplicate", "rows_quarantined"), 0) | {"totals": "{}"}

        def ended(status: str, message: str, **counts) -> ImportResult:
            self._event("imports", base | {"status": status, "message": message} | {f"rows_{k}": v for k, v in counts.items()})
            self._event("audit", {"run_id": None, "case_key": None, "actor": "system", "action": f"IMPORT_{status}", "detail": message})
            return ImportResult(number, status, message, **counts)

        known = self.table("imports").where((F.col("sha256") == sha) & F.col("status").isin("LOADED", "PARTIAL")).first()
        if known:
            return ended("DUPLICATE_FILE", f"same content as import {known.import_id}; nothing loaded")
        if row is None:
            return ended("REJECTED", "empty file")
        rows = settle(scan(file, source), "rows")
        about = rows.where("source_row = 0").agg(F.max("refused").alias("refused"), F.max("unknown").alias("unknown")).first()
        if about.refused:
            return ended("REJECTED", about.refused)
        text = rows.where("source_row > 0").withColumn("import_id", F.lit(number).cast("bigint"))
        odd = F.col("misshapen")
        parsed = validate.PARSERS[source](text).withColumns({
            "reason": F.when(odd, "BAD_ROW_SHAPE").otherwise(F.col("reason")),
            "detail": F.when(odd, "the row has more or fewer cells than the header").otherwise(F.col("detail")),
        })
        parsed = settle(parsed, "parsed")
        order = F.struct("import_id", "source_row")
        stored = self.records(source).withColumn("ord", order)
        judged = settle(dedupe.dedupe(validate.records(parsed, source).withColumn("ord", order), stored), "judged")
        bad = parsed.where("reason IS NOT NULL").select("source_row", F.lit("QUARANTINED").alias("kind"), "reason", "detail", "record_id", F.lit(None).cast("string").alias("conflicts_with"), "raw")
        blocker = F.concat_ws(":", F.col("conflicts_with.import_id"), F.col("conflicts_with.source_row"))
        twice = judged.where("verdict <> 'LOADED'").select(
            "source_row", F.when(F.col("verdict") == "DUPLICATE_ROW", "DUPLICATE").otherwise("QUARANTINED").alias("kind"), F.col("verdict").alias("reason"),
            F.concat_ws(" ", F.lit("the record of import and row"), blocker, F.lit("stands")).alias("detail"), "record_id",
            blocker.alias("conflicts_with"), "raw",
        )
        issues = settle(bad.unionByName(twice), "issues")
        read, loaded = text.count(), judged.where("verdict = 'LOADED'").count()
        counts = {r.kind: r["count"] for r in issues.groupBy("kind").count().collect()}
        dup, held = counts.get("DUPLICATE", 0), counts.get("QUARANTINED", 0)
        if read != loaded + dup + held:
            raise AssertionError("rows read are not rows loaded, duplicate and quarantined")
        if strict and held:
            first = ", ".join(r.reason for r in issues.where("kind = 'QUARANTINED'").orderBy("source_row").limit(5).collect())
            return ended("REJECTED", f"strict: {held} rows would be quarantined ({first})", read=read)
        self.append(source, judged.where("verdict = 'LOADED'"))
        self.append("issues", issues.withColumns({"issue_id": F.col("source_row") + F.lit(number * (1 << 32)), "import_id": F.lit(number), "source": F.lit(source)}))
        amount = {"ledger": "gross_minor", "psp": "net_minor", "bank": "amount_minor"}[source]
        sums = judged.where("verdict = 'LOADED'").groupBy("currency").agg(F.count("*").alias("count"), F.sum(amount).alias("amount_minor")).orderBy("currency")
        base["totals"] = json.dumps({r.currency: {"count": r["count"], "amount_minor": r.amount_minor} for r in sums.collect()})
        note = f"; unknown columns ignored: {about.unknown}" if about.unknown else ""
        message = f"read {read}, loaded {loaded}, duplicate {dup}, quarantined {held}{note}"
        return ended("PARTIAL" if held else "LOADED", message, read=read, loaded=loaded, duplicate=dup, quarantined=held)

    def blocked(self, high_water: int) -> DataFrame:
        """Records that a conflicting row names, whatever its date."""
        done = self.table("imports").where("status IN ('LOADED', 'PARTIAL')").select("import_id")
        clash = self.table("issues").join(done, "import_id", "left_semi").where((F.col("import_id") <= high_water) & F.col("reason").startswith("CONFLICT"))
        parts = F.split("conflicts_with", ":")
        at = clash.select("source", "issue_id", parts[0].cast("bigint").alias("import_id"), parts[1].cast("int").alias("source_row"), "record_id")
        out = None
        for source in SOURCES:
            own = at.where(F.col("source") == source)
            named = own.select("issue_id", "import_id", "source_row").join(self.records(source, high_water).select("import_id", "source_row", "record_id"), ["import_id", "source_row"])
            rows = named.groupBy("record_id").agg(F.sort_array(F.collect_set("issue_id")).alias("issue_ids")).select(F.lit(source).alias("source"), "record_id", "issue_ids")
            out = rows if out is None else out.unionByName(rows)
        return out

    def hints(self, high_water: int) -> DataFrame:
        """(hint_key, hint): what was quarantined under a business key, ledger rows first."""
        held = self.table("issues").where((F.col("kind") == "QUARANTINED") & ~F.col("reason").startswith("CONFLICT") & (F.col("import_id") <= high_water))
        ref, merchant = (F.trim(F.coalesce(F.get_json_object("raw", f"$.{c}"), F.lit(""))) for c in ("business_ref", "merchant_account"))
        text = F.concat(F.lit("A "), "source", F.lit(" row of this reference was quarantined: "), "reason", F.lit(", row "), F.col("source_row").cast("string"), F.lit("."))
        rows = held.select(F.concat_ws("|", F.lit("A"), merchant, ref).alias("hint_key"), ref.alias("ref"), F.struct(F.when(F.col("source") == "ledger", 0).otherwise(1).alias("o"), "issue_id", text.alias("t")).alias("h"))
        return rows.where("ref <> ''").groupBy("hint_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["t"]), " ").alias("hint"))

    # ------------------------------------------------------------ runs

    def cases(self) -> DataFrame:
        return case_plan.current(self.table("cases"))

    def reconcile(self, as_of: date | None = None, rules: Rules = Rules()) -> tuple[int, Outcome]:
        """Run the engine on what is loaded. A run before the latest synced as-of date leaves the cases alone."""
        began, run_id = time.time(), self._next("runs", "run_id")
        imports = self.table("imports")
        high = imports.agg(F.max("import_id")).first()[0] or 0
        sides = [self.records(s, high) for s in SOURCES]
        as_of = as_of or default_as_of(*sides, date.today()).first()[0]
        good = imports.where("status IN ('LOADED', 'PARTIAL')")
        mark = good.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "|"), 256)).first()[0]
        last = self.table("runs").where("case_sync").agg(F.max("as_of")).first()[0]
        synced = last is None or as_of >= last
        found = reconcile(Inputs(*sides, as_of, self.blocked(high), self.hints(high), rules))
        cases = self.cases()
        if synced:
            after, events = case_plan.sync(case_plan.with_evidence(found.exceptions, found.evidence), cases, found.states, run_id)
            after = settle(after, "cases")
            self.append("audit", events)
            self.append("cases", after.withColumn("event_id", F.lit(self._next("cases", "event_id"))))
            cases = after
        tag = lambda df: df.withColumn("run_id", F.lit(run_id))
        for name in ("states", "groups", "members", "evidence", "classes"):
            self.append(name, tag(getattr(found, name)))
        self.append("run_exceptions", tag(case_plan.snapshot(found.exceptions, cases)))
        about = as_json(found, as_of)
        self._event("audit", {"run_id": run_id, "case_key": None, "actor": "system", "action": "RUN_COMPLETED", "detail": json.dumps(json.loads(about)["counts"])})
        self._event("runs", {"run_id": run_id, "as_of": as_of, "rules": RULES_VERSION, "high_water": high, "fingerprint": mark, "case_sync": synced,
                             "elapsed_ms": int(1000 * (time.time() - began)), "summary": about})
        return run_id, found

    # ------------------------------------------------------------ case work

    def _case(self, case_id: int) -> dict:
        row = self.cases().where(F.col("case_id") == case_id).first()
        if row is None:
            raise case_plan.WorkflowError(f"no case {case_id}")
        return row.asDict()

    def _work(self, case: dict, event: dict | None) -> dict:
        if not event:
            return case
        changed = case | event["change"]
        if event["change"]:
            self._event("cases", changed | {"event_id": self._next("cases", "event_id")})
        self._event("audit", {"run_id": None, "case_key": case["case_key"], "actor": event["actor"], "action": event["action"], "detail": json.dumps(event["change"])})
        return changed

    def set_status(self, case_id: int, status: str, actor: str, disposition: str = "", reason: str = "") -> dict:
        case = self._case(case_id)
        return self._work(case, case_plan.status_event(case, status, actor, disposition, reason))

    def assign(self, case_id: int, owner: str, actor: str) -> dict:
        case = self._case(case_id)
        return self._work(case, case_plan.assign_event(case, owner, actor))

    def add_note(self, case_id: int, text: str, actor: str) -> None:
        case, event = self._case(case_id), case_plan.note_event(text, actor)
        self._event("notes", {"case_id": case_id, "actor": event["actor"], "text": event["text"]})
        self._work(case, event)

    def list_cases(self, **filters: str | None) -> DataFrame:
        return case_plan.listed(self.cases(), self.table("notes"), **filters)

    def evidence_rows(self, run_id: int, case_key: str | None = None) -> DataFrame:
        """Evidence of a run with the source row and file that each record or row issue came from; settlements and classes
        have none. With a case, classes give way to the records in them."""
        of_run = lambda name: self.table(name).where(F.col("run_id") == run_id).drop("run_id")
        shown = of_run("evidence")
        if case_key is not None:
            shown = shown.where(F.col("case_key") == case_key)
            member = of_run("classes").select(F.col("class_key").alias("record_id"), F.struct("record_type", "record_id").alias("r"))
            listed = shown.where("record_type = 'class'").join(member, "record_id").select("case_key", "r.record_type", "r.record_id", "role", F.lit(1).cast("bigint").alias("members"))
            shown = shown.where("record_type <> 'class'").unionByName(listed.distinct())
        files = self.table("imports").select("import_id", "file_name", "sha256")
        issues = self.table("issues").select(F.col("issue_id").cast("string").alias("record_id"), "import_id", "source_row")
        places = issues.select(F.lit("row_issue").alias("record_type"), "*")
        for source in SOURCES:
            places = places.unionByName(self.records(source).select(F.lit(source).alias("record_type"), "record_id", "import_id", "source_row"))
        return shown.join(places, ["record_type", "record_id"], "left").join(files, "import_id", "left").select(
            "case_key", "record_type", "record_id", "role", "members", "source_row", "file_name", "sha256"
        )

    def exists(self) -> bool:
        fs, path = self._path("")
        return fs.exists(path)

    def create(self) -> None:
        """Make the store's folder, so that it can be looked at before anything is imported."""
        fs, path = self._path("")
        fs.mkdirs(path)

    def filter_values(self) -> DataFrame:
        return case_plan.filter_values(self.cases())

    def latest(self, name: str, key: str, k: int) -> DataFrame:
        """The k last rows of a log."""
        return self.table(name).orderBy(F.desc(key)).limit(k)
