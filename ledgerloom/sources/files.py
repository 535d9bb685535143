"""Source files: identity by content, CSV rows with their numbers, and the structural checks of a whole file."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import OPTIONAL, REQUIRED


def identities(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, content) of every file under ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content")


def _rows(content: bytes, source: str) -> tuple[str | None, list[str], Iterator[tuple[int, dict, bool]]]:
    """(why the file is refused, unknown columns, rows as (number, cells, misshapen))."""
    try:
        reader = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""))
        header = [h.strip().lower() for h in next(reader, [])]
    except (UnicodeDecodeError, csv.Error) as e:
        return f"unreadable: {e}", [], iter(())
    if not any(header):
        return "empty file", [], iter(())
    if len(set(header)) < len(header):
        return "repeated column names", [], iter(())
    missing = [c for c in REQUIRED[source] if c not in header]
    if missing:
        return f"missing columns: {', '.join(missing)}", [], iter(())
    unknown = [c for c in header if c not in REQUIRED[source] + OPTIONAL[source]]

    def cells() -> Iterator[tuple[int, dict, bool]]:
        number = 1
        for row in reader:
            if row:
                number += 1
                yield number, dict(zip(header, row)), len(row) != len(header)

    return None, unknown, cells()


def _scan_batches(source: str):
    columns = REQUIRED[source] + OPTIONAL[source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                refused, unknown, rows = _rows(content, source)
                out = [{"sha256": sha, "source_row": 0, "refused": refused, "unknown": ",".join(unknown), "misshapen": False, "raw": ""} | dict.fromkeys(columns)]
                try:
                    for number, cell, odd in rows:
                        raw = json.dumps(cell, ensure_ascii=False)
                        out.append({"sha256": sha, "source_row": number, "refused": None, "unknown": "", "misshapen": odd, "raw": raw} | {c: cell.get(c) for c in columns})
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_pylist(out, _schema(columns))
                            out = []
                except csv.Error as e:
                    out.append({"sha256": sha, "source_row": 0, "refused": f"unreadable: {e}", "unknown": "", "misshapen": False, "raw": ""} | dict.fromkeys(columns))
                yield pa.RecordBatch.from_pylist(out, _schema(columns))

    return run


def _schema(columns: list[str]) -> pa.Schema:
    text = [(c, pa.string()) for c in columns]
    return pa.schema([("sha256", pa.string()), ("source_row", pa.int32()), ("refused", pa.string()), ("unknown", pa.string()), ("misshapen", pa.bool_()), ("raw", pa.string()), *text])


def scan(files: DataFrame, source: str) -> DataFrame:
    """(sha256, content) -> text rows numbered from 2 as in the file's records; row 0 tells of the file itself:
    why it is refused, if it is, and which columns are unknown. A file is one unit of work; many run in parallel."""
    columns = REQUIRED[source] + OPTIONAL[source]
    text = ", ".join(f"`{c}` string" for c in columns)
    return files.select("sha256", "content").mapInArrow(
        _scan_batches(source), f"sha256 string, source_row int, refused string, unknown string, misshapen boolean, raw string, {text}"
    )


def large_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The scale path for files too large for one task: split by Spark's own reader, without row numbers; rows of
    another shape carry ``_corrupt_record``."""
    columns = REQUIRED[source] + OPTIONAL[source]
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_corrupt_record"])
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", enforceSchema=False)
