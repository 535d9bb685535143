"""The frames in which every matching phase reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = {
    "chain": "string", "record_type": "string", "record_id": "string", "status": "string", "currency": "string",
    "amount_minor": "bigint", "rule": "string", "case_key": "string", "group_key": "string", "detail": "string",
}
EXCEPTION = {
    "case_key": "string", "chain": "string", "case_type": "string", "rule": "string", "anchor_type": "string",
    "anchor_id": "string", "currency": "string", "amount_minor": "bigint", "anchor_date": "date", "explanation": "string",
}
GROUP = {
    "group_key": "string", "chain": "string", "rule": "string", "currency": "string", "phase": "int",
    "first_key": "array<string>", "second_key": "array<string>", "explanation": "string",
}
MEMBER = {"group_key": "string", "side": "string", "record_type": "string", "record_id": "string", "amount_minor": "bigint"}
#: A record, or a class of ``members`` records that many cases may share; null members is one record.
EVIDENCE = {"case_key": "string", "record_type": "string", "record_id": "string", "role": "string", "members": "bigint"}
CLASS = {"class_key": "string", "record_type": "string", "record_id": "string"}


def shaped(df: DataFrame, schema: dict[str, str], **values: Column | str | None) -> DataFrame:
    """Project to the schema; missing columns are null, strings among ``values`` are literals."""
    def column(name: str, kind: str) -> Column:
        value = values.get(name, F.col(name) if name in df.columns else None)
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind).alias(name)

    return df.select(*[column(n, k) for n, k in schema.items()])


def union(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, frames) if frames else None


@dataclass
class Found:
    """What a phase found."""

    states: list[DataFrame]
    exceptions: list[DataFrame]
    groups: list[DataFrame]
    members: list[DataFrame]
    evidence: list[DataFrame]
    classes: list[DataFrame] = field(default_factory=list)

    def add(self, other: Found) -> None:
        for name in ("states", "exceptions", "groups", "members", "evidence", "classes"):
            getattr(self, name).extend(getattr(other, name))

    def joined(self, other: Found) -> Found:
        self.add(other)
        return self
