"""Text expressions: identifiers, dates, reference tokens, and guarded CSV cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9._:#-]{0,63}\z"


def stripped(text: Column) -> Column:
    """Without white space (by Unicode) at both ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A\s+|\s+\z", "")


def iso_date(text: Column) -> Column:
    """Date of a ten-character YYYY-MM-DD, null otherwise."""
    shaped = text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return F.when(shaped, F.try_to_date(text, "yyyy-MM-dd"))


def reference_tokens(reference: Column) -> Column:
    """Distinct upper-cased tokens between white space, commas, semicolons, slashes and bars."""
    parts = F.split(F.upper(F.coalesce(reference, F.lit(""))), r"(?U)[\s,;/|]+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def csv_safe(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; plain numbers stay as they are."""
    risky = text.rlike(r"\A[=+\-@\t\r]") & ~text.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z")
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def age_days(anchor: Column, as_of: Column) -> Column:
    return F.datediff(as_of, anchor)
