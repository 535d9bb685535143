"""Exact money in integer minor units, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import AMOUNT_LIMIT_DIGITS
from .text import stripped


def parse_amount(text: Column) -> Column:
    """Minor units of a plain decimal, null if it is not one: no exponent, at most two significant decimals, less
    than 10**12 in size. Digits are ASCII. Nothing is rounded."""
    t = stripped(text)
    whole = F.regexp_replace(F.regexp_extract(t, r"\A[+-]?([0-9]+)", 1), "^0+", "")
    cents = F.regexp_replace(F.regexp_extract(t, r"\.([0-9]+)\z", 1), "0+$", "")
    fits = (F.char_length(whole) <= AMOUNT_LIMIT_DIGITS) & (F.char_length(cents) <= 2)
    minor = F.concat(F.lit("0"), whole, F.rpad(cents, 2, "0")).try_cast("bigint")
    good = t.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?\z") & fits
    return F.when(good, F.when(F.startswith(t, F.lit("-")), -minor).otherwise(minor))


def to_plain(minor: Column) -> Column:
    """Machine decimal with two places."""
    return (minor.cast("decimal(20,0)") / F.lit(100).cast("decimal(5,0)")).cast("decimal(20,2)").cast("string")


def fmt_minor(minor: Column, plus: bool = False) -> Column:
    """Decimal with thousands separators, optionally with a plus sign."""
    shown = F.format_number((minor.cast("decimal(20,0)") / F.lit(100).cast("decimal(5,0)")).cast("decimal(20,2)"), 2)
    return F.when((minor >= 0) & F.lit(plus), F.concat(F.lit("+"), shown)).otherwise(shown)


def money(minor: Column, currency: Column) -> Column:
    return F.concat_ws(" ", fmt_minor(minor), currency)
