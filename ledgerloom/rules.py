"""Tolerances of the matching rules and the closed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

#: The version of this engine's rules, kept with each run.
RULES_VERSION = "loom-2"
CURRENCIES = ("SGD", "USD", "EUR")
AMOUNT_LIMIT_DIGITS = 12
SLA_DAYS = 3


@dataclass(frozen=True)
class Rules:
    """Days and sizes that the plan takes as literals."""

    a_date_tolerance: int = 2
    a_grace: int = 2
    window_before: int = 1
    window_after: int = 3
    unsettled_grace: int = 2
    max_candidates: int = 12
    max_suggested: int = 4
    max_ref_group: int = 10


#: The reasons a row is not loaded, the results of an import, and the states of a case.
ROW_REASONS = (
    "MISSING_VALUE", "BAD_IDENTIFIER", "BAD_DATE", "UNSUPPORTED_CURRENCY", "BAD_AMOUNT", "BAD_VALUE", "SIGN_RULE",
    "NET_MISMATCH", "BAD_ROW_SHAPE", "DUPLICATE_ROW", "CONFLICT_RECORD_ID", "CONFLICT_BUSINESS_KEY",
)
IMPORT_STATUSES = ("LOADED", "PARTIAL", "REJECTED", "DUPLICATE_FILE")
CASE_STATUSES = ("Open", "In review", "Resolved")
AUTO_CLEARED = "AUTO_CLEARED"
MIN_REASON = 10
