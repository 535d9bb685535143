"""Small document tables that hold the awkward cases."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(6000))


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties; a clashing extra column."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", None, 45),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (None, "no id at all in this row", "en", "b", 24),
        (5, "   \t\n ", "de", "b", 6),
        (6, LONG, "en", "c", len(LONG)),
        (7, "ÜBER straße ☃ 1234", "de", "c", 18),
    ]
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA + ", fp string, score double")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
