from pyspark.sql import functions as F

from ledgerloom.functions.money import fmt_minor, parse_amount, to_plain
from ledgerloom.functions.text import csv_safe, iso_date, reference_tokens, stripped
from ledgerloom.operators.numbering import numbered


def column(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in frame.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amounts(spark):
    good = {"1": 100, " 2.5 ": 250, "-0.01": -1, "+7.00": 700, "10.100": 1010, "0": 0, "999999999999.99": 99999999999999, " 3 ": 300, "0001.20": 120}
    bad = ["", " ", "1e3", "1,000", "10.005", ".5", "5.", "--1", "1 2", "NaN", "1000000000000", "١", "1\n2", "$1", None, "+", "0x1", "1.2.3"]
    assert column(spark, list(good), parse_amount) == list(good.values())
    assert column(spark, bad, parse_amount) == [None] * len(bad)
    assert column(spark, [123456789, -5, 0], fmt_minor, "bigint") == ["1,234,567.89", "-0.05", "0.00"]
    assert column(spark, [100], lambda c: fmt_minor(c, True), "bigint") == ["+1.00"]
    assert column(spark, [123456789, -5, None], to_plain, "bigint") == ["1234567.89", "-0.05", None]


def test_text(spark):
    cells = ["=1+1", "+A", "-A", "@x", "\tx", "\rx", "-12.50", "-5", "plain", "", None]
    assert column(spark, cells, csv_safe) == ["'=1+1", "'+A", "'-A", "'@x", "'\tx", "'\rx", "-12.50", "-5", "plain", "", None]
    days = ["2026-07-01", "2026-7-1", "2026-13-01", "2026-02-30", "2026-W28-5", "20260701", "", "2024-02-29"]
    assert [str(d) if d else None for d in column(spark, days, iso_date)] == ["2026-07-01", *[None] * 6, "2024-02-29"]
    assert column(spark, ["a b,A;c/d|d  ", "", None, " x"], reference_tokens) == [["A", "B", "C", "D"], [], [], ["X"]]
    assert column(spark, ["  a b\n", None], stripped) == ["a b", ""]


def test_numbers_follow_the_order(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r.number == r.v + 1 for r in numbered(frame, ["v"]).collect())
    assert numbered(frame.where("v < 0"), ["v"]).count() == 0
