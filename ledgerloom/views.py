"""Ledger, provider and bank records derived from order tables, for tests and benchmarks.

Every value is a fixed function of an order's key and its customer's nation. Situations that orders don't bring about are
listed as scenes; each is played for some of the customers, on accounts of their own, so that every rule of the engine is
met.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2001, 7, 22)
#: Day 0 of the scenes, and the customers that they are played for.
SCENE_DAY, SCENE_EVERY, SCENE_REST = date(2001, 7, 1), 50, 3
#: scene, batch ('' for none), number, type, gross, fee, day it settles (or would), its source row conflicts
ITEMS = [
    ("trap", "T1", 0, "charge", 10000, 0, 2, False), ("trap", "T2", 0, "charge", 10000, 0, 5, False),
    *[("contest", f"C{i}", 0, "charge", x, 0, 2, False) for i, x in enumerate((100, 200, 150, 150))],
    ("rival", "V1", 0, "charge", 9000, 0, 2, False), ("several", "E1", 0, "charge", 5000, 0, 2, False),
    ("group", "N1", 0, "charge", 970, 0, 2, False), ("group", "N2", 0, "charge", 485, 0, 2, False),
    ("groupday", "U1", 0, "charge", 970, 0, 2, False), ("groupday", "U2", 0, "charge", 485, 0, 2, False),
    ("over", "O1", 0, "charge", 2000, 0, 2, False), ("money", "M1", 0, "charge", 2000, 0, 2, False),
    *[("capped", f"K{i:02d}", 0, "charge", 100 + i, 0, 2, False) for i in range(14)],
    ("parts", "H1", 0, "charge", 900, 0, 2, False), ("manyparts", "J1", 0, "charge", 5000, 0, 2, False),
    ("lines", "Q1", 0, "charge", 1100, 0, 2, False),
    *[("batches", f"B{i:02d}", 0, "charge", 100, 0, 2, False) for i in range(11)],
    ("stopped", "Z1", 0, "charge", 700, 0, 2, False), ("clash", "Y1", 0, "charge", 800, 0, 2, True),
    ("fees", "F1", 0, "charge", 735, 0, 2, False), ("fees", "F1", 1, "fee", 0, 25, 2, False),
    ("kinds", "", 0, "refund", -300, 0, 2, False), ("fresh", "", 0, "charge", 400, 0, 22, False),
    ("grows", "G1", 0, "charge", 2000, 0, 18, False), ("returns", "R1", 0, "charge", 2000, 0, 16, False),
]
#: scene, line, amount, currency, value day, reference, its source row conflicts
LINES = [
    ("trap", "1", 10000, "SGD", 4, "", False), ("trap", "2", 10000, "SGD", 7, "", False), ("contest", "1", 300, "SGD", 2, "", False),
    ("rival", "1", 4000, "SGD", 2, "V1", False), ("rival", "2", 5000, "SGD", 2, "V1", False), ("rival", "3", 9000, "SGD", 2, "V1", False),
    ("several", "1", 5000, "SGD", 2, "E1", False), ("several", "2", 5000, "SGD", 3, "E1", False),
    ("group", "1", 1400, "SGD", 2, "N1 N2", False), ("groupday", "1", 1455, "SGD", 7, "U1,U2", False),
    ("over", "1", 2100, "SGD", 2, "O1", False), ("money", "1", 2000, "USD", 2, "M1", False), ("capped", "1", 203, "SGD", 2, "", False),
    ("parts", "1", 500, "SGD", 2, "", False), ("parts", "2", 400, "SGD", 3, "", False),
    *[("manyparts", f"{i:02d}", 100 + i, "SGD", 2, "", False) for i in range(13)],
    *[("lines", f"{i:02d}", 100, "SGD", 2, "Q1", False) for i in range(11)],
    ("batches", "1", 1100, "SGD", 2, " ".join(f"B{i:02d}" for i in range(11)), False),
    ("stopped", "1", 700, "SGD", 2, "Z1", True), ("clash", "1", 800, "SGD", 2, "Y1", False), ("fees", "1", 710, "SGD", 2, "F1", False),
    ("debit", "1", -50, "SGD", 2, "", False),
    ("grows", "1", 1200, "SGD", 18, "G1", False), ("grows", "2", 300, "SGD", 20, "G1", False),
    ("returns", "1", 1200, "SGD", 16, "R1", False), ("returns", "2", 800, "SGD", 18, "R1", False), ("returns", "3", 500, "SGD", 21, "R1", False),
]
#: scene, number of the item that the ledger row books, type, gross, day
BOOKED = [("kinds", 0, "SALE", 300, 0), ("fees", 0, "SALE", 735, 0)]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _currency(n: Column) -> Column:
    return F.element_at(F.array(F.lit("SGD"), F.lit("USD"), F.lit("EUR")), (n % 3 + 1).cast("int"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, nation, region, minor (positive), order day, kind; one row per order."""
    nations = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    customers = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    orders = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.col("o_orderdate").cast("date").alias("day"),
    )
    point = F.when(F.floor(F.col("k") / 4) % 2 == 0, 990).otherwise(2500)
    minor = F.when(F.col("nation") % 5 == 0, point).otherwise(F.col("cents")).cast("bigint")
    refund = F.col("k") % 20 == 0
    amount = F.when(refund, -F.floor(F.col("minor") / 10)).otherwise(F.col("minor"))
    joined = orders.join(customers, "c_custkey").join(F.broadcast(nations), "nation")  # 25 nations
    return joined.withColumn("minor", minor).select("k", "nation", "region", "day", amount.cast("bigint").alias("amount"), refund.alias("refund"))


def _tag(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 2, "0"))


def _played(spark: SparkSession, sf_dir: str, rows: list[tuple], names: str) -> DataFrame:
    """The rows of a list for each of the chosen customers, with the customer ``c``."""
    chosen = _read(spark, sf_dir, "customer").where(F.col("c_custkey") % SCENE_EVERY == SCENE_REST).select(F.col("c_custkey").cast("bigint").alias("c"))
    listed = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names.split())]) for r in rows])
    return chosen.select("c", F.explode(listed).alias("x")).select("c", "x.*")


def _scene_day(n: Column | int) -> Column:
    return F.date_add(F.lit(SCENE_DAY), (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def _of_customer(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.col("c").cast("string"), *parts)


def _played_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("-"), F.col("scene"), F.col("n").cast("string"))
    return _played(spark, sf_dir, BOOKED, "scene n type gross day").select(
        _of_customer("L-S", name).alias("record_id"), F.col("type").alias("event_type"), _of_customer("SC", name).alias("business_ref"),
        F.lit(None).cast("string").alias("original_ref"), _of_customer("MER-S").alias("merchant_account"), F.lit("SGD").alias("currency"),
        F.col("gross").cast("bigint").alias("gross_minor"), _scene_day(F.col("day")).alias("event_date"),
    )


def _played_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("-"), F.col("scene"), F.col("batch"), F.col("n").cast("string"))
    rows = _played(spark, sf_dir, ITEMS, "scene batch n type gross fee day conflict")
    settled, gross, fee = F.col("batch") != "", F.col("gross").cast("bigint"), F.col("fee").cast("bigint")
    booked = F.concat(F.lit("-"), F.col("scene"), F.when(F.col("scene").isin(*[b[0] for b in BOOKED]), "").otherwise(F.col("batch")), F.col("n").cast("string"))
    return rows.select(
        _of_customer("P-S", name).alias("record_id"), "type", F.when(F.col("type") != "fee", _of_customer("SC", booked)).alias("business_ref"),
        _of_customer("MER-S").alias("merchant_account"), F.lit("SGD").alias("currency"), gross.alias("gross_minor"), fee.alias("fee_minor"),
        (gross - fee).alias("net_minor"), _scene_day(F.col("day") - 2).alias("created_date"), _scene_day(F.col("day") - 1).alias("available_on"),
        F.when(settled, _of_customer("STL-S", F.lit("-"), F.col("batch"))).alias("batch_id"), F.when(settled, _scene_day(F.col("day"))).alias("settlement_date"),
        F.when(settled, F.concat(F.lit("BANK-"), F.col("scene"), F.col("c").cast("string"))).alias("bank_account"),
        F.lit(-1).cast("bigint").alias("nation"), (-F.col("c")).alias("k"),
    )


def _line_id() -> Column:
    return F.concat(F.lit("B-CASE-S-"), F.lpad(F.col("c").cast("string"), 8, "0"), F.lit("-"), F.col("scene"), F.col("line"))


def _played_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _played(spark, sf_dir, LINES, "scene line amount currency day names conflict")
    named = F.transform(F.filter(F.split("names", "[ ,]"), lambda x: x != ""), lambda x: _of_customer("stl-S", F.lit("-"), x))
    return rows.select(
        _line_id().alias("record_id"), F.concat(F.lit("BANK-"), F.col("scene"), F.col("c").cast("string")).alias("bank_account"), "currency",
        F.col("amount").cast("bigint").alias("amount_minor"), _scene_day(F.col("day")).alias("value_date"), F.array_join(named, ",").alias("reference"),
    )


def blocked(spark: SparkSession, sf_dir: str, ledgers: DataFrame, provided: DataFrame) -> DataFrame:
    """Records that a conflicting source row names: some of the orders' ledger rows and provider items, and those of the
    scenes."""
    k = F.expr("try_cast(substring(record_id, 3) as bigint)")
    of = lambda df, source, hit: df.select("record_id", k.alias("k")).where(hit).select(
        F.lit(source).alias("source"), "record_id", F.array("k").alias("issue_ids")
    )
    items = _played(spark, sf_dir, ITEMS, "scene batch n type gross fee day conflict").where("conflict")
    name = F.concat(F.lit("-"), F.col("scene"), F.col("batch"), F.col("n").cast("string"))
    lines = _played(spark, sf_dir, LINES, "scene line amount currency day names conflict").where("conflict")
    return (
        of(ledgers, "ledger", F.col("k") % 197 == 8)
        .unionByName(of(provided.drop("k"), "psp", F.col("k") % 227 == 10))
        .unionByName(items.select(F.lit("psp").alias("source"), _of_customer("P-S", name).alias("record_id"), F.array("c").alias("issue_ids")))
        .unionByName(lines.select(F.lit("bank").alias("source"), _line_id().alias("record_id"), F.array("c").alias("issue_ids")))
    )


def _ref(k: Column) -> Column:
    return F.concat(F.lit("ORD-"), k.cast("string"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    nation = F.when(k % 199 == 9, (F.col("nation") + 1) % 25).otherwise(F.col("nation"))
    rows = base(spark, sf_dir).where("k % 89 <> 5").select(
        F.concat(F.lit("L-"), k.cast("string")).alias("record_id"), F.when(F.col("refund"), "REFUND").otherwise("SALE").alias("event_type"),
        _ref(k).alias("business_ref"), F.when(F.col("refund"), _ref(k - 1)).alias("original_ref"), _tag("MER-", nation).alias("merchant_account"),
        _currency(F.col("region")).alias("currency"), F.col("amount").alias("gross_minor"), F.col("day").alias("event_date"),
    )
    return rows.unionByName(_played_ledger(spark, sf_dir))


def psp(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    gross = F.col("amount") - F.when(~F.col("refund") & (k % 101 == 11), 50).otherwise(0)
    created = F.date_add("day", F.when(k % 83 == 7, 5).otherwise(k % 3).cast("int"))
    half = F.when(k % 4 < 2, "A").otherwise("B")
    rows = (
        base(spark, sf_dir).where("k % 97 <> 3")
        .withColumn("gross", gross.cast("bigint"))
        .withColumn("fee", F.when(F.col("refund"), 0).otherwise(F.floor((F.col("gross") * 29 + 500) / 1000) + 30).cast("bigint"))
        .withColumn("created", created)
        .withColumn("available", F.date_add("created", (1 + k % 2).cast("int")))
        .withColumn("settled", F.when(k % 61 != 13, F.date_add("available", F.pmod(F.lit(8) - F.dayofweek("available"), F.lit(7)))))
        .withColumn("merchant", _tag("MER-", F.col("nation")))
    )
    batch = F.concat_ws("-", F.lit("STL"), "merchant", F.date_format("settled", "yyyyMMdd"), half)
    ordered = rows.select(
        F.concat(F.lit("P-"), k.cast("string")).alias("record_id"), F.when(F.col("refund"), "refund").otherwise("charge").alias("type"),
        _ref(k).alias("business_ref"), F.col("merchant").alias("merchant_account"),
        _currency(F.col("region") + F.when(k % 211 == 9, 1).otherwise(0)).alias("currency"),
        F.col("gross").alias("gross_minor"), F.col("fee").alias("fee_minor"), (F.col("gross") - F.col("fee")).alias("net_minor"),
        F.col("created").alias("created_date"), F.col("available").alias("available_on"),
        F.when(F.col("settled").isNotNull(), batch).alias("batch_id"), F.col("settled").alias("settlement_date"),
        F.when(F.col("settled").isNotNull(), _tag("BANK-", F.col("nation"))).alias("bank_account"), F.col("nation").cast("bigint").alias("nation"), k.alias("k"),
    )
    return ordered.unionByName(_played_items(spark, sf_dir))


def _payouts(provided: DataFrame) -> DataFrame:
    """One or two bank lines per batch of orders, by the batch's smallest order key: batch, its label, pair and line."""
    batches = provided.where("batch_id IS NOT NULL AND k >= 0").groupBy("batch_id").agg(
        F.min("bank_account").alias("account"), F.min("currency").alias("currency"), F.max("currency").alias("most"),
        F.min("settlement_date").alias("day"), F.sum("net_minor").alias("net"), F.min("k").alias("k"), F.min("nation").alias("nation"),
    )
    pair = batches.withColumns({"half": F.substring("batch_id", -1, 1), "stem": F.expr("substring(batch_id, 1, length(batch_id) - 2)")})
    other = pair.where("half = 'B'").select("stem", F.col("batch_id").alias("b_id"), F.col("net").alias("b_net"), F.col("currency").alias("b_cur"), F.col("most").alias("b_most"))
    joined = pair.where("half = 'A'").select("stem", F.col("k").alias("a_k"), F.col("net").alias("a_net"), F.col("currency").alias("a_cur"), F.col("most").alias("a_most"), F.col("batch_id").alias("a_id")).join(other, "stem")
    sound = (F.col("a_cur") == F.col("a_most")) & (F.col("b_cur") == F.col("b_most")) & (F.col("a_cur") == F.col("b_cur")) & (F.col("a_net") > 0) & (F.col("b_net") > 0)
    pairs = joined.where(sound & (F.col("a_k") % 10).isin(7, 8, 9)).select("stem", (F.col("a_k") % 10).alias("how"), "a_id", "b_id", "a_net", "b_net")
    rows = pair.join(pairs, "stem", "left")
    r = F.col("k") % 40
    how = (
        F.when(F.col("how") == 7, "merge").when(F.col("how") == 8, "merge_bare").when(F.col("how") == 9, "complex")
        .when(r == 0, "none").when(F.col("net") <= 0, "clean").when(r == 1, "partial").when(r == 2, "late").when(r == 3, "split")
        .when(r == 4, "double").when(r == 5, "elsewhere").when(r.between(6, 15) | ((F.col("nation") % 5 == 0) & (F.col("k") % 2 == 0)), "bare")
        .otherwise("clean")
    )
    rows = rows.withColumn("label", how)
    line = lambda amount, day, ref, account=F.col("account"): F.struct(account.alias("account"), amount.cast("bigint").alias("amount"), day.alias("value"), ref.alias("ref"))
    net, day, own = F.col("net"), F.col("day"), F.concat(F.lit("PAYOUT "), F.col("batch_id"))
    both = F.concat(F.lit("PAYOUT "), F.col("a_id"), F.lit(" "), F.col("b_id"))
    bare = F.lit("INCOMING PAYMENT")
    total, part = F.col("a_net") + F.col("b_net"), F.floor(net * 3 / 5)
    wrong = _tag("BANK-", (F.col("nation") + 1) % 25)
    first = F.col("half") == "A"
    lines = (
        F.when((F.col("label") == "merge") & first, F.array(line(total, day, both)))
        .when((F.col("label") == "merge_bare") & first, F.array(line(total, day, bare)))
        .when((F.col("label") == "complex") & first, F.array(line(F.col("a_net"), day, both), line(F.col("b_net"), day, both)))
        .when(F.col("label").isin("merge", "merge_bare", "complex", "none"), F.slice(F.array(line(net, day, own)), 1, 0))
        .when(F.col("label") == "partial", F.array(line(part, day, own)))
        .when(F.col("label") == "late", F.array(line(net, F.date_add("day", 5), own)))
        .when(F.col("label") == "split", F.array(line(part, day, own), line(net - part, F.date_add("day", 1), own)))
        .when(F.col("label") == "double", F.array(line(net, day, own), line(net, F.date_add("day", 6), own)))
        .when(F.col("label") == "elsewhere", F.array(line(net, day, own, wrong)))
        .when(F.col("label") == "bare", F.array(line(net, F.date_add("day", (F.col("k") % 4).cast("int")), bare)))
        .otherwise(F.array(line(net, day, own)))
    )
    return rows.select("batch_id", "currency", "label", "how", "a_id", "b_id", F.posexplode(lines).alias("n", "l")).where("l.amount <> 0").withColumn("record_id", F.concat(F.lit("B-"), F.substring("batch_id", 5, 64), F.lit("-"), (F.col("n") + 1).cast("string")))


def bank(spark: SparkSession, sf_dir: str, provided: DataFrame) -> DataFrame:
    """The payouts of the orders' batches, and the lines of the scenes; ``provided``: the provider's items."""
    paid = _payouts(provided).select(
        "record_id", F.col("l.account").alias("bank_account"), "currency", F.col("l.amount").alias("amount_minor"), F.col("l.value").alias("value_date"),
        F.col("l.ref").alias("reference"),
    )
    return paid.unionByName(_played_lines(spark, sf_dir))


def payouts(provided: DataFrame) -> DataFrame:
    """(event, batch_id, record_id, meant): which lines pay which batches; meant: they carry what a match needs."""
    paid = _payouts(provided).where("NOT (label = 'double' AND n = 1) AND label NOT IN ('partial', 'late', 'elsewhere')")
    both = F.col("label").isin("merge", "merge_bare", "complex")
    batches = F.when(both, F.array("a_id", "b_id")).otherwise(F.array("batch_id"))
    return paid.select(
        F.col("batch_id").alias("event"), F.explode(batches).alias("batch_id"), "record_id", (~F.col("label").isin("merge_bare", "complex")).alias("meant")
    )
