"""Mixing sources to target weights by hash-threshold histograms.

A source's budget is met without a sort: its tokens are summed per bucket of a document hash, the bucket in which
the running sum crosses the budget is found, only that bucket is refined by the next bits of the hash, and in the
end every document below the threshold is taken. Budgets nest: a larger one has a larger threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.counted import join_counted
from .common import BROADCAST_ROWS, settle, sized, table

WEIGHTS = (5, 2, 1)
CEILING = 3
WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS, LEVELS = 12, 5
HASH_BITS = LEVEL_BITS * LEVELS


def _ordered(totals: DataFrame) -> DataFrame:
    """Number the sources from 0 in code-point order, null last, without bringing them to one task."""
    dealt = settle(
        totals.repartitionByRange(F.col("missing"), F.col("skey"))
        .sortWithinPartitions("missing", "skey")
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    sizes = dealt.groupBy("part").agg(F.count("*").alias("rows"))  # one row per partition
    before = sizes.withColumn(
        "before", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    within = F.row_number().over(W.partitionBy("part").orderBy("missing", "skey"))
    return dealt.join(F.broadcast(before.drop("rows")), "part").withColumn("number", F.col("before") + within - 1)


def water_level(sources: DataFrame) -> float:
    """Tokens per unit of weight once the excess over the ceilings has been shared anew until none is above.

    A source is capped from the level at which its weight reaches its ceiling. In the order of these levels the capped
    sources are a prefix, so running sums over the ordered sources give the level in one pass: the first at which the
    next source is not capped. The order is dealt by range."""
    reach = F.col("source_size") * float(CEILING) / F.col("weight")
    dealt = settle(sources.select(reach.alias("reach"), "source_size", "weight").repartitionByRange("reach").withColumn("part", F.spark_partition_id()), "levels")
    total, weights = dealt.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    sums = dealt.groupBy("part").agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"))  # a row per partition
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("s0"), F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("w0"))
    within = W.partitionBy("part").orderBy("reach").rangeBetween(W.unboundedPreceding, W.currentRow)
    run = dealt.join(F.broadcast(before), "part").select(
        "reach",
        (F.col("s0") + F.sum("source_size").over(within)).alias("s"),
        (F.col("w0") + F.sum("weight").over(within)).alias("w"),
    )
    # with all sources up to this one capped, the rest of the total is shared by the rest of the weights
    level = (F.lit(float(total)) - CEILING * F.col("s")) / (F.lit(weights) - F.col("w"))
    capped = run.where((F.col("w") < F.lit(weights)) & (level >= F.col("reach")))
    found = capped.agg(F.max_by(level, "reach")).first()[0]
    return max(total / weights, found) if found is not None else total / weights


def _refined(sizes: DataFrame, state: DataFrame, level: int, n: int) -> DataFrame:
    """Sum the open sources' tokens by the level's bucket and move each to its boundary bucket."""
    shift = HASH_BITS - LEVEL_BITS * level
    held = sizes.join(sized(state.where("open").select("skey", "prefix"), n), "skey")
    if level > 1:
        held = held.where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
    sums = held.groupBy("skey", F.shiftright("h", shift).alias("bucket")).agg(
        F.sum("size").alias("tokens"), F.min("h").alias("low"), F.max("h").alias("high")
    )
    run = W.partitionBy("skey").orderBy("bucket")  # at most 4,096 rows a source
    crossed = (
        sums.withColumn("upto", F.sum("tokens").over(run))
        .join(sized(state.where("open"), n), "skey")
        .where("below + upto >= budget")
        .groupBy("skey")
        .agg(F.min_by(F.struct("bucket", "tokens", "upto", "low", "high"), "bucket").alias("b"))
    )
    nxt = state.join(sized(crossed, n), "skey", "left")
    moved = F.col("open") & F.col("b").isNotNull()
    below = F.col("below") + F.col("b.upto") - F.col("b.tokens")
    last = (F.col("b.low") == F.col("b.high")) | F.lit(level == LEVELS)
    closer = F.abs(below + F.col("b.tokens") - F.col("budget")) < F.abs(F.col("budget") - below)
    end = F.shiftleft(F.col("b.bucket") + F.when(closer, 1).otherwise(0), shift)
    return nxt.select(
        "skey", "source_size", "n", "target", "base", "budget",
        F.when(moved, F.col("b.bucket")).otherwise(F.col("prefix")).alias("prefix"),
        F.when(moved, below).otherwise(F.col("below")).alias("below"),
        F.when(moved & last, end).otherwise(F.col("threshold")).alias("threshold"),
        (moved & ~last).alias("open"),
    )


def _measured(docs: DataFrame) -> DataFrame:
    """docs -> row (all its columns), doc's hash h, skey (its source) and size, read from the whole text once."""
    source = F.col("source").cast("string")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - HASH_BITS).alias("h"),
        source.isNull().alias("missing"),
        F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit(""))).alias("skey"),
    )


def _taken(measured: DataFrame, sizes: DataFrame) -> DataFrame:
    """Measured rows, and their settled sizes -> row, size, source_size, target, copies."""
    state, sources = thresholds(sizes)
    copies = F.col("base") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    if sources <= BROADCAST_ROWS:
        joined = measured.join(F.broadcast(state), "skey")
    else:
        joined = join_counted(measured, state, "skey", sizes.count())
    return joined.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _taken_of(docs: DataFrame) -> DataFrame:
    """Counts the words of every text twice, which takes less than shuffling texts would."""
    measured = _measured(docs)
    return _taken(measured, settle(measured.drop("row"), "sizes"))


def mix(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, copies and taken, one row per input row.

    A null text has size 0. Null is a source of its own, after all others. A document's hash is over its id and
    text; rows alike in both stand or fall together. Columns of these five names are replaced, all others stay,
    whatever their names. Empty tables give empty results; a source without words has target 0.
    """
    own = {"size", "source_size", "target", "copies", "taken"}
    kept = [c for c in docs.columns if c.lower() not in own]
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return _taken_of(docs).select(*[F.col(f"row.`{c}`") for c in kept], "size", "source_size", "target", "copies", taken)


def thresholds(sizes: DataFrame) -> tuple[DataFrame, int]:
    """(skey, missing, h, size) -> each source's rows n, target, whole copies and hash threshold; the number of sources."""
    totals = sizes.groupBy("skey", "missing").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    sources = settle(_ordered(totals).select("skey", "source_size", "n", weight.alias("weight")), "weights")
    number, level = sources.count(), water_level(sources)
    target = F.least(F.col("source_size") * float(CEILING), F.col("weight") * F.lit(level))
    state = (
        sources.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))
        .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
        .select("skey", "source_size", "n", "target", "base", "budget", F.lit(0).cast("long").alias("prefix"),
                F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("threshold"),
                (F.col("budget") > 0).alias("open"))
    )
    for level in range(1, LEVELS + 1):
        state = settle(_refined(sizes, state, level, number), "thresholds")
        if not state.where("open").limit(1).count():
            break
    return state.select("skey", "source_size", "n", "target", "base", "threshold"), number


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, in the columns of ``docs``, which keep their values
    whatever their names. Nulls, empty texts, repeated rows and empty tables are treated as ``mix`` does."""
    taken = _taken_of(docs).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    measured = settle(_measured(docs).withColumn("row", F.struct("row.doc_id")), "sizes")  # no texts: each is read once
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return _taken(measured, measured).select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", taken)
