"""SimHash near-duplicates with pivot distance tables.

A distinct fingerprint's Hamming distances to many reference fingerprints (pivots) are computed once and stored with
it. The triangle inequality makes the maximum coordinate difference of two such rows a lower bound of their distance:
pairs beyond the radius by that bound are discarded, only survivors are verified.

Distances to random pivots lie close together, so pivots alone can't deal rows out. Fingerprints within four bits agree
wholly on at least k of k + 4 blocks of bits: each distinct fingerprint is dealt to the tables of all sets of k blocks.
k grows with the number of fingerprints (15 tables of 20 bits or more, then 35 of 27, then 70 of 32), so that few rows
share a key at any size; every k finds every pair. Within a table's key, rows are ordered by the first pivot's distance,
so a scan stops where that coordinate alone exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import roots
from ..operators.counted import join_counted
from . import nearcopies
from .common import NARROW_ROWS, scratch, settle, table, utf8

RADIUS = 4
SHINGLE = 4
SEED = 42
PIVOTS = 16
#: k is the least of these that leaves so many fingerprints a key on average, or else the last.
EQUAL_BLOCKS, KEY_ROWS = (2, 3, 4), 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_MASK64 = (1 << 64) - 1


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: a multiplicative sequence of 64-bit words."""
    return np.array([((i * 2 + 1) * 0x9E3779B97F4A7C15 * (i + 3)) & _MASK64 for i in range(count)], dtype=np.uint64)


def fingerprint(text: bytes | None) -> int:
    """64-bit fingerprint of a text's word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        first, last = (ends - lengths)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], dtype=np.uint64)
    parts = hashes.view(np.uint8).reshape(-1, 8)
    set_bits = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in utf8(batch.column(1))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, fp long, the fingerprint's bits)."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")
    ).mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, fp long")


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """(fingerprints, pivots): the precomputed coordinates."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots()], axis=1).astype(np.uint8)


def _pivot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pivot_distances(batch.column(0).to_numpy().view(np.uint64))
        coordinates = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(rows), [None, pa.py_buffer(rows.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), coordinates.cast(pa.binary())], ["fp", "far"])


def links_in_tables(key: np.ndarray, fps: np.ndarray, far: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links (row, row) of the pairs within ``radius`` that share a key; ``far``: their pivot distances.

    Rows must be sorted by key and then by distance to the first pivot.
    """
    n = len(key)
    tables = far.astype(np.int16)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    label, links = np.arange(n), []
    rows, step = np.arange(n), 1
    while True:
        rows = rows[rows + step < end[rows]]
        rows = rows[np.abs(tables[rows + step, 0] - tables[rows, 0]) <= radius]
        if not len(rows):
            return links
        near = rows[np.abs(tables[rows + step] - tables[rows]).max(axis=1) <= radius]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= radius]
        near = near[label[near] != label[near + step]]
        for i in near.tolist():
            a, b = i, i + step
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                links.append((i, i + step))
        if len(near):
            while (label[label] != label).any():
                label = label[label]
        step += 1


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(held):
        key, fps, far = (np.concatenate(c) for c in zip(*held))
        pairs = np.array(links_in_tables(key, fps.view(np.uint64), far), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fps[pairs[:, 0]]), pa.array(fps[pairs[:, 1]])], ["u", "v"])

    held: list[tuple] = []  # rows of whole keys, but for the last one, which may go on
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        far = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, PIVOTS)
        now = (key, batch.column(1).to_numpy(), far)
        last = int(np.searchsorted(key, key[-1]))
        if held and key[0] == key[-1] == held[-1][0][-1]:
            held.append(now)
            continue
        held.append(tuple(c[:last] for c in now))
        yield found(held)
        held = [tuple(c[last:] for c in now)]
    if held:
        yield found(held)


def blocks(equal: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the ``equal + RADIUS`` blocks that 64 bits are cut into."""
    edges = [64 * i // (equal + RADIUS) for i in range(equal + RADIUS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def equal_blocks(count: int) -> int:
    """How many blocks make a key for ``count`` fingerprints."""
    bits = lambda k: 64 // (k + RADIUS) * k
    return next((k for k in EQUAL_BLOCKS if count >> bits(k) <= KEY_ROWS), EQUAL_BLOCKS[-1])


def _tables(equal: int) -> list:
    """Columns (key) of the tables: their number in the top bits, the blocks' bits below."""
    out = []
    for number, chosen in enumerate(combinations(blocks(equal), equal)):
        key = F.lit(0).cast("long")
        for at, width in chosen:
            key = F.shiftleft(key, width) + F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        out.append(F.shiftleft(F.lit(number).cast("long"), 56) + key)
    return out


def link_fingerprints(distinct: DataFrame, equal: int | None = None) -> DataFrame:
    """Distinct (fp) -> links (u, v) that span every group of fingerprints within the radius."""
    equal = equal or equal_blocks(distinct.count())
    first = int(pivots(1).view(np.int64)[0])
    dealt = (
        distinct.select("fp").mapInArrow(_pivot_batches, "fp long, far binary")
        .select(F.explode(F.array(*_tables(equal))).alias("key"), "fp", "far")
        .repartition("key")
        .sortWithinPartitions("key", F.bit_count(F.col("fp").bitwiseXOR(F.lit(first))))
    )
    return dealt.mapInArrow(_link_batches, "u long, v long").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) -> (fp, n, component_id, root): how many rows have each fingerprint, and the least id and the
    least fingerprint reachable from it."""
    with scratch(prints.sparkSession) as keep:
        distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-prints")
        root = roots(link_fingerprints(distinct.select("fp")))
        member = distinct.join(root.withColumnRenamed("u", "fp"), "fp", "left").select(
            "fp", "n", "rep", F.coalesce("v", "fp").alias("root")
        )
        member = settle(member, "members")
        least = member.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
        found = join_counted(member.drop("rep").withColumnRenamed("n", "rows"), least.withColumnRenamed("size", "n"), "root", member.count())
        return keep(settle(found.select("fp", F.col("rows").alias("n"), "component_id", "root"), "classes"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, component_id), one row per input row.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows each get a row. A row
    without doc_id gets its component's smallest doc_id, null if no member has one. Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    prints = settle(fingerprints(docs), "prints")
    return join_counted(prints, classes(prints), "fp", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more; not the query's
    fingerprints), in the columns of ``docs``: the one of the smallest doc_id (null last), of several such the one of
    the smallest text hash.

    Null and wordless texts are copies of each other. Of rows that repeat id and text one stays. Ids that unrelated
    texts share lose none of these. All columns keep their values, whatever their names; an empty table stays empty.
    """
    with scratch(docs.sparkSession) as kept:
        prints = settle(nearcopies.prints(docs), "near-prints")
        first = F.min(F.struct(F.col("keep_id").isNull().alias("late"), "keep_id", "keep_hash"))
        keep = nearcopies.groups(docs, prints).groupBy("root").agg(first.alias("k")).select("k.keep_id", "k.keep_hash")
        keep = kept(settle(keep, "keep"))
        ids = prints.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
        same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash"))
        gone = kept(settle(ids.distinct().join(keep, same, "left_anti").toDF("gone_id", "gone_hash"), "gone"))
        again = ids.groupBy("id", "hash").count().where("count > 1").limit(1).count()
    own = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    few = gone.count()
    if few <= NARROW_ROWS:  # spares the shuffle of the texts
        stay = own.join(F.broadcast(gone), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    else:
        stay = own.join(keep, same, "left_semi")
    if again:  # rows that repeat id and text
        stay = stay.dropDuplicates(["id", "hash"])
    return stay.select("row.*")


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
