"""Exact removal of long repeated byte strings by sharded run-length indexes.

Dealing. Every string of ``length`` bytes has a window's worth of 64-byte grams; the one of least hash is its anchor,
found from the string alone. Equal strings have equal anchors, so only anchors that occur twice matter, and their
contexts (the bytes of all strings anchored there) are dealt to shards by anchor. A string starts in one context only.

Matching. A shard of bounded size builds a run-length index of its distinct contexts and streams matching statistics;
positions with a match of ``length`` bytes or more start repeated strings. A text that several rows hold repeats as a
whole: one of these rows is dealt, and only where it shares an anchor with another text.

An anchor of many occurrences would make an unbounded group. Its contexts are combined first: of equal ones, which are
known by a 128-bit digest and repeat as a whole, a count and one representative remain. If more than ``GROUP`` different
contexts remain, they are split by a longer gram: its least hash in a string deals that string, as the anchor did. The
parts go through the index, or are split again. The last gram is the string itself, so that the parts of this split hold
one string each and need no index. What is found for a context holds wherever it occurs; contexts of very many
occurrences are joined back in place. So no task gathers what grows with a string's occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counted import join_counted
from .common import scratch, settle, table, utf8, whole
from .rindex import RunIndex

LENGTH = 200
GRAM = 64
#: The grams that split an anchor's contexts, before the string itself.
LONGER = (128, 176, 192)
#: Contexts that one group of a shard holds at most.
GROUP = 256
SHARD_BYTES = 2_000_000
CHUNK = 1 << 16
#: Stands for a text whose own repeats are known already.
KNOWN = bytes(16)

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


@lru_cache(maxsize=4)
def _byte_values(salt: int) -> np.ndarray:
    """A 64-bit value for each byte, from a digest."""
    return np.frombuffer(b"".join(hashlib.sha256(bytes([salt, b])).digest()[:8] for b in range(256)), dtype="<u8")


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK + 512
    up, down = np.full(size, _MULTIPLIER, _U), np.full(size, _INVERSE, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def gram_hashes(data: np.ndarray, gram: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``gram``-byte string of a chunk."""
    up, down = _powers()
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_byte_values(salt)[data] * down[: len(data)], out=total[1:])
    return _mixed((total[gram:] - total[:-gram]) * up[: len(data) - gram + 1])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first start, number of starts) for the runs of strings of a text that share an anchor."""
    span = length - gram + 1  # grams in a string
    data, keys, los, counts = np.frombuffer(text, dtype=np.uint8), [], [], []
    for at in range(0, max(0, len(data) - length + 1), CHUNK - span + 1):
        h = gram_hashes(data[at : at + CHUNK + gram - 1], gram)
        least = (h & ~_U(0xFFFF)) | np.arange(len(h), dtype=_U)  # ties go to the first
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        if not len(least):
            continue
        where = (least & _U(0xFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        keys.append(h[where[lo]].view(np.int64))
        los.append(lo + at)
        counts.append(np.diff(np.r_[lo, len(where)]))
    if not keys:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(keys), np.concatenate(los), np.concatenate(counts)


def _anchor_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [anchors(t, length) for t in utf8(part.column(1))]
                tids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
                key, lo, count = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), tids, pa.array(lo.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["key", "tid", "lo", "count"],
                )

    return run


_PIECES = "parent binary, at int, cid binary, key long, count int, data binary"
_DEALT = _PIECES + ", hot boolean"
_TYPES = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]


def _digests(data: bytes, length: int) -> list[bytes]:
    """128-bit digest of every string of ``length`` bytes."""
    whole_ = np.frombuffer(data, dtype=np.uint8)
    both = np.stack([gram_hashes(whole_, length, 1), gram_hashes(whole_, length, 2)], axis=1)
    return np.frombuffer(both.tobytes(), dtype="V16").tolist()


def _columns(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names)


def _context_batches(length: int):
    """(tid, text, runs, copied) -> the contexts of the runs; those of frequent anchors with their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                ends = np.cumsum(pc.list_value_length(part.column(2)).to_numpy()).tolist()
                los, counts, keys, hots = (c.to_pylist() for c in part.column(2).flatten().flatten())
                texts = zip(part.column(0).to_pylist(), utf8(part.column(1)), part.column(3).to_pylist(), [0, *ends], ends)
                for name, text, copied, a, b in texts:
                    if name == last:  # the join brings a text's copies one after another
                        continue
                    last, tid = name, KNOWN if copied else name
                    for lo, count, key, hot in zip(los[a:b], counts[a:b], keys[a:b], hots[a:b]):
                        data = text[lo : lo + count + length - 1]
                        rows.append((tid, lo, hashlib.md5(data).digest() if hot else None, key, count, data, hot))
                yield _columns(rows, [*_TYPES, pa.bool_()], ["parent", "at", "cid", "key", "count", "data", "hot"])

    return run


def _split_batches(length: int, gram: int):
    """Contexts (cid, data) -> their strings by the least ``gram`` of each; strings themselves carry no data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for cid, data in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in (0, 1))):
                    if gram == length:
                        rows += [(cid, i, bytes(d), 0, 1, None) for i, d in enumerate(_digests(data, length))]
                        continue
                    for key, lo, count in zip(*(c.tolist() for c in anchors(data, length, gram))):
                        part = data[lo : lo + count + length - 1]
                        rows.append((cid, lo, hashlib.md5(part).digest(), key, count, part))
                yield _columns(rows, _TYPES, ["parent", "at", "cid", "key", "count", "data"])

    return run


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of sorted distinct numbers."""
    if not len(starts):
        return iter(())
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return zip(starts[np.r_[0, cut]].tolist(), (starts[np.r_[cut - 1, len(starts) - 1]] + 1).tolist())


def match_contexts(groups: list[dict[bytes, list]], length: int) -> list[tuple[bytes, int, int]]:
    """groups: by anchor, context -> its occurrences (tid, lo). Returns runs (tid, lo, hi) of repeated starts, but for
    texts that are ``KNOWN``."""
    out: list[tuple[bytes, int, int]] = []
    rivals = [(ctx, rows) for g in groups if len(g) > 1 for ctx, rows in g.items()]
    for g in groups:
        for ctx, rows in g.items():
            if len(rows) > 1:  # the whole context recurs
                out += [(tid, lo, lo + len(ctx) - length + 1) for tid, lo in rows if tid != KNOWN]
    if rivals:
        index = RunIndex([ctx for ctx, _ in rivals])
        hits = np.flatnonzero(index.statistics() >= length)  # none starts in the last bytes of a context, so no run crosses
        spans = list(_runs(hits))
        of = np.searchsorted(index.starts, [a for a, _ in spans], side="right") - 1
        for (a, b), i, at in zip(spans, of.tolist(), index.starts[of].tolist()):
            rows = rivals[i][1]
            if len(rows) == 1 and rows[0][0] != KNOWN:
                tid, lo = rows[0]
                out.append((tid, lo + a - at, lo + b - at))
    return out


def _match_batches(length: int):
    """(key, owner, lo, data) sorted by key -> runs (owner, lo, hi) of repeated starts."""

    def table_of(found: list[tuple]) -> pa.RecordBatch:
        return _columns(found, [pa.binary(), pa.int32(), pa.int32()], ["tid", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict[bytes, list]] = []
        held, last = 0, None
        for batch in batches:
            for key, owner, lo, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != last:
                    if held > SHARD_BYTES:
                        yield table_of(match_contexts(groups, length))
                        groups, held = [], 0
                    last = key
                    groups.append({})
                rows = groups[-1].setdefault(data, [])
                if not rows:
                    held += len(data)
                rows.append((owner, lo))
        yield table_of(match_contexts(groups, length))

    return run


def _matched(contexts: DataFrame, length: int) -> DataFrame:
    """(key, owner, lo, data), bounded in number per key -> (tid: the owner, lo, hi)."""
    dealt = contexts.select("key", "owner", "lo", "data").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_match_batches(length), "tid binary, lo int, hi int")


def _joined(runs: Column) -> Column:
    """Runs array<struct<lo, hi>> as maximal ones: those that meet or overlap are one. For a context, whose runs are few;
    work grows with the square of their number."""
    inner = lambda x: F.exists(runs, lambda y: (y["lo"] < x["lo"]) & (x["lo"] <= y["hi"]))
    outer = lambda x: F.exists(runs, lambda y: (y["lo"] <= x["hi"]) & (x["hi"] < y["hi"]))
    los = F.array_sort(F.array_distinct(F.transform(F.filter(runs, lambda x: ~inner(x)), lambda x: x["lo"])))
    his = F.array_sort(F.array_distinct(F.transform(F.filter(runs, lambda x: ~outer(x)), lambda x: x["hi"])))
    return F.zip_with(los, his, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))


def _own_runs(found: DataFrame) -> DataFrame:
    """(tid, lo, hi) -> (tid, runs), one row per run still."""
    return found.select("tid", F.array(F.struct("lo", "hi")).alias("runs"))


def marks_of(pieces: DataFrame, length: int, grams: tuple[int, ...]) -> DataFrame:
    """Settled pieces (parent, at, cid, key, count, data) -> (tid: the parent, runs: those of repeated starts in it);
    nothing for ``KNOWN`` parents. ``grams``: what splits the contexts of a key that has too many; none if a context
    is one string. A context's runs stay one list, wherever it occurs."""
    n, first = F.count("*").alias("n"), [F.first(c).alias(c) for c in ("key", "count", "data")]
    with scratch(pieces.sparkSession) as keep:
        contexts = settle(pieces.groupBy("cid").agg(n, *first), "contexts")
        recurs = contexts.where("n > 1").select(F.col("cid").alias("tid"), F.lit(0).alias("lo"), F.col("count").alias("hi"))
        found = [_own_runs(recurs)]
        if grams:
            of_key = settle(contexts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
            rivals = join_counted(contexts.select("cid", "key", "data"), of_key, "key", contexts.count())
            small = rivals.where(F.col("n") <= GROUP).withColumnsRenamed({"cid": "owner"}).withColumn("lo", F.lit(0))
            found.append(_own_runs(_matched(small, length)))
            if of_key.where(F.col("n") > GROUP).limit(1).count():
                many = rivals.where(F.col("n") > GROUP).select("cid", "data")
                parts = settle(many.mapInArrow(_split_batches(length, grams[0]), _PIECES), "parts")
                found.append(marks_of(parts, length, grams[1:]))
        runs = reduce(DataFrame.union, found).toDF("cid", "runs").groupBy("cid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        runs = settle(contexts.select("cid", "n").join(runs.select("cid", _joined(F.col("runs")).alias("runs")), "cid"), "runs")
        own = pieces.where(F.col("parent") != F.lit(KNOWN)).select("parent", "at", "cid")
        placed = join_counted(own, runs, "cid", pieces.count()).select(
            F.col("parent").alias("tid"),
            F.transform("runs", lambda r: F.struct((F.col("at") + r["lo"]).alias("lo"), (F.col("at") + r["hi"]).alias("hi"))).alias("runs"),
        )
        return keep(settle(placed.groupBy("tid").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs"))


def covered(marks: list, length: int) -> list[tuple[int, int]]:
    """Merged byte ranges [a, b) of the strings that start in the runs [lo, hi)."""
    out: list[list[int]] = []
    for lo, hi in sorted(marks):
        a, b = lo, hi + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _spans_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy()).tolist()
            marks = list(zip(*(c.to_pylist() for c in batch.column(2).flatten().flatten())))
            spans = [covered(marks[a:b], length) for a, b in zip([0, *ends], ends)]
            kept = []
            for text, cut in zip(utf8(batch.column(1)), spans):
                edges = [0, *(x for s in cut for x in s), len(text)]
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if cut else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans],
                                           pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())],
                ["doc_id", "removed", "kept"],
            )

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text) -> (doc_id, removed array<struct<start, end>> in bytes, kept binary), one row per input row.

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in this document or another;
    strings are judged on the input. Null texts are empty. Rows that repeat a text, with whatever id, are each other's
    copies. Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), whole(F.col("text").cast("string")).alias("text")).withColumn(
        "tid", F.unhex(F.md5("text"))
    )
    with scratch(docs.sparkSession) as keep:
        marks = keep(settle(_marks(texts, length), "marks"))
    return texts.join(marks, "tid", "left").select("doc_id", "text", "marks").mapInArrow(
        _spans_batches(length), "doc_id long, removed array<struct<start: long, end: long>>, kept binary"
    )


def _marks(texts: DataFrame, length: int) -> DataFrame:
    """(tid, text) -> (tid, marks): the runs of starts of repeated strings, of every text that has some."""
    found = texts.select("tid", "text").mapInArrow(_anchor_batches(length), "key long, tid binary, lo int, count int")
    name = F.xxhash64("tid")
    counted = found.groupBy("key").agg(F.count("*").alias("n"), (F.min(name) == F.max(name)).alias("lone"))
    twice = settle(counted.where("n > 1"), "anchors")
    run = F.struct("lo", "count", "key", (F.col("n") > GROUP).alias("hot"), "lone")
    of_text = (
        found.join(twice, "key")
        .groupBy("tid")
        .agg(F.collect_set(run).alias("found"), F.count("*").alias("n"), F.max(F.col("lo") + F.col("count")).alias("hi"))
        .withColumn("copied", F.col("n") > F.size("found"))  # every copy brings the same runs
    )
    met = F.filter("found", lambda x: ~F.col("copied") | ~x["lone"])
    of_text = settle(of_text.select("tid", F.transform(met, lambda x: x.dropFields("lone")).alias("found"), "copied", "hi"), "anchored")
    with_runs = texts.join(of_text.where(F.size("found") > 0), "tid").select("tid", "text", "found", "copied")
    dealt = settle(with_runs.mapInArrow(_context_batches(length), _DEALT), "dealt")
    marks = _matched(dealt.where("NOT hot").withColumnsRenamed({"parent": "owner", "at": "lo"}), length)
    marks = _own_runs(marks.union(of_text.where("copied").select("tid", F.lit(0), "hi")))
    frequent = dealt.where("hot").drop("hot")
    if frequent.limit(1).count():
        marks = marks.union(marks_of(frequent, length, (*(g for g in LONGER if GRAM < g < length), length)))
    return marks.groupBy("tid").agg(F.flatten(F.collect_list("runs")).alias("marks"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
