"""Near copies by SimHash with pivot distance tables, verified on word shingles.

Two texts are near when the Jaccard similarity of their sets of five-word shingles is at least 0.8. A set's SimHash has
4,096 bits here, the signs of as many projections of its shingles: a bit of two sets of similarity 0.8 differs with
probability 0.15, one of unrelated sets with a half. As in ``simhash``, blocks of bits deal the sets, but too many bits
differ for few blocks of equal bits to find every pair: tables are keyed by drawn bits, the more bits the more sets there
are, and there are as many tables as a pair of similarity 0.8 needs to meet in one but with probability 1e-6. In a
table's key the first 256 bits decide: distances to reference prints (pivots) are computed once a set, pairs beyond the
radius by the triangle inequality are discarded, then pairs beyond it by their own distance. The radius is more than five
standard deviations above the mean distance at similarity 0.8.

Exact bounds follow in the same place, so that texts that are alike but not near make no rows: the sizes; and a 512-bit
print of a set, the parities of its shingles by hash, in which two sets differ by no more bits than they differ in
shingles, again with pivots. Survivors are verified on the shingles.

Large groups of sets that are alike have many pairs, near or not. A key that holds more pairs than sets makes none: it is
crowded, and its sets meet with their shingles in one task, which verifies in place and gives spanning links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import roots
from .common import narrow, returning, scratch, settle, utf8

SHINGLE = 5
SEED = 42
#: Bits of a set's SimHash, a square; the first NARROW of them are compared, within RADIUS.
SIDE = 64
WIDE, NARROW = SIDE * SIDE, 256
RADIUS = 70
#: Tables: a bit is equal with this probability at least, so many sets may share a key on average, this share of pairs is
#: missed at most, so many tables are dealt at once.
EQUAL, KEY_ROWS, MISSED, AT_ONCE = 0.84, 16, 1e-6, 8
#: Tables in which sets first meet their key's leaders alone.
FIRST = 8
#: The blocks of minima (MinHash) propose nothing; tests hold the tables against them.
BLOCKS, ROWS = 40, 5
PARITIES = 512
PIVOTS = 16
#: Sets of fewer shingles are near to themselves only.
LEAST = 4
STEP = 1024
#: Shingles that are compared with a set's at once.
COMPARED = 1 << 22

_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 32, (BLOCKS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, (BLOCKS * ROWS, 1), dtype=np.uint32)
_FOLD = _draw.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NUMBER = _draw.integers(0, 1 << 63, BLOCKS, dtype=np.uint64)
_SIGNS = _draw.integers(0, 2, WIDE) * 2.0 - 1
_ORDER = _draw.permutation(WIDE)
_HADAMARD = 1.0 - 2 * (np.bitwise_count(np.arange(SIDE)[:, None] & np.arange(SIDE)) & 1)
_REFERENCES = _draw.integers(0, 1 << 63, (PIVOTS, NARROW // 64), dtype=np.uint64) * np.uint64(2)
#: Reference prints: a stretch of bits set in each, for sets of few shingles leave most bits unset.
_PIVOTS = np.packbits(np.arange(PARITIES) // (PARITIES // PIVOTS) == np.arange(PIVOTS)[:, None], axis=1).view(np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles; a shorter text is one shingle, no words are none."""
    words = (text or b"").lower().split()
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], dtype=np.uint64))


def near(common, a, b):
    """Is the Jaccard similarity of sets of sizes a and b with ``common`` members 0.8 or more?"""
    return 9 * common >= 4 * (a + b)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of shingles under each of the hash functions."""
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BLOCKS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(low), STEP):
        np.minimum(least, (low[at : at + STEP] * _TIMES + _PLUS).min(axis=1), out=least)
    return least


def block_keys(least: np.ndarray) -> np.ndarray:
    """(sets, functions) -> (sets, blocks): one number of a block's minima."""
    key = (least.reshape(-1, BLOCKS, ROWS).astype(np.uint64) * _FOLD).sum(axis=2, dtype=np.uint64) + _NUMBER
    key ^= key >> np.uint64(32)
    return key * np.uint64(0x9E3779B97F4A7C15)


def parities(hashes: np.ndarray) -> bytes:
    """Parities of the shingles by hash bucket: as many differ as the sets differ in shingles, or fewer."""
    return np.packbits(np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set of shingle hashes: (sets, WIDE // 8) bytes.

    A shingle adds or subtracts one at a place, both by its hash; two rounds of signs and a Hadamard transform spread the
    places, so that every sum is a projection of the whole set. Sums are integers, so the bits do not depend on the machine.
    """
    sums = np.zeros((len(sets), WIDE))
    for row, hashes in zip(sums, sets):
        place = (hashes >> np.uint64(10) & np.uint64(WIDE - 1)).astype(np.int64)
        row += np.bincount(place, weights=1.0 - 2 * (hashes >> np.uint64(63)).astype(np.float64), minlength=WIDE)
    for _ in range(2):
        sums *= _SIGNS
        half = (sums.reshape(-1, SIDE) @ _HADAMARD).reshape(-1, SIDE, SIDE).swapaxes(1, 2)
        sums = (half.reshape(-1, SIDE) @ _HADAMARD).reshape(-1, WIDE)
    return np.packbits(sums[:, _ORDER] > 0, axis=1)


def table_bits(sets: int) -> int:
    """How many bits key the tables of so many sets."""
    return max(8, int(np.ceil(np.log2(max(1, sets) / KEY_ROWS))))


def table_count(bits: int) -> int:
    return int(np.ceil(np.log(MISSED) / np.log1p(-(EQUAL**bits))))


def table_keys(prints: np.ndarray, bits: int, first: int, last: int) -> np.ndarray:
    """(prints, bytes) -> (prints, tables): the keys in the tables from ``first`` to ``last``, their number on top."""
    each = np.unpackbits(prints, axis=1)
    keys = np.empty((len(prints), last - first), dtype=np.int64)
    for i, number in enumerate(range(first, last)):
        drawn = np.random.default_rng((SEED, number)).choice(WIDE - NARROW, bits, replace=False) + NARROW
        keys[:, i] = each[:, drawn].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)) + (number << 48)
    return keys


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(t) for t in utf8(part.column(1))]
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDE // 8), len(sets), [None, pa.py_buffer(simhashes(sets).tobytes())])
            ids = np.array([_set_id(x) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), pa.array(ids), pa.array([len(x) for x in sets], type=pa.int64()),
                    bits.cast(pa.binary()), pa.array([parities(x) for x in sets], type=pa.binary()),
                ],
                ["doc_id", "text_hash", "fp", "n", "bits", "odd"],
            )


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, fp: the set of shingles, n: its size, bits: its SimHash, odd: its parities)."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")
    ).mapInArrow(returning(_print_batches), "doc_id long, text_hash long, fp long, n long, bits binary, odd binary")


def pivot_distances(bits: np.ndarray) -> np.ndarray:
    """(prints, words) -> (prints, pivots): the precomputed coordinates."""
    return np.stack([np.bitwise_count(bits ^ p).sum(axis=1, dtype=np.int16) for p in _PIVOTS], axis=1)


def possible_pairs(key: np.ndarray, n: np.ndarray, label: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of rows of one key and two labels that sizes, pivots and prints leave possible. Rows are sorted by key, n."""
    end, far = np.searchsorted(key, key, side="right"), pivot_distances(bits)
    rows, step = np.arange(len(key)), 1
    while len(rows):
        rows = rows[rows + step < end[rows]]
        rows = rows[5 * n[rows] >= 4 * n[rows + step]]
        take = rows[label[rows] != label[rows + step]]
        for part in np.array_split(take, len(take) // 100_000 + 1):
            most = n[part] + n[part + step]
            part = part[9 * np.abs(far[part] - far[part + step]).max(axis=1, initial=0).astype(np.int64) <= most]
            apart = np.bitwise_count(bits[part] ^ bits[part + step]).sum(axis=1, dtype=np.int64)
            part = part[9 * apart <= n[part] + n[part + step]]
            if len(part):
                yield np.stack([part, part + step], axis=1)
        step += 1


_WORDS = [f"w{i}" for i in range(NARROW // 64)]
_DEALT = "key long, fp long, label long, n long, odd binary, " + ", ".join(f"{w} long" for w in _WORDS)


def _deal_batches(bits: int, first: int, last: int):
    """(fp, label, n, odd, bits) -> a row for each of the tables from ``first`` to ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                wide = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.uint8).reshape(-1, WIDE // 8)
                words = np.ascontiguousarray(wide[:, : NARROW // 8]).view(np.int64)
                each = lambda c: np.repeat(c, last - first)
                odd = part.column(3).take(pa.array(each(np.arange(len(wide)))))
                columns = [*(each(part.column(i).to_numpy()) for i in range(3)), odd, *(each(w) for w in words.T)]
                keys = table_keys(wide, bits, first, last).ravel()
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in (keys, *columns)], ["key", "fp", "label", "n", "odd", *_WORDS])

    return run


def reference_distances(prints: np.ndarray) -> np.ndarray:
    """(prints, words) -> (prints, pivots): Hamming distances to the reference prints."""
    return np.stack([np.bitwise_count(prints ^ p).sum(axis=1, dtype=np.int16) for p in _REFERENCES], axis=1)


def within(prints: np.ndarray, far: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows a, b lie within the radius; ``far``: distances to the pivots, which discard some pairs."""
    maybe = np.abs(far[a] - far[b]).max(axis=1, initial=0) <= RADIUS
    maybe[maybe] = np.bitwise_count(prints[a[maybe]] ^ prints[b[maybe]]).sum(axis=1, dtype=np.int64) <= RADIUS
    return maybe


def leaders(key: np.ndarray, label: np.ndarray, prints: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (leader, row) of sorted keys: a key's first row leads those within the radius, then the first of the rest."""
    far, rows = reference_distances(prints), np.arange(len(key))
    while len(rows):
        lead = rows[np.r_[True, key[rows[1:]] != key[rows[:-1]]]]
        of = lead[np.searchsorted(key[lead], key[rows])]
        near = (rows != of) & within(prints, far, of, rows)
        if near.any():
            yield np.stack([of[near], rows[near]], axis=1)
        rows = rows[~near & (rows != of)]


def pairs_in_tables(key: np.ndarray, label: np.ndarray, prints: np.ndarray, left: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs of rows of one key and two labels that lie within the radius. Rows are sorted by key. ``left``: rows that are
    left out from now on; the caller may set more between two pieces."""
    end, far = np.searchsorted(key, key, side="right"), reference_distances(prints)
    rows, step = np.arange(len(key)), 1
    while len(rows):
        rows = rows[rows + step < end[rows]]
        if left is not None:
            rows = rows[~left[rows]]
        take = rows[label[rows] != label[rows + step]]
        for part in np.array_split(take, len(take) // 100_000 + 1):
            part = part[within(prints, far, part, part + step)]
            if len(part):
                yield np.stack([part, part + step], axis=1)
        step += 1


def bounded(pairs: np.ndarray, n: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The pairs of rows that sizes and parities leave possible, as in ``possible_pairs``."""
    a, b = pairs.T
    a, b = (x[5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])] for x in (a, b))
    apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
    return np.stack([a, b], axis=1)[9 * apart <= n[a] + n[b]]


def uncrowded(key: np.ndarray, label: np.ndarray, n: np.ndarray, odd: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in tables that exact bounds leave, and which rows are of crowded keys, whose pairs are not among them."""
    number = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    sets = np.bincount(number, minlength=1)
    made, crowded, seen = np.zeros_like(sets), np.zeros(len(key), dtype=bool), [np.empty((0, 2), np.int64)]
    for pairs in pairs_in_tables(key, label, prints, crowded):
        seen.append(bounded(pairs, n, odd))
        made += np.bincount(number[seen[-1][:, 0]], minlength=len(sets))
        crowded |= (made > sets)[number]
    pairs = np.concatenate(seen)
    return pairs[~crowded[pairs[:, 0]]], crowded


def _pair_batches(scan):
    """Rows of tables, sorted by key -> pairs (u, v, null) that ``scan`` finds in them and exact bounds leave; of crowded
    keys, if all pairs are asked for, the rows (fp, label, key)."""

    def found(held):
        key, fp, label, n, odd, *words = (np.concatenate(c) for c in zip(*held))
        prints, crowded = np.stack(words, axis=1).view(np.uint64), np.zeros(len(key), dtype=bool)
        if scan is pairs_in_tables:
            pairs, crowded = uncrowded(key, label, n, odd, prints)
        else:
            pairs = np.concatenate([np.empty((0, 2), np.int64), *(bounded(p, n, odd) for p in scan(key, label, prints))])
        ends = np.unique(np.sort(fp[pairs], axis=1), axis=0)  # many tables of a task hold the same pairs
        keys = pa.concat_arrays([pa.nulls(len(ends), pa.int64()), pa.array(key[crowded])])
        return pa.RecordBatch.from_arrays([*(pa.array(np.r_[e, c[crowded]]) for e, c in zip(ends.T, (fp, label))), keys], ["u", "v", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of whole keys, but for the last one, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, label, n = (batch.column(i).to_numpy() for i in range(4))
            odd = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint64).reshape(-1, PARITIES // 64)
            columns = (key, fp, label, n, odd, *(c.to_numpy() for c in batch.columns[5:]))
            last = int(np.searchsorted(key, key[-1]))
            if held and key[0] == key[-1] == held[-1][0][-1]:
                held.append(columns)
                continue
            held.append(tuple(c[:last] for c in columns))
            yield found(held)
            held = [tuple(c[last:] for c in columns)]
        if held:
            yield found(held)

    return run


def _met(labelled: DataFrame, bits: int, first: int, last: int, scan) -> DataFrame:
    """(fp, label, n, odd, bits) -> pairs (u, v, null) that meet in the tables from ``first`` to ``last``; crowded (fp, label, key)."""
    dealt = labelled.select("fp", "label", "n", "odd", "bits").mapInArrow(returning(_deal_batches(bits, first, last)), _DEALT)
    return settle(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(returning(_pair_batches(scan)), "u long, v long, key long").distinct(), "met")


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in utf8(batch.column(1))]
        members = pa.array([x.tobytes() for x in sets], type=pa.large_binary()).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), members, pa.array([parities(x) for x in sets], type=pa.binary())], ["fp", "members", "bits"])


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, and the members and parities of both) -> the pairs that are near."""
    for batch in batches:
        sets = [[np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(i)] for i in (2, 3)]
        n = np.array([[len(a), len(b)] for a, b in zip(*sets)], dtype=np.int64).reshape(-1, 2)
        order = np.argsort(n, axis=1, kind="stable")
        bits = np.array([[np.frombuffer(x, dtype=np.uint64) for x in pair] for pair in zip(*(batch.column(i).to_pylist() for i in (4, 5)))])
        bits = np.take_along_axis(bits.reshape(-1, 2, PARITIES // 64), order[:, :, None], axis=1).reshape(-1, PARITIES // 64)
        rows = np.arange(2 * len(n))
        keep = np.zeros(len(n), dtype=bool)
        for pairs in possible_pairs(rows // 2, np.sort(n, axis=1).ravel(), rows, bits):
            for i in (pairs[:, 0] // 2).tolist():
                a, b = sets[0][i], sets[1][i]
                keep[i] = near(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))
        yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))


def _members(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, members, bits) of the sets of some pairs: hashes and their parities, from the first document of each."""
    ends = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
    wanted = settle(ends.join(sets.select("fp", "keep_id", "keep_hash"), "fp"), "wanted")
    hashed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_hash"))
    found = hashed.join(narrow(wanted, wanted.count()), same).select("fp", "text").mapInArrow(returning(_set_batches), "fp long, members binary, bits binary")
    return settle(found.dropDuplicates(["fp"]), "members")


def spanning(label: np.ndarray, bits: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Near pairs (row, row) that join all labels which near pairs join, and no more than that takes; ``bits``: parities."""
    n, far, label = np.array([len(x) for x in sets], dtype=np.int64), pivot_distances(bits), label.copy()
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    has, links = np.zeros(ids.max() + 1, dtype=bool), []
    ids = np.split(ids, np.cumsum(n)[:-1])
    for i in range(len(n)):
        rows = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        rows = rows[5 * np.minimum(n[rows], n[i]) >= 4 * np.maximum(n[rows], n[i])]
        rows = rows[9 * np.abs(far[rows] - far[i]).max(axis=1, initial=0).astype(np.int64) <= n[rows] + n[i]]
        rows = rows[9 * np.bitwise_count(bits[rows] ^ bits[i]).sum(axis=1, dtype=np.int64) <= n[rows] + n[i]]
        has[ids[i]] = True
        for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(n[rows]) // COMPARED)) + 1) if len(rows) else ():
            common = np.add.reduceat(has[np.concatenate([ids[j] for j in part])], np.r_[0, np.cumsum(n[part])[:-1]], dtype=np.int64)
            part = part[near(common, n[part], n[i])]
            part = part[label[part] != label[i]]
            first = part[np.unique(label[part], return_index=True)[1]]
            links += [(i, j) for j in first.tolist()]
            label[np.isin(label, label[first])] = label[i]
        has[ids[i]] = False
    return links


def _spanning_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, label, members, bits), sorted by key -> spanning links (u, v) of each key."""

    def found(held):
        fp, label, members, bits = (np.concatenate([h[i] for h in held]) if i != 2 else sum((h[i] for h in held), []) for i in range(4))
        pairs = np.array(spanning(label, bits, members), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], ["u", "v"])

    now, held = None, []
    for batch in batches:
        key = batch.column(0).to_numpy()
        edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else [0]
        for at, end in zip(edges, edges[1:]):
            if held and key[at] != now:
                yield found(held)
                held = []
            part, now = batch.slice(at, end - at), key[at]
            members = [np.frombuffer(x, dtype=np.uint64) for x in part.column(3).to_pylist()]
            bits = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.uint64).reshape(-1, PARITIES // 64)
            held.append((part.column(1).to_numpy(), part.column(2).to_numpy(), members, bits))
    if held:
        yield found(held)


def _spanned(crowd: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (u: set, v: label, key) of crowded keys -> near links (u, v) that span what is near in each key."""
    rows = crowd.select("key", F.col("u").alias("fp"), F.col("v").alias("label")).join(members, "fp").select("key", "fp", "label", "members", "bits")
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return settle(dealt.mapInArrow(returning(_spanning_batches), "u long, v long").distinct(), "spans")


def _crowd_first(met: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Near links of the crowded keys in ``met``, if there are any."""
    crowd = met.where("key IS NOT NULL")
    if not crowd.limit(1).count():
        return None
    with scratch(docs.sparkSession) as keep:
        return keep(_spanned(crowd, _members(crowd.select("u", F.col("u").alias("v")), sets, docs)))


def _verified(pairs: DataFrame, crowd: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets that are near by their shingles, and the links of crowded keys."""
    with scratch(docs.sparkSession) as keep:
        some = bool(crowd.limit(1).count())
        members = _members(pairs.union(crowd.select("u", F.col("u").alias("v"))) if some else pairs, sets, docs)
        both = pairs.join(members.toDF("u", "a", "x"), "u").join(members.toDF("v", "b", "y"), "v")
        links = keep(settle(both.select("u", "v", "a", "b", "x", "y").mapInArrow(returning(_verify_batches), "u long, v long"), "near-links"))
        return links.union(keep(_spanned(crowd, members))) if some else links


def groups(docs: DataFrame, printed: DataFrame) -> DataFrame:
    """Settled prints of docs -> (fp, keep_id, keep_hash, root): the sets, the first document of each and its group."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("k")
    with scratch(docs.sparkSession) as keep:
        sets = settle(
            printed.groupBy("fp").agg(first, F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("odd").alias("odd"))
            .select("fp", F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash"), "n", "bits", "odd"),
            "sets",
        )
        bits = table_bits(sets.count())
        count = table_count(bits)
        dealt = sets.where(F.col("n") >= LEAST)

        def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
            label = roots(links)
            own = label.toDF("fp", "v")
            return label, dealt.join(narrow(own, label.count()), "fp", "left").withColumn("label", F.coalesce("v", "fp"))

        # first leaders with their followers: a large group of near copies is then a few groups
        met = _met(dealt.withColumn("label", F.col("fp")), bits, 0, FIRST, leaders)
        star = met.select("u", "v")
        label, rows = labelled(_verified(star, met.where("key IS NOT NULL"), sets, docs))
        # then the pairs of every table that lie in two groups still; what is crowded in the first tables is joined at once
        met = [_met(rows, bits, 0, min(AT_ONCE, count), pairs_in_tables)]
        spans = _crowd_first(met[0], sets, docs)
        if spans:
            label, rows = labelled(label.union(spans))
        met += [_met(rows, bits, at, min(at + AT_ONCE, count), pairs_in_tables) for at in range(AT_ONCE, count, AT_ONCE)]
        across = reduce(DataFrame.union, [m.where("key IS NULL").select("u", "v") for m in met]).distinct()
        across = settle(across.join(star, ["u", "v"], "left_anti"), "across")
        crowd = reduce(DataFrame.union, [m.where("key IS NOT NULL") for m in met[1:]], met[0].limit(0))
        root = roots(label.union(_verified(across, crowd, sets, docs))).withColumnRenamed("u", "fp")
        return keep(settle(
            sets.select("fp", "keep_id", "keep_hash").join(root, "fp", "left")
            .select("fp", "keep_id", "keep_hash", F.coalesce("v", "fp").alias("root")),
            "near-groups",
        ))
