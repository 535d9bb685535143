import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import common, nearcopies, simhash
from ledgerloom.llm.common import table

from .helpers import DATA


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_kept(rows):
    """rows: (doc_id, text) -> the least id of each group of near copies."""
    sets, group = [plain_shingles(t) for _, t in rows], {i: {i} for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if group[i] is not group[j] and plain_near(sets[i], sets[j]):
            merged = group[i] | group[j]
            for k in merged:
                group[k] = merged
    return sorted({min(rows[k][0] for k in group[i]) for i in range(len(rows))})


def edited(words, places):
    return [f"{w}x" if i in places else w for i, w in enumerate(words)]


def test_near_copies_beyond_the_radius_go(spark):
    """One word changed in fifty five or so leaves similarity 0.83 and fingerprints more than four bits apart."""
    rng, rows = random.Random(5), []
    for text in range(40):
        words = [f"w{rng.randrange(100_000)}" for _ in range(220)]
        rows += [(3 * text, words), (3 * text + 1, edited(words, {20, 80, 140, 200})), (3 * text + 2, edited(words, set(range(0, 220, 8))))]
    rows = [(d, " ".join(w)) for d, w in rows]
    apart = [(simhash.fingerprint(rows[i][1].encode()) ^ simhash.fingerprint(rows[i + 1][1].encode())).bit_count() for i in range(0, 120, 3)]
    assert sum(a > 4 for a in apart) > 20
    want = plain_kept(rows)
    assert len(want) == 80
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


@pytest.mark.parametrize("rows", [None, 3])
def test_kept_documents_against_brute_force(spark, monkeypatch, rows):
    """By broadcast lists of ids, and by shuffles where these are long."""
    if rows:
        monkeypatch.setattr(common, "NARROW_ROWS", rows)
        monkeypatch.setattr(simhash, "NARROW_ROWS", rows)
    docs = table(spark, DATA, "documents")
    want = plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want


def test_chains_within_a_large_group(spark):
    """Neighbours in a chain are near, its ends are not: stars about the least set do not reach all of it."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(words, set(range(0, 7 * i, 7))))) for i in range(40)]
    assert not plain_near(plain_shingles(rows[0][1]), plain_shingles(rows[-1][1]))
    want = plain_kept(rows)
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want == [0]


def test_bounds_lose_no_near_pair():
    rng = np.random.default_rng(6)
    for size in (4, 5, 20, 400, 3000):
        for changed in {0, size // 20, size // 10, size // 9, size // 5}:
            base = rng.integers(0, 1 << 63, size + changed, dtype=np.uint64)
            both = [np.sort(base[:size]), np.sort(base[changed:])]
            both.sort(key=len)
            n = np.array([len(x) for x in both])
            bits = np.stack([np.frombuffer(nearcopies.parities(x), dtype=np.uint64) for x in both])
            found = list(nearcopies.possible_pairs(np.zeros(2, np.int64), n, np.arange(2), bits))
            common = len(np.intersect1d(*both))
            assert found or 5 * common < 4 * (n.sum() - common)


def test_blocks_find_pairs_of_the_least_similarity():
    rng, missed = np.random.default_rng(7), 0
    for _ in range(300):
        base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = nearcopies.minima(base[:180]), nearcopies.minima(base[20:])
        missed += not (nearcopies.block_keys(a[None]) == nearcopies.block_keys(b[None])).any()
    assert missed == 0


def test_simhash_tables_find_what_minima_find():
    """Pairs of the least similarity meet in a table within the radius, at any number of sets; unrelated sets are not near."""
    rng = np.random.default_rng(8)
    for size in (5, 10, 100, 1000):
        base = [rng.integers(0, 1 << 63, size + size // 10 + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(60)]
        share = size - size // 10
        sets = [b[:size] for b in base] + [np.r_[b[:share], b[size : size + size // 10]] for b in base]
        wide = nearcopies.simhashes(sets)
        narrow = np.ascontiguousarray(wide[:, : nearcopies.NARROW // 8]).view(np.uint64)
        far, a = nearcopies.reference_distances(narrow), np.arange(60)
        assert nearcopies.within(narrow, far, a, a + 60).all() and not nearcopies.within(narrow, far, a, (a + 1) % 60).any()
        for bits in (8, 14, 20):
            keys = nearcopies.table_keys(wide, bits, 0, nearcopies.table_count(bits))
            assert (keys[:60] == keys[60:]).any(axis=1).all()


def test_scans_of_tables():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64)
    prints = base[[0, 1, 0, 1, 2, 0, 0]].copy()
    prints[2, 0] ^= np.uint64(7)
    key, label = np.array([1, 1, 1, 1, 1, 1, 2]), np.arange(7)
    pairs = lambda scan, label: sorted(map(tuple, np.concatenate([*scan(key, label, prints), np.empty((0, 2), int)]).tolist()))
    assert pairs(nearcopies.leaders, label) == [(0, 2), (0, 5), (1, 3)]
    assert pairs(nearcopies.pairs_in_tables, label) == [(0, 2), (0, 5), (1, 3), (2, 5)]
    assert pairs(nearcopies.pairs_in_tables, np.array([0, 1, 0, 1, 4, 5, 6])) == [(0, 5), (2, 5)]


def alike(count, words=600, changed=7, seed=10):
    """Copies of one text, each with a few words of its own: of most pairs, the similarity is 0.76 to 0.82."""
    rng, base = random.Random(seed), [f"w{i}" for i in range(words)]
    out = []
    for i in range(count):
        places = set(rng.sample(range(words), changed - i % 2))
        out.append(" ".join(f"{w}x{i}" if at in places else w for at, w in enumerate(base)))
    return out


def test_crowded_keys_make_no_more_rows_than_sets():
    sets = [nearcopies.shingles(t.encode()) for t in alike(400)]
    wide, n = nearcopies.simhashes(sets), np.array([len(x) for x in sets])
    words = np.ascontiguousarray(wide[:, : nearcopies.NARROW // 8]).view(np.int64)
    fp, key = np.arange(400), np.repeat([7, 9], [390, 10])
    odd = pa.array([nearcopies.parities(x) for x in sets], type=pa.binary())
    names = ["key", "fp", "label", "n", "odd", *nearcopies._WORDS]
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(fp), pa.array(n), odd, *map(pa.array, words.T)], names)
    assert sum(b.num_rows for b in nearcopies._pair_batches(nearcopies.pairs_in_tables)(iter([batch]))) <= 400


def test_spanning_links_join_what_near_pairs_join(monkeypatch):
    sets = [nearcopies.shingles(t.encode()) for t in alike(90) + alike(40, changed=8, seed=11) + alike(20, words=300)]
    bits, label = np.stack([np.frombuffer(nearcopies.parities(x), dtype=np.uint64) for x in sets]), np.arange(len(sets))
    label[40:60] = 40
    group = lambda links: [min(g) for g in _joined(len(sets), [*links, *((40, i) for i in range(41, 60))])]
    near = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if plain_near(set(sets[i].tolist()), set(sets[j].tolist()))]
    for compared in (nearcopies.COMPARED, 1000):
        monkeypatch.setattr(nearcopies, "COMPARED", compared)
        links = nearcopies.spanning(label, bits, sets)
        assert set(links) <= set(near) and group(links) == group(near)
        assert len(links) == len(set(label.tolist())) - len(set(group(links)))


def _joined(count, links):
    group = [{i} for i in range(count)]
    for i, j in links:
        if group[i] is not group[j]:
            merged = group[i] | group[j]
            for k in merged:
                group[k] = merged
    return group


def test_large_groups_of_sets_alike_against_brute_force(spark, monkeypatch):
    rows, crowds, spanned = list(enumerate(alike(60) + alike(90, changed=9, seed=12))), [], nearcopies._spanned
    monkeypatch.setattr(nearcopies, "_spanned", lambda crowd, members: crowds.append(crowd.count()) or spanned(crowd, members))
    want = plain_kept(rows)
    assert 1 < len(want) < 150
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want
    assert len(crowds) == 2 and all(crowds)
