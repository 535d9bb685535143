import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.common import table

from .helpers import DATA, awkward, empty


def plain_print(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """rows: (doc_id, fingerprint) -> doc_id -> least id reachable."""
    group = {i: {i} for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 4 and group[i] is not group[j]:
            merged = group[i] | group[j]
            for k in merged:
                group[k] = merged
    return [min((rows[k][0] for k in group[i] if rows[k][0] is not None), default=None) for i in range(len(rows))]


def test_against_brute_force(spark):
    docs = table(spark, DATA, "documents")
    texts = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    want = sorted((d, f"{p:016x}", c) for (d, p), c in zip(texts, plain_groups(texts)))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert len({c for *_, c in want}) < len(want)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[2].component_id == 1 and of[3].component_id == of[4].component_id == of[5].component_id == 3
    assert of[4].fingerprint == "0" * 16
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_are_complete():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(12)}
    fps = np.array(sorted(prints), dtype=np.uint64)
    first = np.bitwise_count(fps ^ simhash.pivots(1)[0])
    fps = fps[np.argsort(first, kind="stable")]
    links = simhash.links_in_tables(np.zeros(len(fps), np.int64), fps, simhash.pivot_distances(fps))
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 4 for a, b in links)
    group = list(range(len(fps)))
    for a, b in links:
        group = [group[a] if g == group[b] else g for g in group]
    want = plain_groups([(i, int(f)) for i, f in enumerate(fps)])
    assert len(set(zip(group, want))) == len(set(group)) == len(set(want))


def test_tables_catch_every_pair_within_the_radius(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        pairs += [a, a ^ sum(1 << k for k in rng.sample(range(64), 4))]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "n long, fp long")
    for equal, tables in ((2, 15), (3, 35), (4, 70)):
        keys = {r.n: set(r["keys"]) for r in frame.select("n", F.array(*simhash._tables(equal)).alias("keys")).collect()}
        assert all(keys[i] & keys[i + 1] for i in range(0, len(pairs), 2))
        assert {len(k) for k in keys.values()} == {tables}
        assert sum(w for _, w in simhash.blocks(equal)) == 64
    assert [simhash.equal_blocks(n) for n in (0, 10**6, 10**9, 10**12)] == [2, 2, 3, 4]


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 7]
    assert kept.where("doc_id IS NULL").count() == 1
    rows = [(1, "one two three four five"), (1, "quite another text stands here"), (None, "one two three four five")]
    clash = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(clash.collect()) == sorted(spark.createDataFrame(rows[:2], "doc_id long, text string").collect())


def test_extra_columns_with_clashing_names(spark):
    own = ["keep_id", "keep_hash", "id", "hash", "row", "fp", "root", "n", "text_hash", "__hash", "keys", "bits"]
    docs = awkward(spark)
    clash = docs.select("*", *[F.lit(7).alias(c) for c in own if c != "fp"])
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns and kept.select(*docs.columns).exceptAll(simhash.keep_one(docs)).count() == 0
    assert kept.where("keep_id = 7 AND `__hash` = 7").count() == simhash.keep_one(docs).count()
    assert sorted(map(tuple, simhash.near_duplicates(clash).collect()), key=str) == sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert simhash.keep_one(empty(spark)).count() == 0


def test_query_columns(spark):
    found = simhash.op2_simhash_neardup(spark, DATA)
    assert found.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert found.count() == table(spark, DATA, "documents").count()
