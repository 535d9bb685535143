import math

import numpy as np
import pytest

from ledgerloom.llm import hnsw, vectors
from ledgerloom.llm.common import table

from .helpers import DATA

BIG = "/root/testdata/sf0.1"


def brute(rows, k=20, every=20):
    out = {}
    for qi, q in rows:
        if qi % every == 0:
            scored = sorted((-float(np.dot(v, q)), i) for i, v in rows if i != qi)
            out[qi] = [(i, -s) for s, i in scored[:k]]
    return out


def test_exact_search_equals_brute_force(spark):
    table_ = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, np.floor(64 * np.array(r.embedding, dtype=np.float64))) for r in table_.collect()]
    want = {(q, n + 1, i, int(s)) for q, found in brute(rows).items() for n, (i, s) in enumerate(found)}
    assert set(map(tuple, vectors.exact_top_k(table_, shards=4).collect())) == want


def recall(found, ids, matrix):
    """Share of the true 20 nearest that were found; scores, ranks and ties are checked on the way."""
    got, hits, total = {}, 0, 0
    for r in found:
        got.setdefault(r.query_id, []).append(r)
    for q in ids[ids % 20 == 0].tolist():
        score = matrix @ matrix[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)).tolist() if ids[i] != q][:20]
        hits += len({int(ids[i]) for i in order} & {r.vec_id for r in got[q]})
        total += len(order)
        best = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in best] == list(range(1, 21))
        assert all(math.isclose(r.score, score[ids == r.vec_id][0], abs_tol=1e-9) for r in best)
        assert [(-r.score, r.vec_id) for r in best] == sorted((-r.score, r.vec_id) for r in best)
    return hits / total


@pytest.mark.parametrize("shards", [None, 3])
def test_graph_recall_and_scores(spark, shards):
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in table(spark, BIG, "embeddings").collect()]
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found = hnsw.op1_ann_hnsw(spark, BIG) if shards is None else hnsw.nearest(table(spark, BIG, "embeddings"), shards=shards)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert recall(found.collect(), ids, matrix) >= 0.95


@pytest.mark.parametrize("spread", [False, True])
def test_recall_on_hard_data_in_several_shards(spark, spread):
    """Gaussian vectors, which have no near neighbours, of one length or of very different ones; the query's defaults."""
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(10_000, 64)) * (np.exp(rng.normal(size=(10_000, 1))) if spread else 1)
    assert vectors.shard_count(10_000, matrix.nbytes, spark.sparkContext.defaultParallelism) == 2
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(matrix.tolist())], "vec_id long, embedding array<double>")
    assert recall(hnsw.nearest(frame).collect(), np.arange(10_000), matrix) >= 0.9


def test_shards_by_cores_and_then_by_memory():
    count = lambda rows: vectors.shard_count(rows, rows * 512, 4000)
    assert [count(n) for n in (0, 5000, 50_000, 10**9, 10**11)] == [1, 1, 12, 4000, 381_470]


def test_a_connected_graph_finds_far_clusters():
    rng = np.random.default_rng(3)
    centres = 30 * rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(size=(100, 16)) for c in centres])
    rows = np.arange(len(x))
    of, found, _ = hnsw.graph_search(rows, rows, x, 20)(np.full(50, -1), x[::80])
    want = np.argsort(-(x[::80] @ x.T), axis=1)[:, :20]
    assert np.mean([len(np.intersect1d(found[of == i], want[i])) for i in range(50)]) >= 18


def test_nearest_of_blocks_equals_a_full_sort():
    rng = np.random.default_rng(4)
    graph = hnsw.Graph(rng.normal(size=(3001, 5)))
    of = rng.normal(size=(7, 6)).astype(np.float32)
    for size in (1, 30, 700, 1500, 3001):
        sims = of @ graph.x[:size].T
        want = np.sort(-sims, axis=1)[:, :20]
        assert np.allclose(np.sort(-np.take_along_axis(sims, graph.nearest(of, size, 20), 1), axis=1), want)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20 * i, [1.0, 0.0]) for i in range(30)] + [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0])]
    rows += [(4, [None, 1.0]), (5, [inf, 0.0]), (6, []), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (40, [2.0, 0.0])]
    own = "row long, shard int, kind int, width int, query_id long, rank int, score int"
    frame = spark.createDataFrame([(i, v, *[0] * 7) for i, v in rows], "vec_id long, embedding array<float>, " + own)
    near = hnsw.nearest(frame).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in near[:3]] == [40, 20, 40] and len(near) == 20
    exact = vectors.exact_top_k(frame)
    assert [r.vec_id for r in exact.where("query_id = 0").orderBy("rank").collect()] == [40, 20, 40, *range(60, 400, 20)]
    assert exact.where("vec_id = 7").count() == 0 and exact.where("vec_id IN (2, 3, 4, 5, 6)").count() == 0
    # two rows of one id and different vectors are two queries, and candidates of each other
    twins = [r for r in exact.where("query_id = 40").collect() if r["rank"] == 1]
    assert sorted((r.vec_id, r.score) for r in twins) == [(0, 2 * 4096), (40, 2 * 4096)] and exact.where("query_id = 40").count() == 40
    none = frame.where("vec_id < 0")
    assert hnsw.nearest(none).count() == vectors.exact_top_k(none).count() == 0
    few = frame.where("vec_id IN (0, 1)")
    assert [tuple(r) for r in vectors.exact_top_k(few).collect()] == [(0, 1, 1, 64 * 32)]
    assert hnsw.nearest(few).count() == 1


def test_vectors_meet_those_of_their_length(spark):
    rows = [(i, [1.0 + i] * (2 + i % 2)) for i in range(60)] + [(100, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for found in (vectors.exact_top_k(frame, shards=3), hnsw.nearest(frame, shards=3)):
        got = [(r.query_id, r.vec_id) for r in found.collect()]
        assert {q for q, _ in got} == {0, 20, 40} and all(q % 2 == v % 2 for q, v in got) and len(got) == 60


def test_scores_beyond_doubles(spark):
    big = float(2**40 + 1)
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [big, 3.0]), (3, [1e200, 0.0]), (4, [-1e200, 0.0])]
    found = vectors.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(i, 2**63 - 1) for i in (1, 2, 3)] + [(4, -(2**63))]
    near = [(0, [float(2**22), 1.0]), (1, [float(2**22), 3.0]), (2, [float(2**22), 2.0])]
    found = vectors.exact_top_k(spark.createDataFrame(near, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 2**56 + 3 * 4096), (2, 2**56 + 2 * 4096)]


def test_elimination_skips_what_the_bounds_rule_out():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8))
    whole = np.floor(64 * x)
    of, found, score = vectors.pivot_search(np.arange(700), np.arange(700), x, 5)(np.array([-1]), x[:1])
    want = sorted(((-int(s), i) for i, s in enumerate(whole @ whole[0])))[:5]
    assert list(zip((-score).tolist(), found.tolist())) == want and set(of.tolist()) == {0}


def test_query_columns(spark):
    found = vectors.op6_exact_topk(spark, DATA)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
