"""Nearest-neighbour search over vectors: exact top-k by pivot tables, and approximate by HNSW graphs.

Both deal the vectors to shards by a hash of id and vector, so a vector that a third of the rows repeat fills none. Each
shard is one task: its vectors come first and are indexed once, then the query set streams past in batches. The shards'
results are merged by a window that keeps k rows a query before it shuffles.

There are as many shards as the cluster has cores, while they hold SHARD_ROWS vectors or more, and then as many as it
takes for none to exceed SHARD_BYTES, which bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, table

K = 20
QUERY_EVERY = 20
SHARD_ROWS = 4096
SHARD_BYTES = 128 << 20
QUERY_ROWS = 256
PIVOTS = 24
SCALE = 64
#: Sums of products up to here are exact in doubles.
EXACT = 2.0**53


def _usable(vectors: DataFrame) -> DataFrame:
    """Distinct rows with an id and a vector whose components are all finite, numbered; in a table of their own."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = chosen.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    return settle(rows.distinct().withColumn("row", F.monotonically_increasing_id()), "vectors")


def shard_count(rows: int, size: int, cores: int) -> int:
    """Shards for so many rows of ``size`` bytes in all."""
    return max(1, -(-size // SHARD_BYTES), min(cores, rows // SHARD_ROWS))


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of one (width, shard) and kind: place, kind, row numbers, ids and the matrix."""
    if not batch.num_rows:
        return
    width, shard, kind, row, ids = (batch.column(i).to_numpy() for i in range(5))
    cut = np.flatnonzero((np.diff(width) != 0) | (np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(width)]):
        matrix = batch.column(5).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
        yield (int(width[a]), int(shard[a])), int(kind[a]), row[a:b], ids[a:b], matrix


def _search_batches(build: Callable, k: int, score: pa.DataType):
    """Rows sorted by (width, shard, kind): a shard's vectors (kind 0), then the queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, index = None, [], None
        for batch in batches:
            for here, kind, rows, ids, matrix in _segments(batch):
                if here != place:
                    place, held, index = here, [], None
                if not kind:
                    held.append((rows, ids, matrix))
                    continue
                if index is None and held:
                    index, held = build(*(np.concatenate(c) for c in zip(*held)), k), []
                for a in range(0, len(rows) if index else 0, QUERY_ROWS):
                    of, found, points = index(rows[a : a + QUERY_ROWS], matrix[a : a + QUERY_ROWS])
                    columns = [pa.array(rows[a + of]), pa.array(ids[a + of]), pa.array(found), pa.array(points, score)]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "query_id", "vec_id", "score"])

    return run


def _top(usable: DataFrame, build: Callable, kind: str, k: int, every: int, shards: int | None) -> DataFrame:
    """Search every shard for every query; vectors meet those of their own length only."""
    rows, components = usable.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    count = shards or shard_count(rows, 8 * (components or 0), usable.sparkSession.sparkContext.defaultParallelism)
    own = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(count)).cast("int")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    part = lambda shard, which, df: df.select(
        F.size("embedding").alias("width"), shard.alias("shard"), F.lit(which).alias("kind"), "row", "vec_id", "embedding"
    )
    asked = usable.where(F.pmod("vec_id", F.lit(every)) == 0)
    dealt = part(own, 0, usable).unionByName(part(every_shard, 1, asked)).repartitionById(count, F.col("shard"))
    search = _search_batches(build, k, pa.int64() if kind == "long" else pa.float64())
    found = dealt.sortWithinPartitions("width", "shard", "kind").mapInArrow(search, f"row long, query_id long, vec_id long, score {kind}")
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(64 x) as Python integers, whatever their size."""
    return np.array([[int(v) * SCALE if abs(v) >= EXACT else int(np.floor(v * SCALE)) for v in r] for r in x.tolist()], dtype=object)


def _exact_integers(raw: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Callable:
    """Search of a shard in integers of any size; a score beyond 64 bits is returned as the nearest number of these."""
    x = _whole(raw)

    def run(q_rows: np.ndarray, q: np.ndarray):
        of, found, points = [], [], []
        for i, v in enumerate(_whole(q)):
            ranked = sorted((-s, n) for s, n, r in zip((x @ v).tolist(), ids.tolist(), rows.tolist()) if r != q_rows[i])[:k]
            of += [i] * len(ranked)
            found += [n for _, n in ranked]
            points += [max(min(-s, (1 << 63) - 1), -(1 << 63)) for s, _ in ranked]
        return np.array(of, np.int64), np.array(found, np.int64), np.array(points, np.int64)

    return run


def pivot_search(rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> Callable:
    """Exact search of a shard of vectors floor(64 x) by elimination.

    The inner product is (|q|^2 + |x|^2 - |q - x|^2) / 2, and |q - x| is at least the largest difference of the two
    vectors' distances to any pivot. Candidates are evaluated in the order of the upper bounds that follow, until no
    bound is left that reaches the k-th best score.
    """
    place = np.argsort(ids, kind="stable")
    rows, ids, raw = rows[place], ids[place], matrix[place]
    with np.errstate(over="ignore"):
        x = np.floor(raw * SCALE)
        squares = (x * x).sum(1)
    largest = np.abs(x).max(initial=0)
    if squares.max(initial=0) >= EXACT / 4:
        return _exact_integers(raw, rows, ids, k)
    chosen = x[np.linspace(0, len(x) - 1, min(PIVOTS, len(x))).astype(int)]
    far = lambda m, sq: np.sqrt(np.maximum(sq[:, None] + (chosen * chosen).sum(1) - 2 * m @ chosen.T, 0))
    # distances are rounded outwards: float32 tables with a margin above their rounding error
    of_x = np.ascontiguousarray(far(x, squares).astype(np.float32).T)  # pivot by pivot
    margin = np.float32(1e-5) * (np.float32(np.sqrt(squares.max(initial=0))) + np.abs(of_x).max(initial=0) + 1)
    integers: list[Callable] = []

    def run(q_rows: np.ndarray, q_raw: np.ndarray):
        with np.errstate(over="ignore"):
            q = np.floor(q_raw * SCALE)
            sq = (q * q).sum(1)
        if max(largest, 1) * np.abs(q).max(initial=0) * q.shape[1] >= EXACT or sq.max(initial=0) >= EXACT / 4:
            integers[:] = integers or [_exact_integers(raw, rows, ids, k)]
            return integers[0](q_rows, q_raw)
        of_q = far(q, sq).astype(np.float32)
        out = []
        for i in range(len(q)):
            low = np.maximum(np.abs(of_x - of_q[i][:, None]).max(axis=0) - 2 * margin, 0).astype(np.float64)
            bound = np.floor((sq[i] + squares - low * low) / 2 + 1e-3)
            n = min(len(x), 16 * k)
            first = np.argpartition(-bound, n - 1)[:n] if n < len(x) else np.arange(len(x))
            other = rows[first] != q_rows[i]
            kept, got = first[other], (x[first] @ q[i])[other]
            least = np.partition(got, -k)[-k] if len(got) >= k else -np.inf
            open_ = bound >= least
            open_[first] = False
            rest = np.flatnonzero(open_)
            rest = rest[np.argsort(-bound[rest])]
            step = 1024
            while len(rest) and bound[rest[0]] >= least:
                now, rest = rest[:step], rest[step:]
                now = now[(rows[now] != q_rows[i]) & (bound[now] >= least)]
                kept, got = np.r_[kept, now], np.r_[got, x[now] @ q[i]]
                if len(got) >= k:
                    least = np.partition(got, -k)[-k]
                    live = got >= least
                    kept, got = kept[live], got[live]
            order = np.lexsort((ids[kept], -got))[:k]
            out.append((np.full(len(order), i), ids[kept[order]], got[order]))
        of, found, score = (np.concatenate(c) for c in zip(*out))
        return of.astype(np.int64), found.astype(np.int64), np.rint(score).astype(np.int64)

    return run


def exact_top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, shards: int | None = None) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score) of floor(64 x), by integer inner product.

    Vectors that are null, empty or hold a null or non-finite component take no part; others meet those of their own
    length. A row repeated whole counts once. Rows that share an id but not the vector are queries and candidates of
    their own, each query with k results. Ties go to the smaller vec_id. Sums beyond 2**53 are taken in integers of any
    size; a score beyond 64 bits is returned as the nearest number of these. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    return _top(_usable(vectors), pivot_search, "long", k, every, shards)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT q.vec_id AS query_id, q.embedding AS q, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c
  WHERE q.vec_id % 20 = 0 AND (c.vec_id <> q.vec_id OR c.embedding <> q.embedding) AND len(c.e) = len(q.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) <= 20
"""
