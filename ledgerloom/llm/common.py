"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..lineage import scratch, settle, shared_dir

__all__ = ["BROADCAST_ROWS", "held_out", "loaded", "narrow", "returning", "sampled", "scratch", "settle", "shared_dir", "sized", "table", "utf8", "whole"]

#: A side of a join is broadcast only when it was counted to have at most this many rows.
BROADCAST_ROWS = 10_000
NARROW_ROWS = 1 << 20

_held: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within the bound, as it is otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """``sized`` for rows of a few numbers, 32 bytes each at most: a broadcast of 32 MB spares a shuffle of texts."""
    return F.broadcast(df) if rows <= NARROW_ROWS else df


def whole(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no classifier learns from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce((F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3) == 1, F.lit(False))


def sampled(rows: DataFrame, most: int, size: int) -> list[Row]:
    """rows (h, t: hashes of id and text; text, others) -> at most ``most`` rows, those of the least hashes, less those
    whose whole texts don't fit into ``size`` bytes any more. The order does not depend on how rows are stored."""
    bounds, left = [], size
    for r in rows.select("h", "t", F.octet_length("text").alias("n")).orderBy("h", "t").limit(most).collect():
        if r.n <= left:
            left -= r.n
            bounds.append((r.h, r.t))
    spark, names = rows.sparkSession, rows.columns
    few = spark.createDataFrame(bounds, "h long, t long").distinct()  # at most ``most`` rows
    chosen = rows.join(F.broadcast(few), ["h", "t"]).select(*names).orderBy("h", "t").limit(len(bounds))
    return chosen.collect()


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` over a partition's batches; at its end the worker gives freed memory back to the system. Workers live on
    for the next stage and would hold what the greediest one needed, beside the executor's heap."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return over


def loaded(make: Callable, given):
    """``make(given)``, which the worker keeps for its next partitions; what it kept for another stage goes."""
    if (make, given) not in _held:
        _held.clear()
        release()
        _held[make, given] = make(given)
    return _held[make, given]


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def utf8(column: pa.Array) -> list:
    """The values of a string column as ``bytes`` (None for null)."""
    return column.cast(pa.large_binary()).to_pylist()
