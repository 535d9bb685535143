"""Cutting lineage: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: the shuffle files of a statement are freed when it ends, instead of when the driver's
#: garbage collector finds them; and rows go to Python in batches of 4 MB, since executor and worker each hold several
#: (10,000 rows, Spark's default, are 33 MB of texts of usual length). A longer row is a batch of its own.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

_lock = threading.Lock()
_writers: dict = {"now": 0, "before": {}}
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a single-process session without it gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """The session has the settings for writing while any thread is within; then its own hold again."""
    with _lock:
        if not _writers["now"]:
            _writers["before"] = {k: spark.conf.get(k, None) for k in _WRITING}
            for k, v in _WRITING.items():
                spark.conf.set(k, v)
        _writers["now"] += 1
    try:
        yield
    finally:
        with _lock:
            _writers["now"] -= 1
            if not _writers["now"]:
                for k, v in _writers["before"].items():
                    if v is None:
                        spark.conf.unset(k)
                    else:
                        spark.conf.set(k, v)


def _place(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if stack := getattr(_scopes, "stack", None):
        stack[-1].append(path)
    return path


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with _writing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read that; a lost executor costs no earlier step."""
    return _written(df, _place(df.sparkSession, tag))


def settle_all(*frames: tuple[DataFrame, str]) -> list[DataFrame]:
    """Settle (df, tag) that don't depend on each other, at the same time: small steps wait for planning, not for cores."""
    places = [_place(df.sparkSession, tag) for df, tag in frames]
    with ThreadPoolExecutor(max_workers=4) as pool:
        return list(pool.map(lambda x: _written(x[0][0], x[1]), zip(frames, places)))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled inside are deleted at the end, but for those passed to the function that this gives: they belong
    to the scope around. What leaves the scope must read kept tables only."""
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    stack, kept = _scopes.stack, []
    stack.append([])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._settled_at)
        return df

    try:
        yield keep
    finally:
        own = stack.pop()
        if stack:
            stack[-1].extend(p for p in own if p in kept)
        for path in own:
            if path not in kept:
                drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
