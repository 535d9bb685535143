"""Streaming ingest: files that arrive in a landing folder are imported, then reconciled, batch by batch.

Late rows are those with an early business date; they are not dropped by a watermark but loaded, and the next run
takes them in. The result equals importing the same files one by one.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import SOURCES, Store


def watch(store: Store, folder: str, as_of: date | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Import each new file of ``folder``/<source>/ once (by name through the checkpoint, by content through the
    store) and reconcile after every batch; stops when what is there is done."""

    def load(batch: DataFrame, _: int) -> None:
        files = batch.select("path").orderBy("path").collect()  # names of one batch, bounded by maxFilesPerTrigger
        for row in files:
            source = row.path.rsplit("/", 2)[-2]
            if source in SOURCES:
                store.import_file(source, row.path)
        if files:
            store.reconcile(as_of)

    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = store.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100)
    names = files.load(folder).select("path", F.col("length"))
    return names.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint or f"{store.root}/_landing").trigger(availableNow=True).start()
