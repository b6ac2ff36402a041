"""Continuous ingest: a landing folder as a stream of files, upserted by group.

Each micro-batch replaces the groups that it has. Its id is part of the version
that it writes, so a batch that runs again after a failure changes nothing, nor
computes its rows again. State is the file source's own checkpoint, whose
query id names the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scriptorium.sources.store import Collection

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def landing(spark: SparkSession, path: str, pattern: str = "*", files_a_batch: int = 1000) -> DataFrame:
    """New files of a folder as they arrive, contents included."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(path)


def upsert_stream(files: DataFrame, to_rows: Callable[[DataFrame], DataFrame], store: Collection, key: str, checkpoint: str, once: bool = True, compact_every: int = 0) -> StreamingQuery:
    """Write ``to_rows(files)`` to ``store``, replacing whole groups of ``key``; all that is there, or for ever.

    Small files are joined after every ``compact_every`` batches, if that is set.
    """

    def write(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        if not batch.isEmpty():
            store.replace_groups(to_rows(batch), key, batch=(stream, number))
        if compact_every and number % compact_every == compact_every - 1:
            store.compact(key=key)

    out = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start() if once else out.start()
