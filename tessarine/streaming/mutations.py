"""File changes as a stream.

A folder of change files is the queue. Each micro-batch is one drain: it takes all that
arrived, collapses it to the last action of each path, and hands dirty and deleted paths to
the maintenance step, which commits one version. Queries read the last committed version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessarine.operators.maintain import last_actions
from tessarine.schema import MUTATIONS

DEBOUNCE = "500 milliseconds"


def change_stream(spark: SparkSession, folder: str, schema=MUTATIONS, form: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """(path, action, seq) rows from files that appear in a folder."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def queue(changes: DataFrame, included: Callable[[Column], Column] | None = None) -> DataFrame:
    """Changes of paths that belong to the index; a delete always counts."""
    return changes if included is None else changes.where(included(F.col("path")) | (F.col("action") == "delete"))


def drain(
    changes: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, vanished: Callable[[DataFrame], DataFrame] | None = None, once: bool = True
) -> StreamingQuery:
    """Run ``apply(dirty, deleted, batch)`` for every micro-batch.

    ``vanished`` tells which of the dirty paths no longer have a source: they are deleted in the
    same cycle. Without ``once`` batches start DEBOUNCE apart at the least.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        last = last_actions(batch).persist()
        dirty, deleted = last.where("action <> 'delete'").select("path"), last.where("action = 'delete'").select("path")
        if vanished is not None:
            gone = vanished(dirty).select("path")
            dirty, deleted = dirty.join(gone, "path", "left_anti"), deleted.unionByName(gone)
        apply(dirty, deleted.distinct(), number)
        last.unpersist()

    writer = changes.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def quiet_periods(events: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """(start, end, path, action) of events(ts, path, action): bursts of a path that no longer pause ends, with their last action.

    With a watermark on ts this also runs on streams; a burst is emitted once it is over.
    """
    grouped = events.groupBy(F.session_window("ts", gap).alias("burst"), "path").agg(F.max_by("action", F.struct("ts", "seq")).alias("action"))
    return grouped.select(F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "path", "action")
