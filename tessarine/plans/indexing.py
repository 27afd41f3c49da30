"""One maintenance cycle: changed files in, the next version of all relations out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessarine import schema
from tessarine.operators import chunking, maintain
from tessarine.sources.store import TableStore

TABLES = {
    "files": schema.FILES,
    "chunks": schema.CHUNKS,
    "vectors": schema.VECTORS,
    "deleted_chunks": schema.DELETED_CHUNKS,
    "deleted_vectors": schema.VECTORS,
}


def open_store(spark: SparkSession, root: str) -> TableStore:
    return TableStore(spark, root, TABLES)


def refresh(store: TableStore, files: DataFrame, deleted: DataFrame, embed: Callable[[Column], Column], now: int) -> int:
    """Index files(path, text) that are new or changed, drop deleted(path), and commit; the new version is returned.

    Chunks that are gone become tombstones before new ones look for their vectors, so a chunk
    that moves between files in one cycle keeps its vector. A file some of whose chunks got no
    vector is committed with an empty hash and comes up again in the next cycle.
    """
    old_files, chunks, vectors, tombs, dead_vectors = (store.read(n) for n in TABLES)
    hashed = files.select(F.col("path").alias("file_path"), "text", F.sha2("text", 256).alias("sha256")).where("text IS NOT NULL")
    changed = hashed.join(old_files.select("file_path", "sha256"), ["file_path", "sha256"], "left_anti").persist()
    gone_files = deleted.select(F.col("path").alias("file_path")).join(changed.select("file_path"), "file_path", "left_anti")

    new = chunking.distinct_chunks(chunking.chunks_of(changed, "file_path"), "file_path").persist()
    named = chunks.join(old_files.select("file_id", "file_path"), "file_id")
    stored = named.join(changed.select("file_path"), "file_path", "left_semi")
    as_path = lambda df: df.select(F.col("file_path").alias("path"), "sha256", "start_line", "end_line")
    diff = maintain.chunk_diff(as_path(stored), as_path(new)).withColumnRenamed("path", "file_path")

    kept_files, dropped = maintain.delete_files(old_files, chunks, gone_files)
    ids = named.join(diff.where("action = 'delete'").select("file_path", "sha256"), ["file_path", "sha256"], "left_semi").select("chunk_id")
    chunks2, vectors2, tombs2, dead2 = maintain.delete_chunks(chunks, vectors, tombs, dead_vectors, ids.union(dropped), now)
    moved = named.select("file_path", "sha256", "chunk_id").join(diff.where("action = 'move'"), ["file_path", "sha256"])
    chunks2 = maintain.update_chunk_lines(chunks2, moved.select("chunk_id", "start_line", "end_line"))

    wanted = new.join(diff.where("action = 'embed'").select("file_path", "sha256"), ["file_path", "sha256"], "left_semi")
    texts = wanted.groupBy("sha256").agg(F.min("text").alias("text"))
    known = tombs2.join(dead2, "vector_id").select("sha256", "vector_id", "embedding")
    # a tombstone's vector goes back to the first chunk that asks for it; further ones copy it
    held = texts.join(known, "sha256", "left")
    held = held.withColumn("embedding", F.coalesce("embedding", embed(F.when(F.col("vector_id").isNull(), F.col("text")))))
    placed = wanted.drop("text").join(held.drop("text"), "sha256")
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("file_path")) == 1
    placed = placed.withColumn("restored", F.when(first, F.col("vector_id"))).where("embedding IS NOT NULL").drop("vector_id").checkpoint()

    next_vector = maintain.next_vector_id(vectors, dead_vectors).first()["next_id"]
    next_file = (old_files.agg(F.max("file_id")).first()[0] or 0) + 1
    next_chunk = (chunks.agg(F.max("chunk_id")).first()[0] or 0) + 1
    back = placed.where("restored IS NOT NULL").select(F.col("restored").alias("vector_id"))
    fresh = maintain.with_ids(placed.where("restored IS NULL").drop("restored"), next_vector, ["file_path", "start_line"])
    vectors3, tombs3, dead3 = maintain.restore_vectors(vectors2, tombs2, dead2, back)
    vectors3 = vectors3.unionByName(fresh.select("vector_id", "embedding"))

    added = maintain.with_ids(changed.select("file_path").join(kept_files.select("file_path"), "file_path", "left_anti"), next_file, ["file_path"], "file_id")
    every = kept_files.unionByName(added.withColumn("sha256", F.lit("")))
    missing = wanted.select("file_path", "sha256").join(placed.select("file_path", "sha256"), ["file_path", "sha256"], "left_anti")
    failed = missing.select("file_path").distinct().withColumn("_failed", F.lit(True))
    versions = changed.select("file_path", "sha256").join(failed, "file_path", "left").select("file_path", F.when(F.col("_failed"), "").otherwise(F.col("sha256")).alias("sha256"))
    every = maintain.set_file_versions(every, versions)

    rows = placed.where("restored IS NOT NULL").withColumnRenamed("restored", "vector_id").drop("embedding").unionByName(fresh.drop("embedding"))
    rows = rows.join(every.select("file_path", "file_id"), "file_path")
    rows = maintain.with_ids(rows, next_chunk, ["file_id", "start_line"], "chunk_id")
    version = store.commit(
        files=every, chunks=chunks2.unionByName(rows.select(*chunks2.columns)), vectors=vectors3, deleted_chunks=tombs3.select(*tombs.columns), deleted_vectors=dead3.select(*dead_vectors.columns)
    )
    changed.unpersist()
    new.unpersist()
    return version
