"""Index maintenance: content diffs, vector resolution, tombstones, integrity.

Tables are never changed in place. Every function takes the current relations and returns the
new ones; TableStore writes them as a new version and then moves the pointer to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessarine.sources.shared import shared_dir

DAY = 86_400


# --- mutations ---


def last_actions(mutations: DataFrame) -> DataFrame:
    """(path_key, path, action): the last action of each path, without regard to its case."""
    last = F.max_by(F.struct("path", "action"), "seq")
    return mutations.groupBy(F.lower("path").alias("path_key")).agg(last.alias("m")).select("path_key", "m.path", "m.action")


def reconcile(known: DataFrame, found: DataFrame, included) -> DataFrame:
    """(path, action) of known paths that a scan didn't find: dirty if they still belong to the index, else delete."""
    gone = known.join(found.select(F.lower("path").alias("_k")), F.lower(known["path"]) == F.col("_k"), "left_anti")
    return gone.select("path", F.when(included(F.col("path")), "dirty").otherwise("delete").alias("action"))


def stale(files: DataFrame, index: DataFrame) -> DataFrame:
    """files(path, sha256, scrubbed_sha256, version) whose index doesn't have the same three values."""
    return files.join(index, ["path", "sha256", "scrubbed_sha256", "version"], "left_anti")


def index_status(files: DataFrame, index: DataFrame) -> DataFrame:
    """(path, status): 0 unchanged, 1 to index, 2 the source is gone (sha256 NULL)."""
    same = index.select("path", "sha256", "scrubbed_sha256", "version", F.lit(True).alias("_same"))
    joined = files.join(same, ["path", "sha256", "scrubbed_sha256", "version"], "left")
    return joined.select("path", F.when(F.col("sha256").isNull(), 2).when(F.col("_same"), 0).otherwise(1).alias("status"))


def chunk_status(files: DataFrame, index: DataFrame, versions: DataFrame) -> DataFrame:
    """(path, status): 2 error where the source no longer is what was indexed, 0 where its stored version is the index's, else 1."""
    joined = files.select("path", F.col("sha256").alias("_now")).join(index.select("path", "sha256", "scrubbed_sha256"), "path")
    joined = joined.join(versions.select("path", F.col("sha256").alias("_stored")), "path", "left")
    changed = ~F.col("_now").eqNullSafe(F.col("sha256"))
    return joined.select("path", F.when(changed, 2).when(F.col("_stored") == F.col("scrubbed_sha256"), 0).otherwise(1).alias("status"))


# --- chunks ---


def chunk_diff(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(path, sha256, action, start_line, end_line): delete, embed or move, for chunks of files that were computed anew.

    Both sides have (path, sha256, start_line, end_line), a hash once in a file. Chunks that
    stayed where they were have no row.
    """
    old = stored.select("path", "sha256", F.col("start_line").alias("_a"), F.col("end_line").alias("_b"), F.lit(True).alias("_old"))
    own = new.select("path", "sha256", "start_line", "end_line", F.lit(True).alias("_new"))
    both = own.join(old, ["path", "sha256"], "full_outer")
    moved = (F.col("start_line") != F.col("_a")) | (F.col("end_line") != F.col("_b"))
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "embed").when(moved, "move")
    rows = both.select("path", "sha256", action.alias("action"), F.coalesce("start_line", "_a").alias("start_line"), F.coalesce("end_line", "_b").alias("end_line"))
    return rows.where("action IS NOT NULL")


def changed_files(diff: DataFrame) -> DataFrame:
    return diff.agg(F.countDistinct("path").alias("files"))


def resolve_vectors(wanted: DataFrame, tombstones: DataFrame, cache: DataFrame, embed=None, remote: DataFrame | None = None) -> DataFrame:
    """wanted(sha256, text, ..) with ``origin`` (deleted, remote, cache, model, failed), ``vector_id`` and ``embedding``.

    A tombstone gives its vector id; a remote or the local cache the vector; the rest goes to
    ``embed``, a function of (text column) -> vector column. What it leaves NULL has failed.
    """
    found = wanted.join(tombstones.select("sha256", "vector_id"), "sha256", "left")
    steps = [("remote", remote)] if remote is not None else []
    for name, table in [*steps, ("cache", cache)]:
        found = found.join(table.select("sha256", F.col("embedding").alias(f"_{name}")), "sha256", "left")
    known = [F.col(f"_{name}") for name, _ in [*steps, ("cache", cache)]]
    missing = F.col("vector_id").isNull()
    for column in known:
        missing = missing & column.isNull()
    model = F.when(missing, embed(F.when(missing, F.col("text")))) if embed else F.lit(None).cast("array<float>")
    found = found.withColumn("_model", model)
    origin = F.when(F.col("vector_id").isNotNull(), "deleted")
    for (name, _), column in zip([*steps, ("cache", cache)], known, strict=True):
        origin = origin.when(column.isNotNull(), name)
    origin = origin.when(F.col("_model").isNotNull(), "model").otherwise("failed")
    vector = F.when(F.col("vector_id").isNull(), F.coalesce(*known, "_model"))
    return found.select(*wanted.columns, origin.alias("origin"), "vector_id", vector.alias("embedding"))


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted(position, sha256) with the cached data or NULL, one row for each position."""
    return wanted.join(cache.select("sha256", "data"), "sha256", "left").select("position", "sha256", "data")


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new(sha256, data) in place of rows of the same hash; of repeated new rows one wins."""
    once = new.groupBy("sha256").agg(F.max("data").alias("data"))
    return cache.join(once, "sha256", "left_anti").select("sha256", "data").unionByName(once)


def with_ids(rows: DataFrame, start: int, order: list[str], into: str = "vector_id") -> DataFrame:
    """rows with consecutive ids from ``start`` on, in an order, without bringing all rows to one task.

    Rows are sorted into ranges; a range's first id follows from the counts of those before.
    """
    shared_dir(rows.sparkSession)
    # ranges are sampled, and both uses below must see the same ones
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each range
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    numbered = parts.withColumn("_row", inside).join(F.broadcast(starts), "_part")
    return numbered.select(*rows.columns, (F.lit(start) + F.col("_first") + F.col("_row") - 1).cast("long").alias(into))


def next_vector_id(vectors: DataFrame, deleted: DataFrame) -> DataFrame:
    """(next_id): one above the largest id of both tables, 1 if they are empty."""
    top = vectors.agg(F.max("vector_id").alias("a")).crossJoin(deleted.agg(F.max("vector_id").alias("b")))
    return top.select((F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))) + 1).alias("next_id"))


def delete_chunks(chunks: DataFrame, vectors: DataFrame, tombstones: DataFrame, deleted_vectors: DataFrame, gone: DataFrame, now: int):
    """(chunks, vectors, tombstones, deleted vectors) after gone(chunk_id) went.

    A tombstone that already has the hash keeps its vector and is touched; only new ones take
    their vector along.
    """
    dead = chunks.join(gone.select("chunk_id").distinct(), "chunk_id", "left_semi")
    kept = chunks.join(gone.select("chunk_id"), "chunk_id", "left_anti")
    first = dead.groupBy("sha256").agg(F.min("vector_id").alias("vector_id"))
    fresh = first.join(tombstones, "sha256", "left_anti").withColumn("touched_at", F.lit(now).cast("long"))
    touched = touch(tombstones, dead, now)
    moved = vectors.join(fresh.select("vector_id"), "vector_id", "left_semi")
    left = vectors.join(dead.select("vector_id"), "vector_id", "left_anti")
    return kept, left, touched.unionByName(fresh.select("sha256", "vector_id", "touched_at")), deleted_vectors.unionByName(moved)


def restore_vectors(vectors: DataFrame, tombstones: DataFrame, deleted_vectors: DataFrame, back: DataFrame):
    """(vectors, tombstones, deleted vectors) after back(vector_id) returned."""
    ids = back.select("vector_id").distinct()
    returned = deleted_vectors.join(ids, "vector_id", "left_semi")
    return (
        vectors.unionByName(returned),
        tombstones.join(ids, "vector_id", "left_anti").select(*tombstones.columns),
        deleted_vectors.join(ids, "vector_id", "left_anti").select(*deleted_vectors.columns),
    )


def touch(tombstones: DataFrame, used: DataFrame, now: int) -> DataFrame:
    """Tombstones with touched_at set where used has the hash."""
    marked = tombstones.join(used.select("sha256").distinct().withColumn("_used", F.lit(True)), "sha256", "left")
    return marked.select("sha256", "vector_id", F.when(F.col("_used"), F.lit(now)).otherwise(F.col("touched_at")).cast("long").alias("touched_at"))


def purge(tombstones: DataFrame, deleted_vectors: DataFrame, now: int, days: int = 30):
    """(tombstones, deleted vectors) without those last touched more than so many days ago."""
    old = tombstones.where(F.col("touched_at") < now - days * DAY)
    return tombstones.where(~(F.col("touched_at") < now - days * DAY) | F.col("touched_at").isNull()), deleted_vectors.join(old, "vector_id", "left_anti").select(
        *deleted_vectors.columns
    )


def delete_files(files: DataFrame, chunks: DataFrame, gone: DataFrame):
    """(files, chunk ids to delete) for gone(file_path); unknown paths are skipped."""
    dead = files.join(gone.select("file_path").distinct(), "file_path", "left_semi")
    return files.join(gone.select("file_path"), "file_path", "left_anti").select(*files.columns), chunks.join(dead.select("file_id"), "file_id", "left_semi").select("chunk_id")


def update(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with the columns of changes where it has the key; changes with an unknown key are skipped."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = table.join(new, key, "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def update_chunk_lines(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    return update(chunks, changes, "chunk_id", ["start_line", "end_line"])


def set_file_versions(files: DataFrame, changes: DataFrame) -> DataFrame:
    return update(files, changes, "file_path", ["sha256"])


# --- flushing ---


def flushes(batches: DataFrame, threshold: int = 300) -> DataFrame:
    """batches(run, batch, pending) with ``flushed``: what goes out behind each batch, 0 where work is still gathered.

    Pending work is gathered over the batches of a run, in their order, and goes out as soon as
    it is at least the threshold, and behind the run's last batch. A run is one task, read in
    order and never held.
    """
    import pyarrow as pa

    last = F.max("batch").over(Window.partitionBy("run"))

    def gathered(parts):
        run, held = None, 0
        for part in parts:
            out = []
            for own, pending, end in zip(*(part.column(c).to_pylist() for c in ("run", "pending", "end")), strict=True):
                held = (held if own == run else 0) + pending
                run = own
                out.append(held if held >= threshold or end else 0)
                held = 0 if out[-1] or end else held
            yield pa.RecordBatch.from_arrays([part.column("run"), part.column("batch"), part.column("pending"), pa.array(out, pa.int64())], names=["run", "batch", "pending", "flushed"])

    ordered = batches.select("run", F.col("batch").cast("long"), F.col("pending").cast("long")).withColumn("end", F.col("batch") == last)
    ordered = ordered.repartition("run").sortWithinPartitions("run", "batch")
    return ordered.mapInArrow(gathered, f"run {dict(batches.dtypes)['run']}, batch long, pending long, flushed long")


# --- integrity ---


def integrity_rows(files: DataFrame, chunks: DataFrame, vectors: DataFrame, tombstones: DataFrame, deleted_vectors: DataFrame) -> dict[str, DataFrame]:
    """The rows that five rules find fault with."""
    return {
        "orphan_vectors": vectors.join(chunks, "vector_id", "left_anti"),
        "orphan_files": files.join(chunks, "file_id", "left_anti"),
        "dangling_chunks": chunks.join(vectors, "vector_id", "left_anti"),
        "orphan_deleted_vectors": deleted_vectors.join(tombstones, "vector_id", "left_anti"),
        "dangling_deleted_chunks": tombstones.join(deleted_vectors, "vector_id", "left_anti"),
    }


def integrity(*tables: DataFrame) -> DataFrame:
    """(fault, n) for the five rules, in one row each."""
    found = None
    for name, rows in integrity_rows(*tables).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")
        found = one if found is None else found.unionAll(one)
    return found


def repaired(files: DataFrame, chunks: DataFrame, vectors: DataFrame, tombstones: DataFrame, deleted_vectors: DataFrame):
    """The five tables without the faulty rows, chunks and tombstones first."""
    chunks = chunks.join(vectors, "vector_id", "left_semi").select(*chunks.columns)
    tombstones = tombstones.join(deleted_vectors, "vector_id", "left_semi").select(*tombstones.columns)
    return (
        files.join(chunks, "file_id", "left_semi").select(*files.columns), chunks, vectors.join(chunks, "vector_id", "left_semi").select(*vectors.columns),
        tombstones, deleted_vectors.join(tombstones, "vector_id", "left_semi").select(*deleted_vectors.columns),
    )
