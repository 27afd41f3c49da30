"""Shared helpers of the operators: sampling, model size checks, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.sources.shared import shared_dir

#: Largest model or lookup table, in bytes, that is shipped to every executor.
SHIP_BYTES = 64 << 20


#: Rows of one Arrow batch of texts. Ten thousand, Spark's default, can be a gigabyte of long ones.
TEXT_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to hand whole texts to Python in small batches."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def give_back() -> None:
    """Return what freed objects of a batch held to the system; idle workers would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder; its files outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessarine-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for file in df.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("tessarine-"):
                path.getFileSystem(conf).delete(path, True)
                break


def join_small(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", row_bytes: int = 64) -> DataFrame:
    """big joined with a narrow table on columns: broadcast if its rows fit in SHIP_BYTES, else with both sides shuffled."""
    return big.join(F.broadcast(small) if small.count() * row_bytes <= SHIP_BYTES else small, key, how)


def bounded(df: DataFrame, key: str, most: int, seed: int = 7) -> DataFrame:
    """About ``most`` rows of df, chosen by a hash of ``key``; all of them if there are no more.

    Only fitting a classifier on labelled rows goes through this.
    """
    n = df.count()
    if n <= most:
        return df
    parts = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(parts)) < int(parts * most / n))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have yet: the given ones, with underscores where they clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def per_worker(key: str, make):
    """``make()`` once for each Python worker process; later calls give the same object."""
    import sys

    kept = sys.__dict__.setdefault("_tessarine_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]
