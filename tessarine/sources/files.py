"""Files, JSON lines and the documents they hold."""

from __future__ import annotations

import os
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.functions.globs import glob_regex, member, outermost
from tessarine.functions.text import ensure_md
from tessarine.schema import TRAINING

_SCHEMA = "path string, text string, size long, modified timestamp"


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """(path, text, size, modified) of the files below a directory; none, with a warning, if it isn't one.

    Paths are filtered before any content is read.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path) or not system.getFileStatus(path).isDirectory():
        warnings.warn(f"{root} is no directory", stacklevel=2)
        return spark.createDataFrame([], _SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    if extensions is not None:
        files = files.where(member(F.col("path"), extensions, [], list(exclude)))
    elif exclude:
        files = files.where(reduce(lambda a, b: a & b, (~F.col("path").rlike(glob_regex(g)) for g in exclude)))
    return files.select("path", F.expr("decode(content, 'UTF-8')").alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def scan_all(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """The files below several directories, each path once without regard to its case."""
    found = [scan(spark, r, extensions, exclude) for r in outermost(list(roots))]
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _SCHEMA)
    return every.withColumn("_k", F.lower("path")).dropDuplicates(["_k"]).drop("_k")


def training_files(spark: SparkSession, root: str, extensions: list[str], exclude: list[str]) -> DataFrame:
    """Files with one of the extensions whose path no exclude glob matches, without regard to case."""
    files = scan(spark, root)
    low = F.lower("path")
    keep = reduce(lambda a, b: a | b, (low.endswith(e.lower()) for e in extensions), F.lit(False))
    for g in exclude:
        keep = keep & ~F.col("path").rlike("(?iu)" + glob_regex(g))
    return files.where(keep)


def read_jsonl(spark: SparkSession, path: str, schema=TRAINING) -> DataFrame:
    """All .jsonl files below a path; blank lines are skipped, a bad line is an error."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", "*.jsonl") if os.path.splitext(path)[1] != ".jsonl" else reader).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line. Null fields are written, so readers see every field."""
    df.write.option("ignoreNullFields", False).option("compression", "none").mode(mode).json(path)


def processed(outputs: DataFrame) -> DataFrame:
    """(output) of outputs(output, line) all of whose lines are JSON, at least one."""
    good = F.try_parse_json(F.col("line")).isNotNull()
    return outputs.where(F.trim("line") != "").groupBy("output").agg(F.min(good.cast("int")).alias("good")).where("good = 1").select("output")


def add_document(spark: SparkSession, folder: str, name: str, content: str) -> str:
    """Write a Markdown document; an error if it is there already. Its path is returned."""
    one = spark.range(1).select(ensure_md(F.lit(name)).alias("name")).first()["name"]
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder, one)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return path.toString()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text): the documents table as a corpus of files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))


def spread(files: DataFrame) -> DataFrame:
    """files over at least as many tasks as the session has cores: a small table often is one file and would keep one busy."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files if files._jdf.queryExecution().toRdd().getNumPartitions() >= cores else files.repartition(cores)
