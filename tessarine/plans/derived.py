"""Inputs of the registered queries, derived from the driver's tables, and the same in SQL.

The tables hold prose, no source code. Documents serve as files, and every line of a document
as a symbol whose type follows from its number and whose extent from its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.sources.files import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CTES = {
    "f": "f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, text FROM documents)",
    "l": (
        "l AS (SELECT doc_id, path, len(string_split(text, chr(10)))::INTEGER AS line_count, unnest(string_split(text, chr(10))) AS line_text, "
        "unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line FROM f)"
    ),
    "s": (
        "s AS (SELECT path, line_count, line AS start_line, least(line_count - 1, line + length(line_text) % 11)::INTEGER AS end_line, "
        "[1, 2, 20, 21, 40, 60, 24][1 + line % 7]::INTEGER AS type, "
        "coalesce(nullif(regexp_extract(line_text, '[A-Za-z]+'), ''), 'anon') AS name, "
        "path || '::' || coalesce(nullif(regexp_extract(line_text, '[A-Za-z]+'), ''), 'anon') AS fqn FROM l)"
    ),
    "p": "p AS (SELECT DISTINCT path, line, line_count FROM l)",
    "v": "v AS (SELECT vec_id AS vector_id, embedding, label FROM embeddings)",
    "c": (
        "c AS (SELECT vec_id AS chunk_id, vec_id AS vector_id, vec_id % 97 AS file_id, (vec_id * 7 % 50 + 1)::INTEGER AS start_line, "
        "(vec_id * 7 % 50 + 1 + vec_id % 13)::INTEGER AS end_line, sha256(vec_id::VARCHAR) AS sha256 FROM embeddings)"
    ),
}


def sql(body: str, *needs: str) -> str:
    """SQL with the named inputs in front of it."""
    named = ",\n".join(CTES[n] for n in needs)
    return f"WITH {named}{', ' if body.lstrip().startswith(('+',)) else ' '}{body.lstrip().lstrip('+')}" if needs else body


def register(name: str, oracle: str | None = None, *needs: str):
    """Register a query, with the SQL that gives the same result."""

    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLE_SQL[name] = sql(oracle, *needs)
        return function

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, line_count, line, line_text)"""
    own = files(spark, sf_dir)
    rows = F.split("text", "\n")
    return own.select("doc_id", "path", F.size(rows).alias("line_count"), F.posexplode(rows).alias("line", "line_text"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir)
    name = F.coalesce(F.nullif(F.regexp_extract("line_text", "[A-Za-z]+", 0), F.lit("")), F.lit("anon"))
    return own.select(
        "path", "line_count", F.col("line").alias("start_line"), F.lit(0).alias("start_column"),
        F.least(F.col("line_count") - 1, F.col("line") + F.length("line_text") % 11).alias("end_line"),
        F.expr("array(1, 2, 20, 21, 40, 60, 24)[line % 7]").alias("type"), name.alias("name"),
        F.concat("path", F.lit("::"), name).alias("fully_qualified_name"), F.lit(None).cast("string").alias("signature"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, line_count) of every line."""
    return lines(spark, sf_dir).select("path", "line", "line_count").distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("vector_id"), "embedding", "label")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    start = F.col("vec_id") * 7 % 50 + 1
    return own.select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("vector_id"), (F.col("vec_id") % 97).alias("file_id"), start.cast("int").alias("start_line"),
        (start + F.col("vec_id") % 13).cast("int").alias("end_line"), F.sha2(F.col("vec_id").cast("string"), 256).alias("sha256"),
    )


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, file_path): three of the chunks' 97 file ids are unknown."""
    return spark.range(94).select(F.col("id").alias("file_id"), F.concat(F.lit("lib/f"), F.col("id").cast("string"), F.lit(".cc")).alias("file_path"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with the smallest id."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").limit(1).collect()
    return list(own[0]["embedding"]) if own else [0.0]
