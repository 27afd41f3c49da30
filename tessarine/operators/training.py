"""Training samples: candidates for negatives, their selection and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessarine.functions.text import group_key, trim

MAX_SPAN = 400


def file_groups(files: DataFrame, path: str = "path") -> DataFrame:
    """(group_key, paths): files that share directory and name up to the extension."""
    return files.groupBy(group_key(F.col(path)).alias("group_key")).agg(F.array_sort(F.collect_set(path)).alias("paths"))


def valid_samples(samples: DataFrame, sizes: DataFrame) -> DataFrame:
    """samples(query, query_type, path, start_line, end_line) that name a known file and a range of it of at most MAX_SPAN lines.

    sizes(path, line_count)
    """
    whole = (F.coalesce(F.col("query"), F.lit("")) != "") & (F.coalesce(F.col("query_type"), F.lit("")) != "")
    fits = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.col("line_count"))
    span = F.col("end_line") - F.col("start_line") + 1 <= MAX_SPAN
    return samples.join(sizes, "path").where(whole & fits & span).select(*samples.columns)


def with_text(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Samples with ``positive_text``; those whose lines are blank drop out."""
    cut = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return samples.join(files.select("path", "text"), "path").select(*samples.columns, cut.alias("positive_text")).where(trim(F.col("positive_text")) != "")


def outside_positive(candidates: DataFrame) -> DataFrame:
    """Candidates that share no line with the sample's positive.

    candidates(.., path, start_line, end_line, positive_path, positive_start, positive_end)
    """
    other = (F.col("path") != F.col("positive_path")) | (F.col("end_line") < F.col("positive_start")) | (F.col("start_line") > F.col("positive_end"))
    return candidates.where(other)


def first_ranked(candidates: DataFrame, sample: str, order: list, n: int) -> DataFrame:
    """The first n candidates of each sample."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(sample).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def rank_window(ranked: DataFrame, low: int, high: int) -> DataFrame:
    """Candidates whose rank, from 1, lies in low .. high."""
    return ranked.where(F.col("rank").between(low, high))


def sampled(rows: DataFrame, by: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows of each group, uniformly and without replacement: those with the smallest seeded hash of their keys."""
    salted = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in [by, *keys])))
    return first_ranked(rows, by, [salted, *keys], n)


def easy_negatives(ranked: DataFrame, low: int, high: int, n: int, seed: int = 0) -> DataFrame:
    """ranked(sample, positive_path, path, start_line, end_line, rank): n random candidates of the rank window from other file groups."""
    other = rank_window(ranked, low, high).where(group_key(F.col("path")) != group_key(F.col("positive_path")))
    return sampled(other, "sample", ["path", "start_line", "end_line"], n, seed)


def verify(negatives: DataFrame, results: DataFrame) -> DataFrame:
    """negatives(sample, path, start_line, end_line) with rank and score among the sample's current results, NULL where they miss.

    results(sample, path, start_line, end_line, score)
    """
    order = Window.partitionBy("sample").orderBy(F.desc("score"), "path", "start_line", "end_line")
    ranked = results.withColumn("rank", F.row_number().over(order))
    return negatives.join(ranked, ["sample", "path", "start_line", "end_line"], "left")


def verification_totals(verified: DataFrame) -> DataFrame:
    """(negatives, mismatches): a negative that the results no longer have is a mismatch."""
    return verified.agg(F.count("*").alias("negatives"), F.count(F.when(F.col("rank").isNull(), 1)).alias("mismatches"))
