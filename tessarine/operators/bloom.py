"""Bloom filters as tables of words, built and probed by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.functions.text import bloom_positions, bloom_shape

#: Words of a filter that are broadcast at most.
SHIP_WORDS = 2_000_000


def build(digests: DataFrame, entries: int, rate: float, column: str = "sha256") -> DataFrame:
    """(word, bits): the 64-bit words with a set bit of a filter for so many digests(sha256)."""
    bits, hashes = bloom_shape(entries, rate)
    at = digests.where(F.col(column).isNotNull()).select(F.explode(bloom_positions(F.col(column), bits, hashes)).alias("at"))
    return at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))


def might_contain(rows: DataFrame, words: DataFrame, entries: int, rate: float, column: str = "sha256") -> DataFrame:
    """(sha256, known) of the distinct digests of rows: False means that the digest was never added."""
    bits, hashes = bloom_shape(entries, rate)
    asked = rows.where(F.col(column).isNotNull()).select(column).distinct()
    at = asked.withColumn("at", F.explode(bloom_positions(F.col(column), bits, hashes))).withColumn("word", F.expr("at div 64"))
    # the number of words is bounded by the shape
    table = F.broadcast(words) if bits // 64 <= SHIP_WORDS else words
    hit = F.coalesce(F.expr("bits & shiftleft(1L, cast(at % 64 as int)) <> 0"), F.lit(False))
    return at.join(table, "word", "left").groupBy(column).agg(F.min(hit).alias("known"))
