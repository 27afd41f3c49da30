"""Mixing sources to target weights by systematic sampling.

Each source gets the share ``weight / sum of weights`` of ``budget`` times the corpus
(in characters), so every document of a source s is expected

    e = budget * total characters * weight_s / (sum of weights * characters of s)

times. Inside a source the documents stand in a fixed order, S is the running sum of
their e, U one offset in [0, 1) for the source, and a document is emitted once for
each integer that lies in (S - e + U, S + U]. The number of copies of a source is thus
within one of its expectation. All documents of a source have the same e, so S is their
number times a fraction of whole numbers, and every boundary is exact.

The order inside a source is (doc_id modulo ``blocks``, doc_id, n_chars, a hash of the text if
there is one). Running counts need no task that holds a whole source, and no text: rows are
counted by these columns, blocks are summed first, and each block starts from its
predecessor's count. There are 1024 blocks, or as many times 2 as it takes for a million rows
each on average. Whole rows meet the narrow result in a join, by broadcast while it is small.

Defined results: a document without characters (n_chars NULL or not above 0) is
expected 0 times and never emitted. A NULL source is a source of its own; a NULL doc_id
stands first in block 0. Repeated rows count one by one, those with equal doc_id, n_chars and
text in no order. A source without a weight in ``weights`` has weight 0; a weight below 0 is a
ValueError. If all weights are 0 nothing is emitted. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessarine.llm import _run

UNIT = 1_000_000


#: Rows of a block, on average.
BLOCK_ROWS = 1_000_000


def mix(
    docs: DataFrame,
    weights: dict[str | None, int] | None = None,
    budget_millionths: int = UNIT,
    seed: int = 17,
    blocks: int | None = None,
    copy: str = "copy",
) -> DataFrame:
    """docs, each row as often as it is emitted, with ``copy`` (1, 2, ..) appended.

    weights: whole numbers by source; None gives all sources the same.
    """
    if budget_millionths < 0 or any(w < 0 for w in (weights or {}).values()):
        raise ValueError("budget and weights can't be below 0")
    [number] = _run.fresh(docs, copy)
    own = _run.fresh(docs, "_key", "_id", "_some", "_chars", "_text")
    key, doc, some, chars, text = own
    big, shared = "decimal(38,0)", math.gcd(budget_millionths, UNIT)
    keyed = docs.withColumns(
        {
            key: F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
            doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            some: F.col("doc_id").isNotNull(),
            chars: F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(0)),
            text: F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long"),
        }
    )
    counted = keyed.where(F.col(chars) > 0).groupBy(*(F.col(c).alias(n) for c, n in zip(own, ("key", "id", "some", "chars", "text"), strict=True)))
    narrow = _run.written(counted.agg(F.count("*").alias("rows")))
    if blocks is None:
        blocks, n = 1024, narrow.count()
        while n > blocks * BLOCK_ROWS:
            blocks *= 2
    narrow = narrow.withColumn("block", F.pmod("id", F.lit(blocks)).cast("int"))
    by_block = narrow.groupBy("key", "block").agg(F.sum(F.col("chars").cast(big) * F.col("rows")).alias("block_chars"), F.sum("rows").alias("n"))
    if weights is None:
        weight = F.lit(1)
    else:
        weight = F.lit(0)
        for name, value in weights.items():
            weight = F.when(F.col("key") == ("n" if name is None else f"s{name}"), value).otherwise(weight)
    by_source = by_block.groupBy("key").agg(F.sum("block_chars").alias("source_chars")).withColumn("weight", weight)
    whole = by_source.agg(F.sum("source_chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    # one row, whatever the size of the corpus
    rates = by_source.crossJoin(F.broadcast(whole)).where("all_weight > 0 AND weight > 0").select(
        "key",
        F.expr(f"cast(cast(cast(all_chars as {big}) * weight as {big}) * {budget_millionths // shared} as {big})").alias("up"),
        F.expr(f"cast(cast(cast(all_weight as {big}) * source_chars as {big}) * {UNIT // shared} as {big})").alias("down"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("long") % UNIT).alias("offset"),
    )
    order = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_block.join(rates, "key").select("key", "block", "up", "down", "offset", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "block").orderBy("some", "id", "chars", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = narrow.join(starts, ["key", "block"]).withColumn("last", F.col("before") + F.sum("rows").over(inside))

    def boundary(count: str, of: str = "") -> str:
        """Integer boundaries that a running count has crossed."""
        return f"(cast(cast({count} as {big}) * {of}up * {UNIT} as {big}) + cast({of}offset as {big}) * {of}down) div cast({of}down * {UNIT} as {big})"

    placed = placed.withColumn("copies", F.expr(f"{boundary('last')} - {boundary('last - rows')}")).where("copies > 0")
    at, rank = _run.fresh(keyed, "_at", "_rank")
    result = F.struct("rows", "copies", "last", "up", "down", "offset").alias(at)
    placed = _run.written(placed.select(*(F.col(n).alias(c) for c, n in zip(own, ("key", "id", "some", "chars", "text"), strict=True)), result))

    def emitted(found: DataFrame, copies: str) -> DataFrame:
        return found.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.expr(copies).cast("int"))).alias(number))

    once = emitted(_run.join_small(keyed, placed.where(f"{at}.rows = 1"), own, row_bytes=160), f"{at}.copies")
    repeated = placed.where(f"{at}.rows > 1")
    if repeated.isEmpty():
        return once
    again = _run.join_small(keyed, repeated, own, row_bytes=160).withColumn(rank, F.row_number().over(Window.partitionBy(*own).orderBy(text)))
    place = f"({at}.last - {at}.rows + {rank})"
    copies = f"{boundary(place, at + '.')} - {boundary(place + ' - 1', at + '.')}"
    return once.unionByName(emitted(again.where(f"{copies} > 0"), copies))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    return mix(docs)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: whole rows, with the number of the copy."""
    return mix(docs)


SQL = """
WITH d AS (
  SELECT doc_id, source, n_chars, coalesce('s' || source, 'n') AS k,
         ((coalesce(doc_id, 0) % 1024) + 1024) % 1024 AS block,
         greatest(coalesce(n_chars, 0), 0) AS chars
  FROM documents),
s AS (SELECT k, sum(chars)::HUGEINT AS source_chars FROM d GROUP BY k HAVING sum(chars) > 0),
r AS (
  SELECT k, (SELECT sum(source_chars)::HUGEINT FROM s) AS up, (SELECT count(*) FROM s) * source_chars AS down,
         ('0x' || substr(md5('17:' || k), 1, 8))::BIGINT % 1000000 AS u
  FROM s),
p AS (
  SELECT d.*, up, down, u, row_number() OVER (PARTITION BY k ORDER BY block, doc_id NULLS FIRST, n_chars NULLS FIRST) AS n
  FROM d JOIN r USING (k) WHERE chars > 0),
c AS (
  SELECT doc_id, source, n_chars,
         ((n::HUGEINT * up * 1000000 + u * down) // (down * 1000000) - ((n - 1)::HUGEINT * up * 1000000 + u * down) // (down * 1000000))::BIGINT AS copies
  FROM p)
SELECT doc_id, source, n_chars, unnest(range(1, copies + 1))::INTEGER AS copy FROM c WHERE copies > 0
"""
