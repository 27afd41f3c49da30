"""Registered queries over what is written and read back: the stored index, JSON lines, Bloom filters, flushes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessarine.operators import bloom, maintain
from tessarine.plans import indexing
from tessarine.plans.derived import files, register
from tessarine.sources.files import read_jsonl, write_jsonl
from tessarine.sources.shared import shared_dir


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tessarine-{name}-{uuid.uuid4().hex}"


@register(
    "q6_snk2_src8_stored_files",
    "SELECT path AS file_path, sha256(CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE text END) AS sha256 FROM f WHERE doc_id % 7 <> 0",
    "f",
)
def stored_files(spark, sf_dir):
    """Two maintenance cycles: all files, then a third of them changed and a seventh deleted."""
    own = files(spark, sf_dir).select("doc_id", "path", "text")
    store = indexing.open_store(spark, _folder(spark, "index"))
    embed = lambda text: F.when(text.isNotNull(), F.array(F.length(text).cast("float")))
    none = spark.createDataFrame([], "path string")
    indexing.refresh(store, own.select("path", "text"), none, embed, 1)
    changed = own.where("doc_id % 3 = 0 AND doc_id % 7 <> 0").select("path", F.concat("text", F.lit(" more")).alias("text"))
    indexing.refresh(store, changed, own.where("doc_id % 7 = 0").select("path"), embed, 2)
    return store.read("files").select("file_path", "sha256")


@register("src4_src5_snk13_json_lines", "SELECT doc_id, lang, source, n_chars, sha256(text) AS sha256 FROM documents")
def json_lines(spark, sf_dir):
    """The documents written as JSON lines and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    path = _folder(spark, "jsonl")
    # the files' names end in .json, which a reader of .jsonl files passes over
    write_jsonl(docs, f"{path}/all.jsonl")
    back = read_jsonl(spark, f"{path}/all.jsonl", docs.schema)
    return back.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha256"))


_POSITIONS = "list_transform(range(10), lambda i: (('0x' || substr(h, 1, 8))::BIGINT + i * ('0x' || substr(h, 9, 8))::BIGINT) % 143776)"


@register(
    "pred25_bloom_membership",
    f"""+h AS (SELECT DISTINCT sha256(text) AS h, sha256(text) < '8' AS own FROM f), p AS (SELECT h, own, unnest({_POSITIONS}) AS bit FROM h),
    b AS (SELECT DISTINCT bit FROM p WHERE own) SELECT h AS sha256, bool_and(b.bit IS NOT NULL) AS known FROM p LEFT JOIN b USING (bit) GROUP BY h""",
    "f",
)
def bloom_membership(spark, sf_dir):
    """All digests asked of a filter that holds those below 8."""
    own = files(spark, sf_dir).select(F.sha2("text", 256).alias("sha256"))
    words = bloom.build(own.where("sha256 < '8'").distinct(), 10_000, 0.001)
    return bloom.might_contain(own, words, 10_000, 0.001)


@register(
    "win8_flushes",
    """+n AS (SELECT source AS run, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS batch, len(string_split(text, chr(10))) AS k FROM documents),
    b AS (SELECT run, batch, sum(k)::BIGINT AS pending, max(batch) OVER (PARTITION BY run) AS last FROM n GROUP BY run, batch),
    r AS (SELECT run, batch, pending, last, pending AS held FROM b WHERE batch = 0
      UNION ALL SELECT b.run, b.batch, b.pending, b.last, CASE WHEN r.held >= 300 THEN 0 ELSE r.held END + b.pending FROM r JOIN b ON b.run = r.run AND b.batch = r.batch + 1)
    SELECT run, batch, pending, CASE WHEN held >= 300 OR batch = last THEN held ELSE 0 END AS flushed FROM r""".replace("+n AS", "WITH RECURSIVE n AS"),
)
def flushes(spark, sf_dir):
    """Lines as work, in batches of 50 documents of a source, sent on by 300."""
    from pyspark.sql import Window

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    numbered = docs.select(F.col("source").alias("run"), F.floor(place / 50).alias("batch"), F.size(F.split("text", "\n")).alias("k"))
    return maintain.flushes(numbered.groupBy("run", "batch").agg(F.sum("k").alias("pending")))
