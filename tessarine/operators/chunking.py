"""Symbols and chunks of files. Parsing is sequential inside a file and parallel over files; nothing is shuffled."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessarine.operators import parsers
from tessarine.schema import CHUNK, SYMBOL
from tessarine.sources.shared import small_batches

#: Bytes of text that are cut into chunks before these are handed back.
SLICE = 4 << 20


def _arrow(schema):
    kinds = {"integer": pa.int32(), "string": pa.string(), "long": pa.int64()}
    return pa.struct([(f.name, kinds[f.dataType.typeName()]) for f in schema.fields])


def symbols_of(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, symbol columns) of files(key, text); the parser follows from the path."""
    kind = pa.list_(_arrow(SYMBOL))

    def parsed(paths: pa.Array, texts: pa.Array) -> pa.Array:
        both = zip(paths.to_pylist(), texts.to_pylist(), strict=True)
        return pa.array([[] if t is None else parsers.parser_for(p or "").symbols(t) for p, t in both], kind)

    udf = F.arrow_udf(parsed, f"array<{SYMBOL.simpleString()}>")
    return files.select(key, F.explode(udf(key, "text")).alias("s")).select(key, "s.*")


def chunks_of(files: DataFrame, key: str = "path", plain: bool = False) -> DataFrame:
    """(key, start_line, end_line, text, sha256) of files(key, text), lines from 1, both ends inclusive.

    The hash is that of the chunk with its prefix. plain takes the default parser for all.
    """
    kind = to_arrow_type(files.schema[key].dataType)
    out = pa.schema([(key, kind), *((f.name, f.type) for f in _arrow(CHUNK))])

    def chunked(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            for a, b in _slices(sizes):
                keys, rows = batch.column(key).slice(a, b - a), ([], [], [], [], [])
                for k, (p, t) in enumerate(zip(keys.to_pylist(), batch.column("text").slice(a, b - a).to_pylist(), strict=True)):
                    if t is None:
                        continue
                    parser = parsers.DEFAULT if plain else parsers.parser_for("" if p is None else str(p))
                    for start, end, x in parser.chunks(t.split("\n"), parser.symbols(t), None if p is None else str(p)):
                        if end > start:
                            digest = hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                            for column, value in zip(rows, (k, start + 1, end, x, digest), strict=True):
                                column.append(value)
                own = dict(zip(("start_line", "end_line", "text", "sha256"), rows[1:], strict=True))
                yield pa.RecordBatch.from_arrays([keys.cast(kind).take(pa.array(rows[0], pa.int64())), *(pa.array(own[f.name], f.type) for f in out if f.name in own)], schema=out)

    small_batches(files.sparkSession)
    schema = f"{key} {dict(files.dtypes)[key]}, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in CHUNK.fields)}"
    return files.select(key, "text").mapInArrow(chunked, schema)


def _slices(sizes):
    """(start, end) of runs of rows that have SLICE bytes together, or of one row of more."""
    start, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > SLICE:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def distinct_chunks(chunks: DataFrame, key: str = "path") -> DataFrame:
    """The first chunk of each hash in a file."""
    order = Window.partitionBy(key, "sha256").orderBy("start_line", "end_line")
    return chunks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


# --- headings as columns ---


def headings(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, level, name) of first- and second-level headings of lines(key, line, line_text) outside of code fences."""
    order = Window.partitionBy(key).orderBy("line")
    fence = F.col("line_text").rlike(r"^ {0,3}(```|~~~)")
    masked = lines.withColumn("_open", F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    pattern = r"^ {0,3}(#{1,2})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$"
    found = masked.where((F.col("_open") == 0) & ~fence & F.col("line_text").rlike(pattern))
    found = found.select(key, "line", F.length(F.regexp_extract("line_text", pattern, 1)).alias("level"), F.trim(F.regexp_extract("line_text", pattern, 2)).alias("name"))
    return found.where("name <> ''")


def sections(heads: DataFrame, lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, start_line, end_line, breadcrumb): sections [start, end) with a body.

    A section ends at the next heading of its level or above; a first-level one already at the
    next heading. Blank lines at its end don't belong to it.
    """
    order = Window.partitionBy(key).orderBy("line")
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    sizes = lines.groupBy(key).agg(
        (F.max("line") + 1).alias("_size"), F.sort_array(F.collect_list(F.when(F.trim("line_text") != "", F.col("line")))).alias("_full")
    )
    top = F.when(F.col("level") == 1, F.struct(F.col("line").alias("line"), F.col("name").alias("name")))
    rows = heads.withColumns(
        {
            "_next": F.lead("line").over(order),
            "_top": F.last(top, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_end": F.when(F.col("level") == 1, F.min(F.when(F.col("level") == 1, F.col("line"))).over(ahead)).otherwise(F.min("line").over(ahead)),
        }
    ).join(sizes, key)
    stop = F.coalesce("_end", "_size")
    last = F.array_max(F.filter("_full", lambda x: (x < stop) & (x >= F.col("line")))) + 1
    end = F.when((F.col("level") == 1) & (F.col("_next") < last), F.col("_next")).otherwise(last)
    rows = rows.withColumn("_stop", end)
    crumb = F.when((F.col("level") == 2) & F.col("_top").isNotNull(), F.concat("_top.name", F.lit(" > "), "name")).otherwise(F.col("name"))
    body = F.exists("_full", lambda x: (x > F.col("line")) & (x < F.col("_stop")))
    return rows.where(body).select(key, F.col("line").alias("start_line"), F.col("_stop").alias("end_line"), crumb.alias("breadcrumb"))


def overviews(symbols: DataFrame, key: str = "path") -> DataFrame:
    """(key, overview_start, overview_end) of knowledge-base files: Markdown with a heading ``Overview`` among the first two symbols."""
    order = Window.partitionBy(key).orderBy("start_line", F.col("end_line") - F.col("start_line"), "name")
    first = symbols.where(F.col(key).endswith(".md")).withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    named = first.where(F.col("type").isin(80, 81) & (F.col("name") == "Overview"))
    best = F.min_by(F.struct((F.col("start_line") + 1).alias("a"), F.col("end_line").alias("b")), "_n")
    return named.groupBy(key).agg(best.alias("o")).select(key, F.col("o.a").alias("overview_start"), F.col("o.b").alias("overview_end"))
