"""Joins and merges of line intervals inside files.

Joins keep the file as an equality key, so they hash or sort on it and only test intervals of
the same file; merges are gaps and islands over one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine.schema import CONTAINER


def containers(symbols: DataFrame, types=CONTAINER) -> DataFrame:
    return symbols.where(F.col("type").isin(*types))


#: Lines of one cell: points meet only symbols that reach into their cell, so long files cost no square of their length.
CELL = 256


def _innermost(points: DataFrame, symbols: DataFrame, condition: Column, key: str, columns: list[str]) -> DataFrame:
    """points with a struct ``symbol``: of the symbols that hold the line, the one with the smallest span, then the latest start."""
    cells = F.explode(F.sequence(F.floor(F.col("start_line") / CELL), F.floor(F.greatest("start_line", "end_line") / CELL)))
    own = symbols.select(F.col(key).alias("_k"), F.struct(*columns).alias("_s"), cells.alias("_c"))
    held = points.select(*points.columns, F.struct(*points.columns).alias("_row"))
    joined = held.join(own, (F.col(key) == F.col("_k")) & (F.floor(F.col("line") / CELL) == F.col("_c")) & condition, "left")
    span = F.struct((F.col("_s.end_line") - F.col("_s.start_line")).alias("span"), (-F.col("_s.start_line")).alias("start"), F.col("_s").alias("s"))
    best = joined.groupBy("_row").agg(F.min(F.when(F.col("_s").isNotNull(), span)).alias("best"))
    return best.select("_row.*", F.col("best.s").alias("symbol"))


def innermost_container(points: DataFrame, symbols: DataFrame, key: str = "path", columns: list[str] | None = None) -> DataFrame:
    """Distinct points(key, line, ..) with the innermost container that holds the line, NULL without one."""
    columns = columns or ["type", "name", "start_line", "end_line", "fully_qualified_name"]
    held = (F.col("_s.start_line") <= F.col("line")) & (F.col("line") <= F.col("_s.end_line"))
    return _innermost(points, containers(symbols), held, key, columns)


def qualified_name(points: DataFrame, symbols: DataFrame, key: str = "path") -> DataFrame:
    """Distinct points(key, name, line) with ``fqn``: of the innermost symbol of that name that holds the line, or the name."""
    held = (F.col("_s.start_line") <= F.col("line")) & (F.col("line") <= F.col("_s.end_line")) & (F.col("_s.name") == F.col("name"))
    found = _innermost(points, symbols, held, key, ["name", "start_line", "end_line", "fully_qualified_name"])
    return found.withColumn("fqn", F.coalesce("symbol.fully_qualified_name", "symbol.name", "name")).drop("symbol")


def context_bounds(points: DataFrame, symbols: DataFrame, key: str = "path", types=CONTAINER) -> DataFrame:
    """Distinct points(key, line, line_count) with min_line and max_line: as far as context reaches
    without leaving the innermost container or entering another one.

    The next start after a line and the last end before it come from one sorted pass each. Only
    where that last end belongs to a container that began outside of the line's own, so the two
    overlap in part, are all containers of the file looked at.
    """
    own = containers(symbols, types).select(F.col(key), "start_line", "end_line", "type")
    held = _innermost(points, own, (F.col("_s.start_line") <= F.col("line")) & (F.col("line") <= F.col("_s.end_line")), key, ["start_line", "end_line"])
    low, high = F.coalesce("symbol.start_line", F.lit(0)), F.coalesce("symbol.end_line", F.col("line_count") - 1)
    held = held.select(F.struct(*points.columns).alias("p"), F.col(key).alias("k"), F.col("line").alias("at"), low.alias("low"), high.alias("high"))
    ends = own.groupBy(F.col(key).alias("k"), F.col("end_line").alias("at")).agg(F.max("start_line").alias("s"))
    ends = ends.select("k", "at", F.struct(F.col("at").alias("end"), F.col("s").alias("start")).alias("before"))
    marked = held.unionByName(ends, allowMissingColumns=True).withColumn("kind", F.col("before").isNotNull().cast("int"))
    back = F.last("before", ignorenulls=True).over(Window.partitionBy("k").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("last", back).where("kind = 0").drop("before", "kind")
    starts = own.select(F.col(key).alias("k"), F.col("start_line").alias("at"), F.col("start_line").alias("after")).distinct()
    marked = marked.unionByName(starts, allowMissingColumns=True).withColumn("kind", F.col("after").isNotNull().cast("int"))
    ahead = F.last("after", ignorenulls=True).over(Window.partitionBy("k").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = marked.withColumn("next", ahead).where("kind = 0")
    ceiling = F.when(F.col("next") <= F.col("high"), F.least(F.col("high"), F.col("next") - 1)).otherwise(F.col("high"))
    found = found.withColumn("max_line", ceiling)
    crossed = (F.col("last.end") >= F.col("low")) & (F.col("last.start") < F.col("low"))
    plain = found.where(~F.coalesce(crossed, F.lit(False)))
    floor = F.when(F.col("last.end") >= F.col("low"), F.greatest(F.col("low"), F.col("last.end") + 1)).otherwise(F.col("low"))
    plain = plain.select("p.*", floor.alias("min_line"), "max_line")
    walls = own.select(F.col(key).alias("_k"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    inside = (F.col("k") == F.col("_k")) & (F.col("_a") >= F.col("low")) & (F.col("_b") < F.col("at"))
    slow = found.where(crossed).join(walls, inside, "left").groupBy("p", "low", "max_line").agg(F.max(F.col("_b") + 1).alias("wall"))
    return plain.unionByName(slow.select("p.*", F.greatest("low", F.coalesce("wall", "low")).alias("min_line"), "max_line"))


def merge(ranges: DataFrame, by: list[str], aggregates: list[Column], start: str = "start_line", end: str = "end_line", gap: int = 0) -> DataFrame:
    """Ranges (both ends inclusive) of each group merged where one begins at most ``gap`` lines after the furthest end before it.

    gap 0 merges overlaps, gap 1 adjacent ranges as well.
    """
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    # of equal ranges the one that begins an island comes first
    again = Window.partitionBy(*by).orderBy(start, end, F.desc("_new"))
    island = F.sum("_new").over(again.rowsBetween(Window.unboundedPreceding, 0))
    grouped = marked.withColumn("_island", island).groupBy(*by, "_island")
    return grouped.agg(F.min(start).alias(start), F.max(end).alias(end), *aggregates).drop("_island")


def merge_results(results: DataFrame, key: str = "path") -> DataFrame:
    """Search results of a file merged where they share a line, with their best score."""
    return merge(results, [key], [F.max("score").alias("score")])


def context_sections(windows: DataFrame, by: list[str]) -> DataFrame:
    """Context windows merged where they overlap or touch."""
    return merge(windows, by, [], gap=1)


def merge_references(groups: DataFrame, key: str = "path") -> DataFrame:
    """Windows of references, in the order of their start, merged while they overlap or touch and the container stays the same.

    groups(key, start_line, end_line, container_name, container_line, references)
    """
    order = Window.partitionBy(key).orderBy("start_line", "end_line", F.col("container_line").asc_nulls_first(), F.col("container_name").asc_nulls_first(), "ref")
    container = F.struct("container_name", "container_line")
    changed = ~F.coalesce(container.eqNullSafe(F.lag(container).over(order)), F.lit(False))
    rows = groups.withColumn("_run", F.sum(F.when(changed, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_run").orderBy("start_line", "end_line", "ref")
    reach = F.max("end_line").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("start_line") <= reach + 1, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        rows.groupBy(key, "_run", "_island")
        .agg(
            F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.first("container_name").alias("container_name"),
            F.first("container_line").alias("container_line"), F.count("*").alias("references"),
        )
        .drop("_run", "_island")
    )


def reference_labels(groups: DataFrame, key: str = "path") -> DataFrame:
    """Merged groups with ``label``: the numbers of their references in the file, ``3`` or ``3-5``, and ``total``, the file's references."""
    order = Window.partitionBy(key).orderBy("start_line", "end_line", F.col("container_line").asc_nulls_first(), F.col("container_name").asc_nulls_first())
    last = F.sum("references").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = groups.withColumns({"_last": last, "total": F.sum("references").over(Window.partitionBy(key))})
    span = F.concat((F.col("_last") - F.col("references") + 1).cast("string"), F.lit("-"), F.col("_last").cast("string"))
    return numbered.withColumn("label", F.when(F.col("references") == 1, F.col("_last").cast("string")).otherwise(span)).drop("_last")


def top_level(symbols: DataFrame, key: str = "path", keep: tuple = ("type", "name", "fully_qualified_name", "signature")) -> DataFrame:
    """Outermost ranges [start, end) of a file's symbols, with the columns of the one that begins it.

    A symbol that only overlaps the range before it extends that range.
    """
    order = Window.partitionBy(key).orderBy("start_line", "end_line", "name")
    reach = F.max(F.col("end_line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = symbols.withColumn("_new", F.when(F.col("start_line") >= F.coalesce(reach, F.lit(0)), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by(F.struct(*keep), F.struct("start_line", "end_line", "name"))
    grouped = rows.groupBy(key, "_island").agg(F.min("start_line").alias("start_line"), F.max(F.col("end_line") + 1).alias("end_line"), first.alias("_s"))
    return grouped.select(key, "start_line", "end_line", "_s.*")


def absorb_above(ranges: DataFrame, lines: DataFrame, key: str = "path") -> DataFrame:
    """Ranges [start, end) grown upwards over the lines without a blank one, at most to the end of the range before."""
    order = Window.partitionBy(key).orderBy("start_line")
    bounded = ranges.withColumn("_low", F.coalesce(F.lag("end_line").over(order), F.lit(0)))
    blanks = lines.where(F.trim("line_text") == "").groupBy(key).agg(F.sort_array(F.collect_list("line")).alias("_blank"))
    joined = bounded.join(blanks, key, "left")
    last = F.array_max(F.filter("_blank", lambda b: b < F.col("start_line")))
    return joined.withColumn("start_line", F.greatest("_low", F.coalesce(last + 1, F.lit(0)))).select(*ranges.columns)


def preamble_end(symbols: DataFrame, key: str = "path") -> DataFrame:
    """(key, preamble_end): the line after the last include, 0 without one."""
    return symbols.groupBy(key).agg((F.coalesce(F.max(F.when(F.col("type") == 40, F.col("end_line"))), F.lit(-1)) + 1).alias("preamble_end"))


def merge_comments(comments: DataFrame, key: str = "path") -> DataFrame:
    """Line comments (key, line, column) on consecutive lines at the same column as one range."""
    order = Window.partitionBy(key).orderBy("line", "column")
    follows = (F.col("line") == F.lag("line").over(order) + 1) & (F.col("column") == F.lag("column").over(order))
    rows = comments.withColumn("_new", F.when(follows, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = rows.groupBy(key, "_island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.first("column").alias("column"))
    return grouped.drop("_island")


def reference_windows(refs: DataFrame, symbols: DataFrame, before: int = 10, after: int = 10, key: str = "path") -> DataFrame:
    """Distinct refs(key, line, line_count, ..) with a context window and their innermost container.

    The window is cut to the container; lines lost that way are won back above, then below.
    A line that the file doesn't have keeps its own range.
    """
    found = innermost_container(refs, symbols, key)
    has = F.col("symbol").isNotNull()
    low = F.greatest(F.lit(0), F.col("line") - before)
    high = F.least(F.col("line_count") - 1, F.col("line") + after)
    low = F.when(has, F.greatest(low, F.col("symbol.start_line"))).otherwise(low)
    high = F.when(has, F.least(high, F.col("symbol.end_line"))).otherwise(high)
    found = found.withColumns({"_low": low, "_high": high})
    missing = F.lit(before + after) - (F.col("_high") - F.col("_low"))
    up = F.when(has & (missing > 0), F.least(F.col("_low") - F.col("symbol.start_line"), missing)).otherwise(0)
    down = F.when(has & (missing - up > 0), F.least(F.col("symbol.end_line") - F.col("_high"), missing - up)).otherwise(0)
    outside = F.col("line") >= F.col("line_count")
    return found.select(
        *refs.columns, F.when(outside, F.col("line")).otherwise(F.col("_low") - up).alias("start_line"), F.when(outside, F.col("line")).otherwise(F.col("_high") + down).alias("end_line"),
        F.when(~outside, F.col("symbol.name")).alias("container_name"), F.when(~outside, F.col("symbol.start_line")).alias("container_line"),
        F.when(~outside, F.coalesce("symbol.fully_qualified_name", "symbol.name")).alias("container_fqn"),
    )


def with_signature(windows: DataFrame) -> DataFrame:
    """Windows (start_line, end_line, sig_start, sig_end) grown over the signature where they share a line with it
    or begin at most 5 lines below it; ``show_signature`` says whether it stands apart.
    """
    near = (F.col("sig_start") <= F.col("end_line")) & (F.col("start_line") <= F.col("sig_end")) | (F.col("start_line") - F.col("sig_end")).between(0, 5)
    near = F.coalesce(near, F.lit(False))
    return windows.select(
        *(c for c in windows.columns if c not in ("start_line", "end_line")),
        F.when(near, F.least("start_line", "sig_start")).otherwise(F.col("start_line")).alias("start_line"),
        F.when(near, F.greatest("end_line", "sig_end")).otherwise(F.col("end_line")).alias("end_line"),
        (F.col("sig_start").isNotNull() & ~near).alias("show_signature"),
    )
