"""Symbol lookup and references: the processing of hits that a provider or the token table gives."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessarine.functions.globs import selected

_WORD = "[A-Za-z0-9_]"


def quoted(name: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", name)


def whole_word(name: str) -> str:
    """The name where no letter, digit or underscore stands next to its ends, as \\b would have it."""
    left = f"(?<!{_WORD})" if re.match(_WORD, name) else f"(?<={_WORD})"
    right = f"(?!{_WORD})" if re.match(_WORD, name[-1:]) else f"(?={_WORD})"
    return left + quoted(name) + right


def symbol_hits(symbols: DataFrame, query: str) -> DataFrame:
    """symbols(path, name, start_line, start_column, ..) whose name has the characters of a part of the query in order, once for each part."""
    found = None
    for k, part in enumerate(query.split()):
        pattern = "(?is)" + ".*".join(quoted(c) for c in part)
        own = symbols.where(F.col("name").rlike(pattern)).withColumn("part", F.lit(k))
        found = own if found is None else found.unionByName(own)
    return found if found is not None else symbols.where("false").withColumn("part", F.lit(0))


def distinct_symbols(hits: DataFrame) -> DataFrame:
    """The first hit of each name, path and position."""
    order = Window.partitionBy("name", "path", "start_line", "start_column").orderBy("part")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def clean_symbols(hits: DataFrame, unwanted: tuple = ("mojom", r"\.md$", "win_toolchain")) -> DataFrame:
    """Without unsaved files and paths that match a pattern: generated bindings, Markdown, the toolchain's own headers."""
    return hits.where(~(F.col("path").startswith("untitled:") | F.col("path").rlike("|".join(unwanted))))


def ranked_symbols(hits: DataFrame, query: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """hits with ``tier``: 0 a name that a part of the query equals, 1 that contains one, 2 others; without regard to case."""
    parts = [p.lower() for p in query.split()]
    name = F.lower("name")
    inside = F.lit(False)
    for p in parts:
        inside = inside | name.contains(p)
    tier = F.when(name.isin(*parts), 0).when(inside, 1).otherwise(2) if parts else F.lit(2)
    chosen = hits.where(selected(F.col("path"), include, exclude, nocase=False)) if include or exclude else hits
    return chosen.withColumn("tier", tier)


def occurrences(lines: DataFrame, name: str, key: str = "path") -> DataFrame:
    """(key, line, column) of whole-word occurrences of a name in lines(key, line, line_text)."""
    pattern = whole_word(name)
    parts = F.split("line_text", pattern, -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.length(F.array_join(F.slice(parts, 1, k), "")) + (k - 1) * len(name))
    found = lines.where(F.col("line_text").contains(name) & F.col("line_text").rlike(pattern))
    return found.select(key, "line", F.explode(ends).alias("column"))


def verified(refs: DataFrame, lines: DataFrame, name: str, key: str = "path") -> DataFrame:
    """refs(key, line, column, ..) that still have the name as a whole word at that place."""
    placed = refs.join(lines.select(key, "line", "line_text"), [key, "line"])
    left = F.when(F.col("column") > 0, F.substring("line_text", F.col("column"), F.lit(1))).otherwise("")
    rest = F.substring("line_text", F.col("column") + 1, F.lit(1 << 30))
    word_first, word_last = bool(re.match(_WORD, name)), bool(re.match(_WORD, name[-1:]))
    before = left.rlike(f"^{_WORD}$")
    after = F.substring(rest, len(name) + 1, 1).rlike(f"^{_WORD}$")
    ok = rest.startswith(name) & (before != F.lit(word_first)) & (after != F.lit(word_last))
    return placed.where((F.col("column") >= 0) & (F.col("column") < F.length("line_text")) & ok).select(*refs.columns)


def resolve_position(lines: DataFrame, requests: DataFrame, key: str = "path") -> DataFrame:
    """requests(request, key, line, column, name, source_line) with found_line and found_column, NULL where nothing fits.

    Of the lines within 5 of the given one whose trimmed text is the source line, the nearest
    counts, the one above first; on it the occurrence of the name that holds the column, else
    the nearest one.
    """
    from tessarine.functions.text import trim

    near = lines.select(F.col(key).alias("_k"), F.col("line").alias("_line"), "line_text")
    joined = requests.join(near, (F.col(key) == F.col("_k")) & F.abs(F.col("_line") - F.col("line")).between(0, 5) & (trim(F.col("line_text")) == trim(F.col("source_line"))), "left")
    rank = F.struct(F.abs(F.col("_line") - F.col("line")).alias("d"), F.col("_line").alias("l"), F.col("line_text").alias("t"))
    best = joined.groupBy(*requests.columns).agg(F.min(F.when(F.col("_line").isNotNull(), rank)).alias("b"))

    def places(texts: pa.Array, names: pa.Array, columns: pa.Array) -> pa.Array:
        out = []
        for text, name, column in zip(texts.to_pylist(), names.to_pylist(), columns.to_pylist(), strict=True):
            at = [m.start() for m in re.finditer(rf"\b{re.escape(name)}\b", text, re.A)] if text is not None and name else []
            inside = [a for a in at if a <= column < a + len(name)]
            out.append(inside[0] if inside else min(at, key=lambda a: abs(a - column)) if at else None)
        return pa.array(out, pa.int32())

    column = F.arrow_udf(places, "int")(F.col("b.t"), F.col("name"), F.col("column").cast("int"))
    found = best.withColumn("found_column", column)
    return found.select(*requests.columns, F.when(F.col("found_column").isNotNull(), F.col("b.l")).alias("found_line"), "found_column")


def comment_above(files: DataFrame, points: DataFrame, key: str = "path") -> DataFrame:
    """points(key, line) with comment_start and comment_end (lines from 0) of the comment right above, NULL without one."""

    def walk(lines: list[str], line: int):
        first = last = None
        block = False
        for k in range(line - 1, -1, -1):
            bare = lines[k].strip()
            if not bare:
                if k != line - 1 and block:
                    continue
                break
            if bare.startswith("//"):
                pass
            elif not block and bare.endswith("*/"):
                if not bare.startswith("/*"):
                    if "/*" in bare:
                        break
                    block = True
            elif block:
                if "/*" not in bare:
                    continue
                block = False
            else:
                break
            last = k if last is None else last
            first = k
        return None if first is None else {"a": first, "b": last}

    def found(texts: pa.Array, lines: pa.Array) -> pa.Array:
        both = zip(texts.to_pylist(), lines.to_pylist(), strict=True)
        return pa.array([None if t is None else walk(t.split("\n"), n) for t, n in both], pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    placed = points.join(files.select(key, "text"), key)
    placed = placed.withColumn("_c", F.arrow_udf(found, "struct<a: int, b: int>")("text", F.col("line").cast("int")))
    return placed.select(*points.columns, F.col("_c.a").alias("comment_start"), F.col("_c.b").alias("comment_end"))


def delimited(line: str, column: int) -> str | None:
    """The shortest text around a column that quotes, brackets or backticks enclose."""
    best = None
    for opened, closed in ("\"\"", "''", "``", "()", "[]"):
        start = next((k + 1 for k in range(column - 1, -1, -1) if line[k] in (opened, closed)), None)
        if start is None or line[start - 1] != opened:
            continue
        end = next((k for k in range(column, len(line)) if line[k] in (opened, closed)), None)
        if end is not None and line[end] == closed and (best is None or end - start < len(best)):
            best = line[start:end]
    return best


def qualified_from_tree(symbols: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, start_line, end_line, qualified): names of the enclosing namespaces, classes, structs and enums, outermost first."""
    outer = symbols.where(F.col("type").isin(1, 2, 3, 5)).select(F.col(key).alias("_k"), F.col("name").alias("_n"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    own = symbols.select(key, "name", "start_line", "end_line").distinct()
    wider = (F.col("_a") <= F.col("start_line")) & (F.col("_b") >= F.col("end_line")) & ((F.col("_b") - F.col("_a")) > (F.col("end_line") - F.col("start_line")))
    joined = own.join(outer, (F.col(key) == F.col("_k")) & wider, "left")
    chain = F.sort_array(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct((F.col("_a") - F.col("_b")).alias("w"), F.col("_a").alias("a"), F.col("_n").alias("n")))))
    grouped = joined.groupBy(key, "name", "start_line", "end_line").agg(chain.alias("c"))
    return grouped.select(key, "name", "start_line", "end_line", F.array_join(F.concat(F.transform("c", lambda x: x["n"]), F.array("name")), "::").alias("qualified"))
