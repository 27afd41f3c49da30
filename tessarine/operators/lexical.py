"""Ranked lexical search.

Hits are counted inside each file's row, so finding them needs no shuffle. What is left of a
file afterwards, its hit lines, is small; it is exchanged once, and both the corpus
statistics and the scores read that exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine.functions import terms
from tessarine.functions.text import trim_end

K1, B, PROXIMITY = 1.2, 0.15, 0.5


def lines_of(files: DataFrame, text: str = "text") -> DataFrame:
    """files without their text, one row for each line (from 0) with its text."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(F.split(text, "\n")).alias("line", "line_text"))


def file_hits(files: DataFrame, patterns: list[str], key: str = "path") -> DataFrame:
    """(key, total_lines, m) of files(key, text) that match; m has (pattern_index, frequency, line_numbers) of each pattern with a hit.

    A file's lines stand next to each other in one task, so they are added up there and one row
    for each file is exchanged.
    """
    kind = "array<struct<pattern_index:int,frequency:bigint,line_numbers:array<int>>>"
    if not patterns:
        return files.where("false").select(key, F.lit(0).alias("total_lines"), F.array().cast(kind).alias("m"))
    some = F.lit(False)
    for p in patterns:
        some = some | F.col("text").rlike(p)
    rows = F.split("text", "\n")
    lines = files.where(some).select(key, F.size(rows).alias("total_lines"), F.posexplode(rows).alias("line", "line_text"))
    counted = lines.select(key, "total_lines", "line", *(F.regexp_count("line_text", F.lit(p)).cast("long").alias(f"n{k}") for k, p in enumerate(patterns)))
    hit = F.greatest(*(F.col(f"n{k}") for k in range(len(patterns))), F.lit(0))
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(len(patterns))]
    own = [F.collect_list(F.when(F.col(f"n{k}") > 0, F.col("line"))).alias(f"l{k}") for k in range(len(patterns))]
    grouped = counted.where(hit > 0).groupBy(key, "total_lines").agg(*sums, *own)
    m = F.array(*(F.struct(F.lit(k).alias("pattern_index"), F.col(f"n{k}").alias("frequency"), F.array_sort(f"l{k}").alias("line_numbers")) for k in range(len(patterns))))
    return grouped.select(key, "total_lines", F.filter(m, lambda x: x["frequency"] > 0).alias("m"))


def pattern_matches(found: DataFrame, key: str = "path") -> DataFrame:
    """(key, total_lines, pattern_index, frequency, line_numbers): one row for each file and pattern with a hit."""
    return found.select(key, "total_lines", F.explode("m").alias("x")).select(key, "total_lines", "x.*")


def _scores(per_file: DataFrame, stats: DataFrame, key: str, k1: float, b: float, proximity: float) -> DataFrame:
    """Scores from m and one row of statistics: idf by pattern index and avgdl."""
    both = per_file.crossJoin(F.broadcast(stats))
    weight = lambda x: F.col("idf")[x["pattern_index"]]
    length = 1 - b + b * F.col("total_lines") / F.col("avgdl")
    base = F.aggregate("m", F.lit(0.0), lambda s, x: s + weight(x) * x["frequency"] * (k1 + 1) / (x["frequency"] + k1 * length))
    sorted_lines = F.array_sort(F.flatten(F.transform("m", lambda x: F.array_distinct(x["line_numbers"]))))
    repeated = F.filter(sorted_lines, lambda n, i: (i > 0) & (n == F.get(sorted_lines, i - 1)))
    bonus = F.aggregate("m", F.lit(0.0), lambda s, x: s + weight(x) * F.size(F.array_intersect(x["line_numbers"], repeated)))
    return both.select(key, (base + proximity * bonus).alias("score"), "total_lines", F.array_distinct(sorted_lines).alias("line_numbers"))


def _idf(searched: Column, df: Column) -> Column:
    return F.log((searched - df + 0.5) / (df + 0.5) + 1)


def rank_files(found: DataFrame, n_patterns: int, total_files: int, key: str = "path", k1: float = K1, b: float = B, proximity: float = PROXIMITY) -> DataFrame:
    """(key, score, total_lines, line_numbers) of file_hits rows: BM25 over lines, with a bonus for lines that several patterns share.

    The document frequency counts files by pattern, the mean length is over the files that
    matched, and the number of files is all that were searched. Statistics and scores read the
    same exchange.
    """
    has = lambda k: F.exists("m", lambda x: (x["pattern_index"] == k) & (x["frequency"] > 0) & (F.size(x["line_numbers"]) > 0))
    stats = found.agg(F.array(*(_idf(F.lit(total_files), F.count(F.when(has(k), 1))) for k in range(n_patterns))).alias("idf"), F.avg("total_lines").alias("avgdl"))
    return _scores(found, stats, key, k1, b, proximity)


def rank_matches(
    matches: DataFrame, total_files: int | Column, key: str = "file_path", k1: float = K1, b: float = B, proximity: float = PROXIMITY
) -> DataFrame:
    """As rank_files, of pattern_matches rows, for any set of pattern indexes."""
    searched = total_files if isinstance(total_files, Column) else F.lit(total_files)
    rows = matches.repartition(key)
    per_file = rows.groupBy(key).agg(
        F.first("total_lines").alias("total_lines"), F.array_sort(F.collect_list(F.struct("pattern_index", "frequency", "line_numbers"))).alias("m")
    )
    # one entry for each pattern of the query
    idf = rows.groupBy("pattern_index").agg(_idf(searched, F.count("*")).alias("idf")).agg(F.map_from_entries(F.collect_list(F.struct("pattern_index", "idf"))).alias("idf"))
    return _scores(per_file, idf.crossJoin(F.broadcast(per_file.agg(F.avg("total_lines").alias("avgdl")))), key, k1, b, proximity)


def rank_lines(
    matches: DataFrame, total_files: int | Column, key: str = "file_path", k1: float = K1, b: float = B, proximity: float = PROXIMITY
) -> DataFrame:
    """As rank_matches, with the shared lines found by grouping: for files with very many hit lines."""
    searched = total_files if isinstance(total_files, Column) else F.lit(total_files)
    rows = matches.repartition(key)
    idf = rows.groupBy("pattern_index").agg(F.count("*").alias("df")).withColumn("idf", F.log((searched - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    lengths = rows.select(key, "total_lines").distinct().agg(F.avg("total_lines").alias("avgdl"))
    # statistics of the query's few patterns
    scored = rows.join(F.broadcast(idf), "pattern_index").crossJoin(F.broadcast(lengths))
    length = 1 - b + b * F.col("total_lines") / F.col("avgdl")
    base = scored.groupBy(key, "total_lines").agg(
        F.sum(F.col("idf") * F.col("frequency") * (k1 + 1) / (F.col("frequency") + k1 * length)).alias("base")
    )
    by_line = scored.select(key, "idf", F.explode(F.array_distinct("line_numbers")).alias("line")).groupBy(key, "line")
    by_line = by_line.agg(F.count("*").alias("n"), F.sum("idf").alias("idf"))
    extra = by_line.groupBy(key).agg(
        F.sum(F.when(F.col("n") > 1, F.col("idf")).otherwise(0.0)).alias("bonus"), F.array_sort(F.collect_list("line")).alias("line_numbers")
    )
    return base.join(extra, key).select(key, (F.col("base") + proximity * F.col("bonus")).alias("score"), "total_lines", "line_numbers")


def search(
    files: DataFrame, query: str, include: str | None = None, exclude: str | None = None, limit: int | None = None, is_regex: bool = False, key: str = "path"
) -> DataFrame:
    """(key, score, total_lines, line_numbers) of files(key, text), best first.

    A limit of None, 0 or -1 means all.
    """
    from tessarine.functions.globs import selected

    chosen = files.where(selected(F.col(key), include, exclude)) if include or exclude else files
    chosen = chosen.select(key, "text")
    total = chosen.count()
    patterns = terms.search_patterns(query, is_regex)
    ranked = rank_files(file_hits(chosen, patterns, key), len(patterns), total, key) if patterns else rank_matches(pattern_matches(file_hits(chosen, [], key), key), total, key)
    ranked = ranked.orderBy(F.desc("score"), key)
    return ranked.limit(limit) if limit and limit > 0 else ranked


def with_text(ranked: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """(key, score, line, line_text): the hit lines of ranked files, read only for these."""
    wanted = ranked.select(key, "score", F.explode("line_numbers").alias("line"))
    picked = files.select(key, "text").join(ranked.select(key), key, "left_semi")
    return wanted.join(lines_of(picked).withColumn("line_text", trim_end(F.col("line_text"))), [key, "line"])


def totals(ranked: DataFrame) -> DataFrame:
    """(files, lines) over all ranked files, before any limit."""
    return ranked.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("line_numbers")), F.lit(0)).alias("lines"))


def filter_lines(files: DataFrame, globs: list[str], key: str = "path") -> DataFrame:
    """(key, line, line_text) of lines that any glob matches, without regard to ASCII case."""
    pattern = "(?i)" + "|".join(terms.line_glob(g) for g in globs)
    return lines_of(files.select(key, "text").where(F.col("text").rlike(pattern))).where(F.col("line_text").rlike(pattern))


def read_range(files: DataFrame, start: int, end: int, key: str = "path") -> DataFrame:
    """Lines start .. end, from 1, both inclusive and cut to the file."""
    first = max(start, 1)
    cut = F.slice(F.split("text", "\n"), first, max(end - first + 1, 0))
    return files.select(key, F.posexplode(cut).alias("line", "line_text")).withColumn("line", F.col("line") + first)


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
