"""Registered queries of interval joins, merges, symbols and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarine.operators import intervals, lexical, references
from tessarine.plans.derived import CTES, files, lines, points, register, symbols

_CONTAINER = "type IN (1, 2, 3, 4, 5, 20, 21, 22, 23, 80, 81)"
CTES["k"] = f"k AS (SELECT * FROM s WHERE {_CONTAINER})"
CTES["i"] = (
    "i AS (SELECT path, line, line_count, arg_min({'type': type, 'name': name, 'a': start_line, 'b': end_line, 'fqn': fqn}, (end_line - start_line) * 1000000 - start_line) AS c "
    "FROM (SELECT p.*, k.type, k.name, k.start_line, k.end_line, k.fqn FROM p JOIN k ON p.path = k.path AND k.start_line <= p.line AND p.line <= k.end_line) GROUP BY path, line, line_count)"
)


@register(
    "join12_innermost_container",
    "SELECT p.path, p.line, coalesce(c.name, '') AS name, coalesce(c.a, -1)::INTEGER AS start_line, coalesce(c.b, -1)::INTEGER AS end_line FROM p LEFT JOIN i USING (path, line)",
    "f", "l", "s", "k", "p", "i",
)
def innermost_container(spark, sf_dir):
    found = intervals.innermost_container(points(spark, sf_dir), symbols(spark, sf_dir))
    return found.select(
        "path", "line", F.coalesce("symbol.name", F.lit("")).alias("name"), F.coalesce("symbol.start_line", F.lit(-1)).alias("start_line"), F.coalesce("symbol.end_line", F.lit(-1)).alias("end_line")
    )


@register(
    "join13_qualified_name",
    """+n AS (SELECT DISTINCT path, line, regexp_extract(line_text, '[A-Za-z]+') AS name FROM l WHERE regexp_matches(line_text, '[A-Za-z]'))
    SELECT n.path, n.line, n.name, coalesce(max(s.fqn), n.name) AS fqn FROM n LEFT JOIN s ON n.path = s.path AND n.name = s.name AND s.start_line <= n.line AND n.line <= s.end_line GROUP BY n.path, n.line, n.name""",
    "f", "l", "s",
)
def qualified_name(spark, sf_dir):
    own = lines(spark, sf_dir).select("path", "line", F.regexp_extract("line_text", "[A-Za-z]+", 0).alias("name")).where("name <> ''").distinct()
    return intervals.qualified_name(own, symbols(spark, sf_dir)).select("path", "line", "name", "fqn")


CTES["w"] = (
    "w AS (SELECT p.path, p.line, p.line_count, coalesce(c.a, 0) AS low, coalesce(c.b, p.line_count - 1) AS high FROM p LEFT JOIN i USING (path, line)), "
    "b AS (SELECT w.path, w.line, w.low, w.high, max(CASE WHEN k.end_line < w.line THEN k.end_line + 1 END) AS fl, min(CASE WHEN k.start_line > w.line THEN k.start_line - 1 END) AS ce "
    "FROM w LEFT JOIN k ON k.path = w.path AND NOT (k.start_line <= w.line AND w.line <= k.end_line) AND k.start_line BETWEEN w.low AND w.high GROUP BY ALL), "
    "y AS (SELECT path, line, greatest(low, coalesce(fl, low))::INTEGER AS min_line, least(high, coalesce(ce, high))::INTEGER AS max_line FROM b)"
)


@register("join14_context_bounds", "SELECT * FROM y", "f", "l", "s", "k", "p", "i", "w")
def context_bounds(spark, sf_dir):
    return intervals.context_bounds(points(spark, sf_dir), symbols(spark, sf_dir)).select("path", "line", "min_line", "max_line")


_MERGE = """m AS (SELECT *, CASE WHEN {a} <= max({b}) OVER (PARTITION BY {by} ORDER BY {a}, {b} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS fresh FROM {src}),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY {a}, {b}, fresh DESC ROWS UNBOUNDED PRECEDING) AS island FROM m)"""


def _merged(src, by="path", a="start_line", b="end_line", gap=0):
    return _MERGE.format(src=src, by=by, a=a, b=b, gap=gap)


@register(
    "agg17_top9_merge_overlaps",
    f"+r AS (SELECT path, start_line, end_line, (start_line * 37 % 101) / 100.0 AS score FROM s), {_merged('r')} SELECT path, min(start_line) AS start_line, max(end_line) AS end_line, max(score)::DOUBLE AS score FROM n GROUP BY path, island",
    "f", "l", "s",
)
def merge_overlaps(spark, sf_dir):
    own = symbols(spark, sf_dir).select("path", "start_line", "end_line", (F.col("start_line") * 37 % 101 / 100.0).alias("score"))
    return intervals.merge_results(own)


@register(
    "agg18_agg11_context_sections",
    f"""+g AS (SELECT y.path, coalesce(c.fqn || c.a || '-' || c.b, '') AS box, greatest(line - 3, min_line)::INTEGER AS start_line, least(line + 3, max_line)::INTEGER AS end_line FROM y LEFT JOIN i USING (path, line)), {_merged("g", "path, box", gap=1)}
    SELECT path, box, min(start_line) AS start_line, max(end_line) AS end_line FROM n GROUP BY path, box, island""",
    "f", "l", "s", "k", "p", "i", "w",
)
def context_sections(spark, sf_dir):
    """Hits grouped by container, their context cut to it and merged where it touches."""
    own, all_symbols = points(spark, sf_dir), symbols(spark, sf_dir)
    box = F.coalesce(F.concat("symbol.fully_qualified_name", "symbol.start_line", F.lit("-"), "symbol.end_line"), F.lit(""))
    held = intervals.innermost_container(own, all_symbols).select("path", "line", box.alias("box"))
    bounds = intervals.context_bounds(own, all_symbols)
    windows = held.join(bounds, ["path", "line"]).select(
        "path", "box", F.greatest(F.col("line") - 3, "min_line").alias("start_line"), F.least(F.col("line") + 3, "max_line").alias("end_line")
    )
    return intervals.context_sections(windows, ["path", "box"])


CTES["ref"] = (
    "e AS (SELECT p.path, p.line, p.line_count, c.name AS box, c.a, c.b, greatest(greatest(0, p.line - 10), coalesce(c.a, 0)) AS lo, "
    "least(least(p.line_count - 1, p.line + 10), coalesce(c.b, p.line_count)) AS hi FROM p LEFT JOIN i USING (path, line)), "
    "u AS (SELECT *, CASE WHEN a IS NOT NULL AND 20 - (hi - lo) > 0 THEN least(lo - a, 20 - (hi - lo)) ELSE 0 END AS up FROM e), "
    "win AS (SELECT path, line, box, a AS box_line, (lo - up)::INTEGER AS start_line, "
    "(hi + CASE WHEN a IS NOT NULL AND 20 - (hi - lo) - up > 0 THEN least(b - hi, 20 - (hi - lo) - up) ELSE 0 END)::INTEGER AS end_line FROM u)"
)


@register("join20_reference_windows", "SELECT path, line, coalesce(box, '') AS container, start_line, end_line FROM win", "f", "l", "s", "k", "p", "i", "ref")
def reference_windows(spark, sf_dir):
    found = intervals.reference_windows(points(spark, sf_dir), symbols(spark, sf_dir))
    return found.select("path", "line", F.coalesce("container_name", F.lit("")).alias("container"), "start_line", "end_line")


_GROUPS = """x AS (SELECT *, coalesce(box, '') || '@' || coalesce(box_line, -1) AS box_key FROM win),
    z AS (SELECT *, CASE WHEN box_key = lag(box_key) OVER o THEN 0 ELSE 1 END AS chg FROM x WINDOW o AS (PARTITION BY path ORDER BY start_line, end_line, box_line NULLS FIRST, box NULLS FIRST, line)),
    q AS (SELECT *, sum(chg) OVER (PARTITION BY path ORDER BY start_line, end_line, box_line NULLS FIRST, box NULLS FIRST, line ROWS UNBOUNDED PRECEDING) AS run FROM z),
    m AS (SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY path, run ORDER BY start_line, end_line, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM q),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY path, run ORDER BY start_line, end_line, line ROWS UNBOUNDED PRECEDING) AS island FROM m),
grp AS (SELECT path, min(start_line) AS start_line, max(end_line) AS end_line, coalesce(max(box), '') AS container, min(box_line) AS box_line, count(*) AS n FROM n GROUP BY path, run, island)"""


@register("agg19_merge_references", f"+{_GROUPS} SELECT path, start_line, end_line, container, n FROM grp", "f", "l", "s", "k", "p", "i", "ref")
def merge_references(spark, sf_dir):
    windows = intervals.reference_windows(points(spark, sf_dir), symbols(spark, sf_dir)).withColumn("ref", F.col("line"))
    found = intervals.merge_references(windows)
    return found.select("path", "start_line", "end_line", F.coalesce("container_name", F.lit("")).alias("container"), F.col("references").alias("n"))


CTES["pof"] = "p AS (SELECT path, line, line_count FROM l WHERE regexp_matches(line_text, '\\bof\\b'))"


@register(
    "q4_agg26_references",
    f"""+{_GROUPS}, lab AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY start_line, end_line, box_line NULLS FIRST, container ROWS UNBOUNDED PRECEDING)::BIGINT AS fin, sum(n) OVER (PARTITION BY path)::BIGINT AS total FROM grp)
    SELECT path, start_line, end_line, container, total, CASE WHEN n = 1 THEN fin::VARCHAR ELSE (fin - n + 1) || '-' || fin END AS label FROM lab""",
    "f", "l", "s", "k", "pof", "i", "ref",
)
def symbol_references(spark, sf_dir):
    """Lines with a word, verified, in their context windows, merged and numbered."""
    own = lines(spark, sf_dir)
    refs = references.verified(references.occurrences(own, "of"), own, "of").join(own.select("path", "line", "line_count"), ["path", "line"])
    windows = intervals.reference_windows(refs.select("path", "line", "line_count").distinct(), symbols(spark, sf_dir)).withColumn("ref", F.col("line"))
    found = intervals.reference_labels(intervals.merge_references(windows))
    return found.select("path", "start_line", "end_line", F.coalesce("container_name", F.lit("")).alias("container"), "total", "label")


@register(
    "q13_signature_merge",
    """+g AS (SELECT path, start_line AS a, end_line AS b, greatest(start_line - 4 - start_line % 9, 0) AS sa, greatest(start_line - 3 - start_line % 9, 0) AS sb FROM s),
    h AS (SELECT *, (sa <= b AND a <= sb) OR (a - sb BETWEEN 0 AND 5) AS near FROM g)
    SELECT path, (CASE WHEN near THEN least(a, sa) ELSE a END)::INTEGER AS start_line, (CASE WHEN near THEN greatest(b, sb) ELSE b END)::INTEGER AS end_line, NOT near AS show_signature FROM h""",
    "f", "l", "s",
)
def signature_merge(spark, sf_dir):
    start = F.col("start_line")
    own = symbols(spark, sf_dir).select(
        "path", "start_line", "end_line", F.greatest(start - 4 - start % 9, F.lit(0)).alias("sig_start"), F.greatest(start - 3 - start % 9, F.lit(0)).alias("sig_end")
    )
    return intervals.with_signature(own).select("path", "start_line", "end_line", "show_signature")


_TOP = f"""t AS (SELECT path, start_line, end_line + 1 AS fin, name FROM s WHERE type IN (2, 20, 21)),
m AS (SELECT *, CASE WHEN start_line >= coalesce(max(fin) OVER (PARTITION BY path ORDER BY start_line, fin, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS fresh FROM t),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY start_line, fin, name ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT path, min(start_line) AS start_line, max(fin)::INTEGER AS end_line, arg_min(name, start_line * 1000000 + fin) AS name FROM n GROUP BY path, island)"""


def _top(spark, sf_dir):
    return intervals.top_level(symbols(spark, sf_dir).where(F.col("type").isin(2, 20, 21)))


@register("agg20_top_level_ranges", f"+{_TOP} SELECT path, start_line, end_line, name FROM g", "f", "l", "s")
def top_level_ranges(spark, sf_dir):
    return _top(spark, sf_dir).select("path", "start_line", "end_line", "name")


@register(
    "win3_absorb_above",
    f"""+{_TOP}, o AS (SELECT *, coalesce(lag(end_line) OVER (PARTITION BY path ORDER BY start_line), 0) AS low FROM g),
    x AS (SELECT o.path, o.name, o.start_line, o.end_line, o.low, max(l.line) AS blank FROM o LEFT JOIN l ON l.path = o.path AND l.line < o.start_line AND (l.line % 5 = 2 OR trim(l.line_text) = '') GROUP BY ALL)
    SELECT path, name, greatest(low, coalesce(blank + 1, 0))::INTEGER AS start_line, end_line FROM x""",
    "f", "l", "s",
)
def absorb_above(spark, sf_dir):
    """Lines 2, 7, 12, .. count as blank here."""
    text = lines(spark, sf_dir).withColumn("line_text", F.when(F.col("line") % 5 == 2, "").otherwise(F.col("line_text")))
    return intervals.absorb_above(_top(spark, sf_dir), text).select("path", "name", "start_line", "end_line")


@register("agg22_preamble_end", "SELECT path, (coalesce(max(CASE WHEN type = 40 THEN end_line END), -1) + 1)::INTEGER AS preamble_end FROM s GROUP BY path", "f", "l", "s")
def preamble_end(spark, sf_dir):
    return intervals.preamble_end(symbols(spark, sf_dir))


@register(
    "agg21_merge_comments",
    """+c AS (SELECT path, line, length(line_text) % 2 AS col FROM l),
    m AS (SELECT *, CASE WHEN line = lag(line) OVER o + 1 AND col = lag(col) OVER o THEN 0 ELSE 1 END AS fresh FROM c WINDOW o AS (PARTITION BY path ORDER BY line, col)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY line, col ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT path, min(line) AS start_line, max(line) AS end_line, min(col)::INTEGER AS "column" FROM n GROUP BY path, island""",
    "f", "l",
)
def merge_comments(spark, sf_dir):
    own = lines(spark, sf_dir).select("path", "line", (F.length("line_text") % 2).alias("column"))
    return intervals.merge_comments(own)


@register(
    "top5_symbol_order",
    "SELECT path, start_line, name, row_number() OVER (PARTITION BY path ORDER BY start_line, end_line - start_line, name) AS place FROM s",
    "f", "l", "s",
)
def symbol_order(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("start_line", F.col("end_line") - F.col("start_line"), "name")
    return symbols(spark, sf_dir).select("path", "start_line", "name", F.row_number().over(order).cast("long").alias("place"))


_FUZZY = ("(?is)t.*h.*e", "(?is)o.*n")


@register(
    "q3_set1_agg12_top6_symbols",
    f"""+h AS ({" UNION ALL ".join(f"SELECT path, name, start_line, {k} AS part FROM s WHERE regexp_matches(name, '{p}')" for k, p in enumerate(_FUZZY))}),
    d AS (SELECT DISTINCT path, name, start_line FROM h)
    SELECT path, name, start_line, CASE WHEN lower(name) IN ('the', 'on') THEN 0 WHEN contains(lower(name), 'the') OR contains(lower(name), 'on') THEN 1 ELSE 2 END AS tier FROM d WHERE NOT contains(path, 'mojom')""",
    "f", "l", "s",
)
def workspace_symbols(spark, sf_dir):
    """Symbols by the parts of a query: hits of all parts, each once, in tiers."""
    hits = references.distinct_symbols(references.symbol_hits(symbols(spark, sf_dir), "the on"))
    return references.ranked_symbols(references.clean_symbols(hits), "the on").select("path", "name", "start_line", "tier")


@register("pred20_symbol_hygiene", "SELECT path, start_line FROM s WHERE NOT regexp_matches(path, 'src13|/7$|^untitled:')", "f", "l", "s")
def symbol_hygiene(spark, sf_dir):
    return references.clean_symbols(symbols(spark, sf_dir), ("src13", "/7$")).select("path", "start_line")


@register(
    "src16_occurrences",
    r"""SELECT doc_id, line, n FROM (SELECT doc_id, line, len(regexp_extract_all(line_text, '\bof\b')) AS n FROM l) WHERE n > 0""",
    "f", "l",
)
def occurrences(spark, sf_dir):
    """Places of a whole word; the count of each line."""
    found = references.occurrences(lines(spark, sf_dir), "of", "doc_id")
    return found.groupBy("doc_id", "line").agg(F.count("*").alias("n"))


@register(
    "pred22_verified_references",
    r"""SELECT doc_id, line, (instr(line_text, 'on') - 1)::INTEGER AS "column" FROM l
    WHERE regexp_matches(line_text, '(?s)^.*?on') AND regexp_matches(substr(line_text, instr(line_text, 'on')), '^on($|[^A-Za-z0-9_])') AND (instr(line_text, 'on') = 1 OR regexp_matches(substr(line_text, instr(line_text, 'on') - 1, 1), '^[^A-Za-z0-9_]'))""",
    "f", "l",
)
def verified_references(spark, sf_dir):
    """The first place of the letters on each line as a reference, kept where it is the whole word; and lines past the end, none of which stays."""
    own = lines(spark, sf_dir)
    at = own.select("doc_id", "line", (F.instr("line_text", "on") - 1).alias("column"))
    past = own.select("doc_id", F.col("line_count").alias("line"), F.lit(0).alias("column")).distinct()
    return references.verified(at.unionByName(past), own, "on", "doc_id")


@register(
    "q5_exact_positions",
    r"""+r AS (SELECT doc_id, line + line % 4 - 1 AS asked, line_text, regexp_extract(line_text, '[A-Za-z0-9_]+') AS word FROM l),
    x AS (SELECT r.*, l.line, row_number() OVER (PARTITION BY r.doc_id, r.asked, r.line_text ORDER BY abs(l.line - asked), l.line) AS k FROM r JOIN l ON l.doc_id = r.doc_id AND abs(l.line - asked) <= 5 AND trim(l.line_text) = trim(r.line_text)
          WHERE word <> '')
    SELECT doc_id, asked::INTEGER AS asked, line::INTEGER AS found_line FROM x WHERE k = 1 AND regexp_matches(line_text, '^[A-Za-z0-9_]+([^A-Za-z0-9_]|$)')""",
    "f", "l",
)
def exact_positions(spark, sf_dir):
    """Lines looked for a few lines off, by their text and first word."""
    own = lines(spark, sf_dir)
    ask = own.select(
        "doc_id", (F.col("line") + F.col("line") % 4 - 1).alias("line"), F.regexp_extract("line_text", "[A-Za-z0-9_]+", 0).alias("name"), F.lit(0).alias("column"),
        F.col("line_text").alias("source_line"),
    ).where(F.col("source_line").rlike("^[A-Za-z0-9_]+([^A-Za-z0-9_]|$)"))
    found = references.resolve_position(own, ask, "doc_id")
    return found.where("found_line IS NOT NULL").select("doc_id", F.col("line").alias("asked"), "found_line")


@register(
    "fn25_comment_above",
    """+t AS (SELECT doc_id, line, line % 7 IN (1, 2) AS com FROM l)
    SELECT doc_id, line, (CASE WHEN line % 7 = 3 THEN line - 2 ELSE line - 1 END)::INTEGER AS comment_start, line - 1 AS comment_end FROM l WHERE line % 7 IN (2, 3)""",
    "f", "l",
)
def comment_above(spark, sf_dir):
    """Lines 1, 2, 8, 9, .. made comments."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 7).isin(1, 2), F.concat(F.lit("  // "), x)).otherwise(F.concat(F.lit("x"), x)))
    own = files(spark, sf_dir).select("doc_id", F.array_join(marked, "\n").alias("text"))
    found = references.comment_above(own, lines(spark, sf_dir).select("doc_id", "line"), "doc_id")
    return found.where("comment_start IS NOT NULL")


@register(
    "q1_agg11_results_by_container",
    """+h AS (SELECT path, line FROM l WHERE regexp_matches(line_text, '(?i)\\bthe\\b'))
    SELECT h.path, coalesce(c.fqn, '') AS container, min(line)::INTEGER AS first_line, count(*) AS n FROM h LEFT JOIN i USING (path, line) GROUP BY h.path, coalesce(c.fqn, ''), coalesce(c.a, -1), coalesce(c.b, -1)""",
    "f", "l", "s", "k", "p", "i",
)
def results_by_container(spark, sf_dir):
    """Hits of a search under their innermost containers."""
    hits = lexical.file_hits(files(spark, sf_dir), ["(?i)(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])"])
    hits = hits.select("path", F.explode(F.col("m")[0]["line_numbers"]).alias("line"))
    held = intervals.innermost_container(hits, symbols(spark, sf_dir))
    box = [F.coalesce("symbol.fully_qualified_name", F.lit("")).alias("container"), F.coalesce("symbol.start_line", F.lit(-1)).alias("a"), F.coalesce("symbol.end_line", F.lit(-1)).alias("b")]
    return held.groupBy("path", *box).agg(F.min("line").alias("first_line"), F.count("*").alias("n")).drop("a", "b")
