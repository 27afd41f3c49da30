"""Registered queries of scans, predicates and ranked lexical search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarine.functions import globs, terms
from tessarine.functions import text as T
from tessarine.operators import lexical
from tessarine.plans.derived import CTES, files, lines, register

QUERY = "the of* (und|que)"
_RE2 = terms.search_patterns(QUERY, engine="re2")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HITS = "h AS (" + " UNION ALL ".join(
    f"SELECT doc_id, line_count, line, {k} AS p, len(regexp_extract_all(line_text, {_literal(r)})) AS n FROM l WHERE regexp_matches(line_text, {_literal(r)})" for k, r in enumerate(_RE2)
) + ")"
_RANK = f"""{_HITS},
m AS (SELECT doc_id, line_count, p, sum(n) AS tf FROM h GROUP BY ALL),
d AS (SELECT p, ln(((SELECT count(*) FROM f) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM m GROUP BY p),
a AS (SELECT avg(line_count) AS avgdl FROM (SELECT DISTINCT doc_id, line_count FROM m)),
b AS (SELECT doc_id, line_count, sum(idf * tf * 2.2 / (tf + 1.2 * (0.85 + 0.15 * line_count / avgdl))) AS base FROM m JOIN d USING (p), a GROUP BY ALL),
x AS (SELECT doc_id, line, count(*) AS k, sum(idf) AS idf FROM h JOIN d USING (p) GROUP BY ALL),
r AS (
  SELECT doc_id, line_count, base + 0.5 * bonus AS score, n_lines FROM b JOIN
  (SELECT doc_id, sum(CASE WHEN k > 1 THEN idf ELSE 0 END) AS bonus, count(*) AS n_lines FROM x GROUP BY doc_id) USING (doc_id))
"""


def _hits(spark, sf_dir):
    return lexical.file_hits(files(spark, sf_dir), terms.search_patterns(QUERY), "doc_id")


def _matches(spark, sf_dir):
    return lexical.pattern_matches(_hits(spark, sf_dir), "doc_id")


def _ranked(spark, sf_dir):
    return lexical.rank_files(_hits(spark, sf_dir), len(terms.search_patterns(QUERY)), files(spark, sf_dir).count(), "doc_id")


@register("q1_bm25_search", f"+{_RANK} SELECT doc_id, round(score, 6) AS score, line_count AS total_lines, n_lines AS hit_lines FROM r ORDER BY score DESC, doc_id LIMIT 15", "f", "l")
def bm25_search(spark, sf_dir):
    """Ranked search: the best 15 files, as many as the search tool shows."""
    best = lexical.search(files(spark, sf_dir).select("doc_id", "text"), QUERY, limit=15, key="doc_id")
    return best.select("doc_id", F.round("score", 6).alias("score"), "total_lines", F.size("line_numbers").cast("long").alias("hit_lines"))


@register("agg5_bm25_all", f"+{_RANK} SELECT doc_id, round(score, 6) AS score FROM r", "f", "l")
def bm25_all(spark, sf_dir):
    return _ranked(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@register("agg6_proximity", f"+{_RANK} SELECT doc_id, round(bonus, 6) AS bonus FROM (SELECT doc_id, sum(CASE WHEN k > 1 THEN idf ELSE 0 END) AS bonus FROM x GROUP BY doc_id)", "f", "l")
def proximity(spark, sf_dir):
    """The bonus alone: the grouped form of the ranking, with and without it."""
    n = files(spark, sf_dir).count()
    rows = _matches(spark, sf_dir)
    with_, without = (lexical.rank_lines(rows, n, "doc_id", proximity=w).select("doc_id", F.col("score").alias(c)) for w, c in ((1.0, "a"), (0.0, "b")))
    return with_.join(without, "doc_id").select("doc_id", F.round(F.col("a") - F.col("b"), 6).alias("bonus"))


@register("agg1_term_frequency", f"+{_HITS} SELECT doc_id, p::INTEGER AS pattern_index, sum(n)::BIGINT AS frequency, count(*) AS hit_lines FROM h GROUP BY ALL", "f", "l")
def term_frequency(spark, sf_dir):
    return _matches(spark, sf_dir).select("doc_id", "pattern_index", "frequency", F.size("line_numbers").cast("long").alias("hit_lines"))


@register("agg2_agg3_df_idf", f"+{_RANK} SELECT p::INTEGER AS pattern_index, round(idf, 9) AS idf FROM d", "f", "l")
def df_idf(spark, sf_dir):
    n = files(spark, sf_dir).count()
    found = _matches(spark, sf_dir).groupBy("pattern_index").agg(F.count("*").alias("df"))
    return found.select("pattern_index", F.round(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 9).alias("idf"))


@register("agg4_avgdl", f"+{_RANK} SELECT round(avgdl, 9) AS avgdl FROM a", "f", "l")
def avgdl(spark, sf_dir):
    return _hits(spark, sf_dir).agg(F.round(F.avg("total_lines"), 9).alias("avgdl"))


@register("agg7_matched_lines", f"+{_HITS} SELECT DISTINCT doc_id, line FROM h", "f", "l")
def matched_lines(spark, sf_dir):
    return _ranked(spark, sf_dir).select("doc_id", F.explode("line_numbers").alias("line"))


@register("agg8_totals", f"+{_HITS} SELECT count(DISTINCT doc_id) AS files, count(DISTINCT (doc_id, line)) AS lines FROM h", "f", "l")
def search_totals(spark, sf_dir):
    return lexical.totals(_ranked(spark, sf_dir))


@register("agg28_merged_partials", f"+{_HITS} SELECT p::INTEGER AS pattern_index, sum(n)::BIGINT AS frequency FROM h GROUP BY p", "f", "l")
def merged_partials(spark, sf_dir):
    """Partial counts of tasks added up."""
    return _matches(spark, sf_dir).groupBy("pattern_index").agg(F.sum("frequency").alias("frequency"))


@register("top1_ranked_order", f"+{_RANK} SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS place FROM r ORDER BY place LIMIT 50", "f", "l")
def ranked_order(spark, sf_dir):
    from pyspark.sql import Window

    best = _ranked(spark, sf_dir).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(50)
    return best.select("doc_id", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long").alias("place"))


@register(
    "join15_hit_text",
    f"""+{_RANK} SELECT doc_id, line, md5(regexp_replace(line_text, '\\s+$', '')) AS text_md5
    FROM (SELECT doc_id FROM r ORDER BY score DESC, doc_id LIMIT 15) JOIN (SELECT DISTINCT doc_id, line FROM h) USING (doc_id) JOIN l USING (doc_id, line)""",
    "f", "l",
)
def hit_text(spark, sf_dir):
    """Texts of the best files' hit lines; only their files are read again."""
    own = files(spark, sf_dir).select("doc_id", "text")
    best = lexical.search(own, QUERY, limit=15, key="doc_id")
    return lexical.with_text(best, own, "doc_id").select("doc_id", "line", F.md5("line_text").alias("text_md5"))


@register("src6_lines", "SELECT doc_id, line, md5(line_text) AS line_md5 FROM l", "f", "l")
def source_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line", F.md5("line_text").alias("line_md5"))


@register("src2_agg14_roots", "SELECT DISTINCT lower(path) AS path_key FROM f", "f")
def roots(spark, sf_dir):
    """Two roots that hold the same files in different case."""
    own = files(spark, sf_dir).select("path")
    both = own.unionByName(own.select(F.upper("path").alias("path")))
    return both.select(T.path_key(F.col("path")).alias("path_key")).dropDuplicates(["path_key"])


_EXT = "CASE lang WHEN 'en' THEN '.CC' WHEN 'de' THEN '.h' WHEN 'fr' THEN '.md' ELSE '' END"


def _with_extension(spark, sf_dir):
    lang = F.split("path", "/")[1]
    ext = F.when(lang == "en", ".CC").when(lang == "de", ".h").when(lang == "fr", ".md").otherwise("")
    return files(spark, sf_dir).select("doc_id", F.concat("path", ext).alias("path"), "text")


@register(
    "pred1_index_membership",
    f"""SELECT doc_id FROM (SELECT doc_id, source || '/' || lang || '/' || doc_id || {_EXT} AS path, lang, source FROM documents)
    WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3', 'src13') AND NOT regexp_matches(path, '^src13/.*7\\.CC$')""",
)
def index_membership(spark, sf_dir):
    keep = globs.member(F.col("path"), [".cc", ".h"], ["SRC1", "src2/", "src3", "src13"], ["src13/**/*7.CC"])
    return _with_extension(spark, sf_dir).where(keep).select("doc_id")


@register(
    "pred2_outermost_dirs",
    """WITH d AS (SELECT DISTINCT source || '/' || lang AS dir FROM documents UNION SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0)
    SELECT dir FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS o WHERE starts_with(d.dir, o.dir || '/'))""",
)
def outermost_dirs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dirs = docs.select(F.concat_ws("/", "source", "lang").alias("dir")).union(docs.where("doc_id % 3 = 0").select("source")).distinct()
    # a directory's ancestors are its prefixes, so an equality join finds the ones that are in the list
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    nested = dirs.where(F.size(parts) > 1).select("dir", F.explode(above).alias("top")).join(dirs.select(F.col("dir").alias("top")), "top", "left_semi")
    return dirs.join(nested, "dir", "left_anti")


@register(
    "pred4_path_globs",
    "SELECT path FROM f WHERE regexp_matches(path, '^(src1[^/]*/(en|de)/[^/]*|src2/.*)$') AND NOT regexp_matches(path, '^(.*/)?[^/]*7$')",
    "f",
)
def path_globs(spark, sf_dir):
    return files(spark, sf_dir).where(globs.selected(F.col("path"), "SRC1*/en/*, src1*/de/*, src2/**", "**/*7")).select("path")


@register("pred21_case_globs", "SELECT path FROM f WHERE regexp_matches(path, '^src1[^/]*/en/[^/]$')", "f")
def case_globs(spark, sf_dir):
    """Globs that mind case, as symbol lists use them."""
    return files(spark, sf_dir).where(globs.selected(F.col("path"), "src1*/en/?,SRC2/**", nocase=False)).select("path")


_OR = "(?i)" + terms.any_pattern("idiot un? -the", engine="re2")


@register("pred6_any_term", f"SELECT doc_id, line FROM l WHERE regexp_matches(line_text, {_literal(_OR)})", "f", "l")
def any_term(spark, sf_dir):
    return lines(spark, sf_dir).where(F.col("line_text").rlike("(?i)" + terms.any_pattern("idiot un? -the"))).select("doc_id", "line")


@register(
    "pred7_all_terms",
    "SELECT doc_id FROM f WHERE " + " AND ".join(f"regexp_matches(text, {_literal(p)})" for p in terms.all_patterns("the of in?", engine="re2")),
    "f",
)
def all_terms(spark, sf_dir):
    found = files(spark, sf_dir)
    for p in terms.all_patterns("the of in?"):
        found = found.where(F.col("text").rlike(p))
    return found.select("doc_id")


@register("pred10_regex_mode", "SELECT doc_id, line FROM l WHERE regexp_matches(line_text, 'T[a-h]+e[nr]\\b')", "f", "l")
def regex_mode(spark, sf_dir):
    """A regular expression minds case and stands as it is."""
    [pattern] = terms.search_patterns(r" T[a-h]+e[nr]\b ", is_regex=True)
    return lines(spark, sf_dir).where(F.col("line_text").rlike(pattern)).select("doc_id", "line")


@register("q11_filter_lines", "SELECT doc_id, line, md5(line_text) AS line_md5 FROM l WHERE regexp_matches(line_text, '(?i)th.*on\\.|\\$\\$')", "f", "l")
def filter_lines(spark, sf_dir):
    """Lines that any of some globs matches, without regard to case or words."""
    found = lexical.filter_lines(files(spark, sf_dir), ["th*on.", "$$"], "doc_id")
    return found.select("doc_id", "line", F.md5("line_text").alias("line_md5"))


@register("pred12_numbered_grep", "SELECT doc_id, line + 1 AS line_number FROM l WHERE regexp_matches(line_text, '(?i)license|apache.2')", "f", "l")
def numbered_grep(spark, sf_dir):
    return lexical.filter_lines(files(spark, sf_dir), ["license", "apache?2"], "doc_id").select("doc_id", (F.col("line") + 1).alias("line_number"))


@register("pred27_line_range", "SELECT doc_id, line + 1 AS line, md5(line_text) AS line_md5 FROM l WHERE line BETWEEN 2 AND 5", "f", "l")
def line_range(spark, sf_dir):
    return lexical.read_range(files(spark, sf_dir), 3, 6, "doc_id").select("doc_id", "line", F.md5("line_text").alias("line_md5"))


_COUNTS = {k: t for k, t in enumerate(["the", "th*", "*ing", "a?", "(the)", "->b", "in."])}
CTES["t"] = "t AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {k} AS term, len(regexp_extract_all(line_text, {_literal(terms.patterns(t, 're2')[0])})) AS n FROM l" for k, t in _COUNTS.items()
) + ")"


@register("pred5_pred9_terms", "SELECT doc_id, term::INTEGER AS term, sum(n)::BIGINT AS n FROM t GROUP BY ALL HAVING sum(n) > 0", "f", "l", "t")
def compiled_terms(spark, sf_dir):
    """Matches of each compiled glob term, line by line."""
    each = [F.regexp_count("line_text", F.lit(terms.patterns(t)[0])).cast("long") for t in _COUNTS.values()]
    rows = lines(spark, sf_dir).groupBy("doc_id").agg(*(F.sum(n).alias(f"n{k}") for k, n in enumerate(each)))
    return rows.select("doc_id", F.posexplode(F.array(*(f"n{k}" for k in range(len(each))))).alias("term", "n")).where("n > 0")
