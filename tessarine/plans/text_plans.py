"""Registered queries of scalar functions and of parsing and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarine.functions import text as T
from tessarine.operators import chunking, references
from tessarine.plans.derived import files, lines, register, symbols

_CPP = "path || CASE lang WHEN 'en' THEN '.cc' WHEN 'de' THEN '.h' WHEN 'fr' THEN '.md' ELSE '.txt' END"


def _named(spark, sf_dir):
    """Files with an extension by language."""
    lang = F.split("path", "/")[1]
    ext = F.when(lang == "en", ".cc").when(lang == "de", ".h").when(lang == "fr", ".md").otherwise(".txt")
    return files(spark, sf_dir).select("doc_id", F.concat("path", ext).alias("path"), "text")


_SCRUB = {"src1*/**": [r"[A-Z][a-z]+", r"\d+"], "**/en/*": [r"\bof\b"]}


@register(
    "fn1_scrub",
    r"""SELECT doc_id, md5(CASE WHEN path LIKE '%/en/%' THEN regexp_replace(a, '\bof\b', '  ', 'g') ELSE a END) AS scrubbed_md5
    FROM (SELECT doc_id, path, text, CASE WHEN path LIKE 'src1%' THEN array_to_string(list_transform(
        list_zip(string_split_regex(text, '[A-Z][a-z]+|\d+'), regexp_extract_all(text, '[A-Z][a-z]+|\d+')),
        lambda x: coalesce(x[1], '') || repeat(' ', length(coalesce(x[2], '')))), '') ELSE text END AS a FROM f)
    WHERE (path LIKE 'src1%' AND regexp_matches(text, '[A-Z][a-z]+|\d+')) OR (path LIKE '%/en/%' AND regexp_matches(a, '\bof\b'))""",
    "f",
)
def scrub(spark, sf_dir):
    """Matches blanked out, file by file; ASCII word ends, as the prose has no other next to the word."""
    own = files(spark, sf_dir)
    pattern = {g: [p.replace(r"\bof\b", "(?<![A-Za-z0-9_])of(?![A-Za-z0-9_])") for p in ps] for g, ps in _SCRUB.items()}
    return own.select("doc_id", T.scrub(F.col("text"), F.col("path"), pattern).alias("s")).where("s IS NOT NULL").select("doc_id", F.md5("s").alias("scrubbed_md5"))


@register(
    "fn2_fn3_hashes",
    """SELECT doc_id, sha256(text) AS sha256, CASE WHEN replace(text, 'the', '   ') <> text
    THEN sha256(sha256(text) || sha256(replace(text, 'the', '   '))) ELSE sha256(text) END AS combined FROM f""",
    "f",
)
def hashes(spark, sf_dir):
    scrubbed = T.scrub(F.col("text"), F.col("path"), {"**": ["the"]})
    return files(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), T.combined_hash(F.col("text"), scrubbed).alias("combined"))


@register(
    "fn4_fn8_output_paths",
    f"""WITH f AS (SELECT doc_id, source || '/' || lang || '/' || lang || doc_id AS path, lang FROM documents), g AS (SELECT doc_id, {_CPP} AS path FROM f),
    h AS (SELECT *, regexp_extract(path, '[^/]+$') AS name, upper(substr(sha256(path), 1, 16)) AS digest FROM g)
    SELECT doc_id, 'idx/' || lower(name[1]) || '/' || name || '.' || digest || '.idx' AS index_path,
    'out/' || lower(name[1]) || '/' || regexp_replace(name, '\\.[^.]*$', '') || '.' || digest || '.jsonl' AS output_path FROM h""",
)
def stored_paths(spark, sf_dir):
    lang = F.split("path", "/")[1]
    own = _named(spark, sf_dir).select("doc_id", F.regexp_replace("path", r"/([^/]+)$", F.concat(F.lit("/"), lang, F.lit("$1"))).alias("path"))
    return own.select("doc_id", T.index_path(F.col("path"), "idx").alias("index_path"), T.output_path(F.col("path"), "out").alias("output_path"))


@register(
    "fn5_fn6_fn28_paths",
    """SELECT doc_id, CASE WHEN path LIKE 'src1/%' THEN substr(path, 6) ELSE '' END AS workspace_path, lower(path) AS path_key,
    regexp_extract(path, '[^/]+$') AS name FROM f""",
    "f",
)
def paths(spark, sf_dir):
    path = F.col("path")
    return files(spark, sf_dir).select("doc_id", T.workspace_path(path, "src1").alias("workspace_path"), T.path_key(path).alias("path_key"), T.basename(path).alias("name"))


@register(
    "fn7_agg23_file_groups",
    f"""+g AS (SELECT {_CPP.replace('path ||', "source || '/' || lang || '/' || (doc_id // 3) ||")} AS path FROM documents)
    SELECT lower(regexp_replace(path, '\\.[^./]*$', '')) AS group_key, count(DISTINCT path) AS n, min(path) AS first FROM g GROUP BY 1""",
    "f",
)
def file_groups(spark, sf_dir):
    from tessarine.operators.training import file_groups as grouped

    own = _named(spark, sf_dir).select(F.expr(r"concat(regexp_extract(path, '^(.*/)', 1), cast(doc_id div 3 as string), regexp_extract(path, '\\.[^.]*$', 0))").alias("path"))
    return grouped(own).select("group_key", F.size("paths").cast("long").alias("n"), F.col("paths")[0].alias("first"))


@register(
    "fn14_fn15_symbol_types",
    """SELECT type, CASE type WHEN 1 THEN 'Namespace' WHEN 2 THEN 'Class' WHEN 20 THEN 'Function' WHEN 21 THEN 'Method' WHEN 40 THEN 'Include'
    WHEN 60 THEN 'Comment' WHEN 24 THEN 'Prototype' ELSE 'Unknown' END AS type_name, type BETWEEN 20 AND 24 AS callable, type IN (1, 2, 20, 21) AS container,
    count(*) AS n FROM s GROUP BY ALL""",
    "f", "l", "s",
)
def symbol_types(spark, sf_dir):
    code = F.col("type")
    own = symbols(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    return own.select("type", T.symbol_type_name(code).alias("type_name"), T.is_callable(code).alias("callable"), T.is_container(code).alias("container"), "n")


@register(
    "fn16_parser_dispatch",
    f"SELECT CASE WHEN path LIKE '%.cc' OR path LIKE '%.h' THEN 'cpp' WHEN path LIKE '%.md' THEN 'markdown' ELSE 'default' END AS parser, count(*) AS n FROM (SELECT {_CPP.replace('path', 'source')} AS path FROM documents) GROUP BY 1",
)
def dispatch(spark, sf_dir):
    return _named(spark, sf_dir).groupBy(T.parser_name(F.col("path")).alias("parser")).agg(F.count("*").alias("n"))


@register(
    "fn17_fn18_prefixes",
    """SELECT path, start_line, md5('// file: ' || path || '\n// ' || kind || ': ' || fqn || CASE WHEN start_line > 0 AND type BETWEEN 20 AND 24
    THEN '\n// signature: ' || name || '()' ELSE '' END || '\n\n') AS cpp_md5, md5('---\nfile: ' || path || CASE WHEN type = 2 THEN '' ELSE '\nsection: ' || name END || '\n---\n\n') AS markdown_md5
    FROM (SELECT *, CASE type WHEN 1 THEN 'Namespace' WHEN 2 THEN 'Class' WHEN 20 THEN 'Function' WHEN 21 THEN 'Method' WHEN 40 THEN 'Include'
    WHEN 60 THEN 'Comment' ELSE 'Prototype' END AS kind FROM s)""".replace("'\\n", "chr(10) || '").replace("\n//", "' || chr(10) || '//"),
    "f", "l", "s",
)
def prefixes(spark, sf_dir):
    kind = T.symbol_type_name(F.col("type"))
    sig = F.concat("name", F.lit("()"))
    cpp = T.cpp_prefix(F.col("path"), kind, F.col("fully_qualified_name"), sig, F.col("start_line"))
    markdown = T.markdown_prefix(F.col("path"), F.when(F.col("type") != 2, F.col("name")))
    return symbols(spark, sf_dir).select("path", "start_line", F.md5(cpp).alias("cpp_md5"), F.md5(markdown).alias("markdown_md5"))


@register(
    "fn19_signatures",
    r"SELECT doc_id, line, md5(trim(regexp_replace(regexp_replace(regexp_replace('( ' || line_text || '  x )', '\s+', ' ', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'))) AS signature_md5 FROM l",
    "f", "l",
)
def signatures(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line", F.md5(T.signature(F.concat(F.lit("( "), "line_text", F.lit("  x )")))).alias("signature_md5"))


@register(
    "fn20_fn26_qualified_names",
    """+o AS (SELECT DISTINCT path, name, start_line, end_line FROM s), e AS (SELECT path, name, start_line, end_line FROM s WHERE type IN (1, 2)),
    j AS (SELECT o.path, o.name, o.start_line, o.end_line, e.name AS outer_name, e.start_line AS a, e.end_line AS b FROM o LEFT JOIN e
          ON o.path = e.path AND e.start_line <= o.start_line AND e.end_line >= o.end_line AND e.end_line - e.start_line > o.end_line - o.start_line)
    SELECT path, name, start_line, end_line, coalesce(string_agg(outer_name, '::' ORDER BY a - b, a, outer_name) || '::', '') || name AS qualified FROM j GROUP BY path, name, start_line, end_line""",
    "f", "l", "s",
)
def qualified_names(spark, sf_dir):
    return references.qualified_from_tree(symbols(spark, sf_dir))


@register("fn23_code_blocks", f"SELECT doc_id, md5('```' || CASE lang WHEN 'en' THEN 'cpp' WHEN 'de' THEN 'cpp' WHEN 'fr' THEN 'markdown' ELSE '' END || chr(10) || text || chr(10) || '```') AS block_md5 FROM documents")
def code_blocks(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", F.md5(T.code_block(F.col("text"), F.col("path"))).alias("block_md5"))


@register("fn24_signature_end", "SELECT doc_id, coalesce(nullif(instr(text, ';'), 0), length(string_split(text, chr(10))[1]))::INTEGER AS signature_end FROM (SELECT doc_id, replace(replace(replace(text, '{', '('), '}', ')'), '.', ';') AS text FROM f)", "f")
def signature_ends(spark, sf_dir):
    """With full stops as semicolons and no braces."""
    code = F.translate("text", "{}.", "();")
    return files(spark, sf_dir).select("doc_id", T.signature_end(code).alias("signature_end"))


@register("fn27_search_urls", "SELECT doc_id, 'https://code.example/?q=' || replace(replace(replace(replace(replace(url_encode(text), '%2A', '*'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')') || '&n=1' AS url FROM f", "f")
def search_urls(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", T.search_url("https://code.example/?q={query}&n=1", F.col("text")).alias("url"))


@register("fn29_breakpoints", r"SELECT doc_id, '`app!' || replace(path, '/', '\\') || ':' || (doc_id + 1) || '`' AS breakpoint FROM f", "f")
def breakpoints(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", T.breakpoint(F.lit("app"), F.col("path"), F.col("doc_id")).alias("breakpoint"))


@register(
    "fn30_page_links",
    r"""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html || ' ' || url, 'https?://[^\s"''<>,;`)]+')) AS link FROM pages) GROUP BY ALL""",
)
def page_links(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = pages.select("page_id", F.explode(T.path_matches(F.concat_ws(" ", "html", "url"), "url")).alias("link"))
    return found.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@register(
    "fn31_fn32_fn33_fn35_suffixes",
    r"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || ':' || page_id || ':7' WHEN 1 THEN url || ':' || page_id WHEN 2 THEN url || '(' || page_id || ')'
    WHEN 3 THEN url || '(' || page_id || ', 9)' WHEN 4 THEN url || '#L' || page_id || '-L900' ELSE url || '.);' END AS t, url FROM pages)
    SELECT page_id, CASE WHEN page_id % 6 < 5 THEN url END AS path, CASE WHEN page_id % 6 < 5 THEN page_id::INTEGER ELSE -1 END AS line,
    CASE page_id % 6 WHEN 0 THEN 7 WHEN 3 THEN 9 ELSE -1 END AS "column", regexp_replace(t, '[!?.,:;)}\]]+$', '') AS stripped, true AS is_url,
    regexp_extract(substr(t, length(url) + 1), '^(:[0-9]+(:[0-9]+)?|[(][0-9]+(, *[0-9]+)?[)]|#L[0-9]+(-L[0-9]+)?)') AS suffix FROM p""",
)
def suffixes(spark, sf_dir):
    k, n, url = F.col("page_id") % 6, F.col("page_id").cast("string"), F.col("url")
    text = (
        F.when(k == 0, F.concat(url, F.lit(":"), n, F.lit(":7")))
        .when(k == 1, F.concat(url, F.lit(":"), n))
        .when(k == 2, F.concat(url, F.lit("("), n, F.lit(")")))
        .when(k == 3, F.concat(url, F.lit("("), n, F.lit(", 9)")))
        .when(k == 4, F.concat(url, F.lit("#L"), n, F.lit("-L900")))
        .otherwise(F.concat(url, F.lit(".);")))
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", text.alias("t"))
    found = pages.withColumn("c", T.line_column(F.col("t")))
    rest = F.substring("t", F.length("url") + 1, F.lit(1 << 20))
    return found.select(
        "page_id", "c.path", *(F.coalesce(f"c.{x}", F.lit(-1)).alias(x) for x in ("line", "column")), T.strip_punctuation(F.col("t")).alias("stripped"), T.is_url(F.col("t")).alias("is_url"), T.peek_suffix(rest).alias("suffix")
    )


@register(
    "fn36_json_payload",
    "SELECT doc_id, '{\"id\": ' || doc_id || '}' AS payload FROM documents",
)
def json_payload(spark, sf_dir):
    body = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit("}"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("well\n===JSON_START===\n"), body)).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("\n```json\n"), body, F.lit("\n```\n"))
    ).otherwise(F.concat(F.lit("  "), body, F.lit(" ")))
    return files(spark, sf_dir).select("doc_id", T.json_payload(answer).alias("payload"))


@register(
    "fn37_result_markers",
    """SELECT doc_id, pos::INTEGER AS place, i::INTEGER AS result FROM (SELECT doc_id, unnest([doc_id % 4, 4 + doc_id % 2, 7 + doc_id % 2 * 9]) AS i, unnest([0, 1, 2]) AS pos FROM documents)""",
)
def result_markers(spark, sf_dir):
    """Marks written and read back; a repeated one and a number that no mark has are dropped."""
    ids = [F.col("doc_id") % 4, 4 + F.col("doc_id") % 2, 7 + F.col("doc_id") % 2 * 9]
    answer = F.concat_ws(", ", *(T.result_marker(i) for i in ids), T.result_marker(ids[0]), F.lit("RESULT_004"))
    return files(spark, sf_dir).select("doc_id", F.posexplode(T.marked_results(answer)).alias("place", "result"))


@register(
    "fn38_numbered_files",
    "SELECT doc_id, md5('## File: ' || path || chr(10) || chr(10) || '```' || chr(10) || string_agg((line + 1) || ': ' || line_text, chr(10) ORDER BY line) || chr(10) || '```') AS block_md5 FROM l GROUP BY doc_id, path",
    "f", "l",
)
def numbered_files(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", F.md5(T.numbered_file(F.col("path"), F.col("text"))).alias("block_md5"))


@register("fn39_md_names", "SELECT doc_id, CASE WHEN lang = 'fr' THEN source || '.MD' ELSE source || '.md' END AS name FROM documents")
def md_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.ensure_md(F.when(F.col("lang") == "fr", F.concat("source", F.lit(".MD"))).otherwise(F.col("source"))).alias("name"))


@register("fn40_fn41_output", r"SELECT doc_id, line, md5(regexp_replace(line_text || '  ' || chr(9), '\s+$', '')) AS text_md5, printf('%.4f', line / 7) AS score FROM l", "f", "l")
def output(spark, sf_dir):
    text = T.trim_end(F.concat("line_text", F.lit("  \t")))
    return lines(spark, sf_dir).select("doc_id", "line", F.md5(text).alias("text_md5"), T.score_text(F.col("line") / 7).alias("score"))


@register(
    "fn42_win7_time_left",
    """WITH e AS (SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING) AS mean FROM events WHERE value IS NOT NULL),
    t AS (SELECT event_id, ceil(mean * (event_id % 5000) / 1000)::BIGINT AS s, event_id % 5000 AS n FROM e)
    SELECT event_id, CASE WHEN n <= 0 THEN '' WHEN s // 60 > 0 THEN ' (~' || s // 60 || 'm remaining)' ELSE ' (~' || s || 's remaining)' END AS eta FROM t""",
)
def time_left(spark, sf_dir):
    """Every user's events as the batches of a run."""
    from pyspark.sql import Window

    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select("event_id", "user_id", "ts", "value")
    own = events.withColumn("mean", F.avg("value").over(last))
    return own.select("event_id", T.time_remaining(F.col("mean"), F.col("event_id") % 5000).alias("eta"))


@register(
    "fn43_agg16_overviews",
    """+o AS (SELECT path || '.md' AS path, start_line, end_line, CASE WHEN name = 'The' OR start_line = 3 THEN 'Overview' ELSE name END AS name,
        CASE WHEN type < 20 THEN 80 ELSE 81 END AS type, row_number() OVER (PARTITION BY path ORDER BY start_line) AS k FROM s)
    SELECT path, min_by(start_line + 1, k)::INTEGER AS overview_start, min_by(end_line, k)::INTEGER AS overview_end FROM o WHERE k <= 2 AND name = 'Overview' GROUP BY path""",
    "f", "l", "s",
)
def overviews(spark, sf_dir):
    own = symbols(spark, sf_dir)
    name = F.when((F.col("name") == "The") | (F.col("start_line") == 3), "Overview").otherwise(F.col("name"))
    own = own.withColumns({"path": F.concat("path", F.lit(".md")), "name": name, "type": F.when(F.col("type") < 20, 80).otherwise(81)})
    return chunking.overviews(own)


@register("fn44_bloom_positions", "SELECT doc_id, list_sum(list_transform(range(10), lambda i: (('0x' || substr(h, 1, 8))::BIGINT + i * ('0x' || substr(h, 9, 8))::BIGINT) % 143776))::BIGINT AS position_sum FROM (SELECT doc_id, sha256(text) AS h FROM f)", "f")
def bloom_positions(spark, sf_dir):
    bits, hashes_ = T.bloom_shape(10_000, 0.001)
    at = T.bloom_positions(F.sha2("text", 256), bits, hashes_)
    return files(spark, sf_dir).select("doc_id", F.aggregate(at, F.lit(0).cast("long"), lambda s, x: s + x).alias("position_sum"))


@register(
    "pred13_pred14_pred17_line_predicates",
    r"""SELECT doc_id, line, regexp_matches(trim(t), '^$|^//|^\}[;,]?\s*(//.*)?$|^#endif|^#pragma once|^#(else|elif|ifdef|ifndef|if)\b') AS boilerplate, length(trim(t)) >= 75 AS long_enough
    FROM (SELECT doc_id, line, CASE line % 7 WHEN 0 THEN '}; // ' WHEN 1 THEN '#ifdef ' WHEN 2 THEN '// ' ELSE '' END || line_text AS t FROM l)""",
    "f", "l",
)
def line_predicates(spark, sf_dir):
    k = F.col("line") % 7
    text = T.trim(F.concat(F.when(k == 0, "}; // ").when(k == 1, "#ifdef ").when(k == 2, "// ").otherwise(""), "line_text"))
    return lines(spark, sf_dir).select("doc_id", "line", T.boilerplate_line(text).alias("boilerplate"), (F.length(text) >= 75).alias("long_enough"))


_MARKED = "CASE WHEN line % 7 = 0 THEN '# ' || line_text WHEN line % 3 = 0 THEN '## ' || line_text WHEN line % 11 IN (4, 6) THEN '```' ELSE line_text END"


def _marked(spark, sf_dir):
    k = F.col("line")
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("# "), "line_text")).when(k % 3 == 0, F.concat(F.lit("## "), "line_text")).when((k % 11).isin(4, 6), "```").otherwise(F.col("line_text"))
    )
    return lines(spark, sf_dir).select("path", "line", text.alias("line_text"))


@register(
    "udf4_win2_join19_sections",
    rf"""+m AS (SELECT path, line, {_MARKED} AS t FROM l),
    k AS (SELECT *, sum(starts_with(t, '```')::INTEGER) OVER (PARTITION BY path ORDER BY line) % 2 AS open FROM m),
    h AS (SELECT path, line, length(regexp_extract(t, '^(#+) ', 1)) AS level, trim(regexp_replace(t, '^#+ +', '')) AS name FROM k
          WHERE open = 0 AND regexp_matches(t, '^#{{1,2}} +.*[^ #]')),
    z AS (SELECT path, max(line) + 1 AS n FROM m GROUP BY path),
    e AS (SELECT h.*, lead(line) OVER w AS nxt, last_value(CASE WHEN level = 1 THEN name END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS top,
          coalesce(CASE WHEN level = 1 THEN min(CASE WHEN level = 1 THEN line END) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
            ELSE min(line) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END, n) AS stop
          FROM h JOIN z USING (path) WINDOW w AS (PARTITION BY path ORDER BY line)),
    x AS (SELECT e.path, e.line, e.level, e.name, e.top, e.nxt, max(m.line) + 1 AS last FROM e JOIN m ON m.path = e.path AND m.line >= e.line AND m.line < e.stop AND trim(m.t) <> '' GROUP BY ALL),
    y AS (SELECT *, CASE WHEN level = 1 AND nxt < last THEN nxt ELSE last END AS fin FROM x)
    SELECT path, line AS start_line, fin::INTEGER AS end_line, CASE WHEN level = 2 AND top IS NOT NULL THEN top || ' > ' || name ELSE name END AS breadcrumb FROM y
    WHERE EXISTS (SELECT 1 FROM m WHERE m.path = y.path AND m.line > y.line AND m.line < y.fin AND trim(m.t) <> '')""",
    "f", "l",
)
def sections(spark, sf_dir):
    """Sections of documents some of whose lines are made headings and code fences."""
    own = _marked(spark, sf_dir)
    return chunking.sections(chunking.headings(own), own)


@register("udf5_win1_chunks")
def plain_chunks(spark, sf_dir):
    """Greedy packing with overlap depends on where the last chunk ended: no SQL; tests hold it against the written-out rule."""
    return chunking.chunks_of(files(spark, sf_dir), plain=True).select("path", "start_line", "end_line", "sha256")


def _code(spark, sf_dir):
    """Documents as C++: of three lines, one begins a function, one is a comment, one ends the function."""
    body = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("int f"), i.cast("string"), F.lit("(int a) {"))).when(i % 3 == 1, F.concat(F.lit("// "), x)).otherwise("}"),
    )
    return _named(spark, sf_dir).select("path", F.array_join(body, "\n").alias("text"))


@register(
    "udf2_udf3_udf8_symbols",
    """SELECT path || CASE WHEN path LIKE '%/en/%' THEN '.cc' ELSE '.h' END AS path, CASE line % 3 WHEN 0 THEN 20 ELSE 60 END AS type,
    CASE line % 3 WHEN 0 THEN 'f' || line ELSE '' END AS name, line AS start_line, (CASE line % 3 WHEN 0 THEN least(line + 2, line_count - 1) ELSE line END)::INTEGER AS end_line
    FROM l WHERE line % 3 < 2 AND (path LIKE '%/en/%' OR path LIKE '%/de/%')""",
    "f", "l",
)
def parsed_symbols(spark, sf_dir):
    """The C++ scanner over made-up functions and comments; prose as Markdown or text has no symbols."""
    return chunking.symbols_of(_code(spark, sf_dir)).select("path", "type", "name", "start_line", "end_line")


@register("win4_agg13_structured_chunks")
def structured_chunks(spark, sf_dir):
    return chunking.distinct_chunks(chunking.chunks_of(_code(spark, sf_dir))).select("path", "start_line", "end_line", "sha256")
