"""Scalar functions over paths, lines and texts, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessarine.functions.globs import glob_regex
from tessarine.schema import CALLABLE, CONTAINER, SYMBOL_TYPES

LANGUAGES = dict.fromkeys(("cc", "cpp", "h", "hpp"), "cpp") | {e: e for e in ("c", "go", "java")}
LANGUAGES |= {"cs": "csharp", "js": "javascript", "md": "markdown", "py": "python", "rs": "rust", "ts": "typescript"}
CPP_EXTENSIONS = tuple(f".{s}{end}" for s in "ch" for end in ("", s, "pp", "xx"))


def lines(text: Column) -> Column:
    """Lines of a text, cut at newlines only; a carriage return and a last empty line stay."""
    return F.split(text, "\n")


def trim_end(text: Column) -> Column:
    """Without white space of any kind at the end."""
    return F.regexp_replace(text, r"(?U)\s+$", "")


def trim(text: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# --- scrubbing ---


def blank_matches(text: Column, pattern: str) -> Column:
    """Every match of the pattern replaced by as many blanks; the pattern must not match nothing."""
    between = F.split(text, pattern, -1)
    matched = F.regexp_extract_all(text, F.lit(pattern), 0)
    pads = F.transform(matched, lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.array_join(F.zip_with(between, pads, lambda b, p: F.concat(b, F.coalesce(p, F.lit("")))), "")


def scrub(text: Column, path: Column, patterns: dict[str, list[str]]) -> Column:
    """The text scrubbed by every glob that matches its path, or NULL if nothing changed."""

    def bound(value: Column, use) -> Column:
        """use(value), with the value computed once however often it is used."""
        return F.transform(F.array(value), lambda t: use(t))[0]

    def blanked(glob: str, joined: str):
        return lambda t: F.when(path.rlike(glob_regex(glob)) & t.rlike(joined), blank_matches(t, joined)).otherwise(t)

    out = text
    for glob, own in patterns.items():
        if own:
            out = bound(out, blanked(glob, "|".join(f"(?:{p})" for p in own)))
    return bound(out, lambda t: F.when(t != text, t))


def scrub_map_error(patterns) -> str | None:
    """The first fault of a scrub map (glob -> list of Java regular expressions), None if it has none."""
    from pyspark.sql import SparkSession

    if not isinstance(patterns, dict):
        return None
    compile_ = SparkSession.active()._jvm.java.util.regex.Pattern.compile
    for glob, own in patterns.items():
        if not isinstance(own, list):
            return f"the value of {glob!r} must be a list of regular expressions"
        for p in own:
            if not isinstance(p, str):
                return f"a pattern of {glob!r} is no string: {p!r}"
            try:
                compile_(p)
            except Exception as error:
                return f"an invalid pattern of {glob!r}: {p!r}: {str(error).splitlines()[0]}"
        if own:
            try:
                compile_("|".join(f"(?:{p})" for p in own))
            except Exception as error:
                return f"the patterns of {glob!r} can't be combined: {str(error).splitlines()[0]}"
    return None


# --- hashes ---


def combined_hash(source: Column, scrubbed: Column) -> Column:
    """The source's hash, or where scrubbing changed it (scrubbed is not NULL) the hash of both hashes."""
    own = F.sha2(source, 256)
    return F.when(scrubbed.isNotNull(), F.sha2(F.concat(own, F.sha2(scrubbed, 256)), 256)).otherwise(own)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def _bucketed(path: Column, name: Column, folder: str, ending: str) -> Column:
    first = F.lower(F.substring(name, 1, 1))
    bucket = F.when(first.rlike("^[a-z]$"), first).otherwise("_")
    digest = F.upper(F.substring(F.sha2(path, 256), 1, 16))
    return F.concat_ws("/", F.lit(folder), bucket, F.concat(name, F.lit("."), digest, F.lit(ending)))


def index_path(path: Column, folder: str) -> Column:
    """Where a file's symbols are kept: a folder by first letter, the name, 16 hex digits of the path's hash."""
    return _bucketed(path, basename(path), folder, ".idx")


def output_path(path: Column, folder: str) -> Column:
    """Where the training samples of a group of files go; its name has no extension."""
    name = basename(path)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return _bucketed(path, stem, folder, ".jsonl")


def workspace_path(path: Column, root: str) -> Column:
    """The path below root with forward slashes, empty outside of it."""
    if not root:
        return F.lit("")
    top = root.rstrip("/\\")
    return F.when(path.startswith(top + "/") | path.startswith(top + "\\"), F.translate(F.substring(path, len(top) + 2, 1 << 30), "\\", "/")).otherwise("")


def path_key(path: Column) -> Column:
    return F.lower(path)


def group_key(path: Column) -> Column:
    """Directory and name without extension, lower case: a source file and its header share it."""
    return F.lower(F.regexp_replace(path, r"(?<=[^/\\])\.[^./\\]*$", ""))


def ensure_md(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".md"), name).otherwise(F.concat(name, F.lit(".md")))


def bloom_shape(entries: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter for so many entries at this false positive rate."""
    import math

    bits = math.ceil(-(entries * math.log(rate)) / math.log(2) ** 2)
    return bits, max(1, math.floor(bits / entries * math.log(2) + 0.5))


def bloom_positions(sha256: Column, bits: int, hashes: int) -> Column:
    """Bit positions of a hex digest by double hashing."""
    first, second = (F.conv(F.substring(sha256, k, 8), 16, 10).cast("long") for k in (1, 9))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (first + i * second) % F.lit(bits))


# --- symbols ---


def symbol_type_name(code: Column) -> Column:
    pairs = [F.lit(x) for pair in SYMBOL_TYPES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[code], F.lit("Unknown"))


def is_callable(code: Column) -> Column:
    return code.isin(*CALLABLE)


def is_container(code: Column) -> Column:
    return code.isin(*CONTAINER)


def parser_name(path: Column) -> Column:
    """Which parser takes a file: cpp, markdown or default."""
    ext = F.lower(F.regexp_extract(path, r"\.[^./\\]*$", 0))
    return F.when(ext.isin(*CPP_EXTENSIONS), "cpp").when(ext == ".md", "markdown").otherwise("default")


def signature(declaration: Column) -> Column:
    """White space collapsed, none inside of parentheses' ends."""
    one = F.regexp_replace(declaration, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(one, r"\(\s+", "("), r"\s+\)", ")"))


def cpp_prefix(path: Column, kind: Column, fqn: Column, sig: Column, chunk_no: Column) -> Column:
    """What stands before a C++ chunk; kind is NULL outside of containers."""
    named = F.when(kind.isNotNull(), F.concat(F.lit("\n// "), kind, F.lit(": "), fqn)).otherwise("")
    signed = F.when(
        (chunk_no > 0) & kind.isin("Function", "Method", "Constructor", "Destructor", "Prototype") & (F.coalesce(sig, F.lit("")) != ""),
        F.concat(F.lit("\n// signature: "), sig),
    ).otherwise("")
    return F.concat(F.lit("// file: "), path, named, signed, F.lit("\n\n"))


def markdown_prefix(path: Column, breadcrumb: Column) -> Column:
    section = F.when(breadcrumb.isNotNull(), F.concat(F.lit("\nsection: "), breadcrumb)).otherwise("")
    return F.concat(F.lit("---\nfile: "), path, section, F.lit("\n---\n\n"))


def boilerplate_line(line: Column) -> Column:
    """Whether a trimmed line of C or C++ says nothing: blank, comment, brace, conditional."""
    return line.rlike(r"^$|^//|^\}[;,]?\s*(//.*)?$|^#endif|^#pragma once|^#(el(se|if)|if(n?def)?)\b")


def cpp_boilerplate(text: Column) -> Column:
    """Whether a chunk of at most 200 characters has only such lines."""
    return (F.length(text) <= 200) & F.forall(F.split(text, "\n"), lambda x: boilerplate_line(trim(x)))


def code_block(text: Column, path: Column) -> Column:
    """A fenced block with the language of the path's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    language = F.coalesce(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[ext], F.lit(""))
    return F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```"))


# --- paths and links in lines ---

_STOP = r"\s\"'<>,;`)"
_PATH_STOP = r"\s\"'<>|,;`()"
PATH_PATTERNS = {
    "url": rf"https?://[^{_STOP}]+",
    "file_uri": rf"file:///[^{_STOP}]+",
    "drive": rf"[a-zA-Z]:[/\\][^{_PATH_STOP}]+",
    "unc": rf"\\\\[^{_PATH_STOP}]+",
    "absolute": rf"(?<![:\w/])/[^{_PATH_STOP}]+",
    "dotted": rf"[.]{{1,2}}[/\\][^{_PATH_STOP}]+",
    "relative": r"[\w.-]+[/\\][\w./\\-]+",
    "name": r"[\w-][\w.-]*\.\w{1,10}",
}


def path_matches(line: Column, kind: str) -> Column:
    return F.regexp_extract_all(line, F.lit(PATH_PATTERNS[kind]), 0)


def first_path(line: Column) -> Column:
    """The first match of the first kind of path that a line has, as struct(kind, path), NULL without one."""
    tries = [F.when(F.size(path_matches(line, k)) > 0, F.struct(F.lit(k).alias("kind"), path_matches(line, k)[0].alias("path"))) for k in PATH_PATTERNS]
    return F.coalesce(*tries)


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[\]})!?.,:;]+$", "")


def is_url(text: Column) -> Column:
    return text.rlike("(?i)^https?://")


_N = "([0-9]+)"
_SUFFIXES = ((f"^(.+):{_N}:{_N}$", 3), (f"^(..+):{_N}$", 2), (f"^(.+)[(]{_N}(?:,[ \\t]*{_N})?[)]$", 3), (f"^(.+)#L{_N}(?:-L{_N})?$", 2))


def line_column(path: Column) -> Column:
    """struct(path, line, column) of ``p:l:c``, ``p:l``, ``p(l)``, ``p(l,c)`` and ``p#Ll``, NULL for others."""
    number = lambda p, g: F.expr("NULL").cast("int") if g is None else F.try_to_number(F.regexp_extract(path, p, g), F.lit("9999999999")).cast("int")
    out = None
    for pattern, groups in _SUFFIXES:
        found = F.struct(
            F.regexp_extract(path, pattern, 1).alias("path"), number(pattern, 2).alias("line"), number(pattern, 3 if groups == 3 else None).alias("column")
        )
        out = F.when(path.rlike(pattern), found) if out is None else out.when(path.rlike(pattern), found)
    return out


def peek_suffix(rest: Column) -> Column:
    """The line and column suffix that a text begins with, empty without one."""
    return F.regexp_extract(rest, r"^(:[0-9]+(:[0-9]+)?|[(][0-9]+(,[ \t]*[0-9]+)?[)]|#L[0-9]+(-L[0-9]+)?)", 0)


def signature_end(code: Column) -> Column:
    """Characters up to the first ``{`` or ``;`` outside of braces, its own included; the first line's length without one.

    ``code`` begins where the name does.
    """
    step = F.aggregate(
        F.split(code, ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("found")),
        lambda s, c: F.struct(
            (s["at"] + 1).alias("at"),
            F.when(c == "{", s["depth"] + 1).when(c == "}", s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            F.when((s["found"] == 0) & (s["depth"] == 0) & c.isin("{", ";"), s["at"] + 1).otherwise(s["found"]).alias("found"),
        ),
        lambda s: s["found"],
    )
    return F.when(step > 0, step).otherwise(F.length(F.split(code, "\n")[0]))


# --- model texts and output ---


def json_payload(response: Column) -> Column:
    """The JSON text in a model's answer: after the start marker, without code fences."""
    text = trim(response)
    mark = "===JSON_START==="
    text = F.when(F.instr(text, mark) > 0, trim(F.regexp_replace(text, rf"(?s)^.*?{mark}", ""))).otherwise(text)
    fenced = F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)```", 1)
    return F.when(text.rlike(r"(?s)^```[^\n]*\n.*```"), trim(fenced)).otherwise(text)


def result_marker(index: Column) -> Column:
    """The mark of the i-th result: RESULT_ and three digits of 3 i."""
    return F.concat(F.lit("RESULT_"), F.lpad((index * 3).cast("string"), 3, "0"))


def marked_results(response: Column) -> Column:
    """Indexes of the results that an answer names, in its order, each once."""
    numbers = F.transform(F.regexp_extract_all(response, F.lit(r"RESULT_(\d+)"), 1), lambda x: x.cast("int"))
    return F.transform(F.array_distinct(F.filter(numbers, lambda n: n % 3 == 0)), lambda n: (n / 3).cast("int"))


def numbered_file(path: Column, text: Column) -> Column:
    """A file's block in a prompt: a heading and its lines with their numbers."""
    numbered = F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")
    return F.concat(F.lit("## File: "), path, F.lit("\n\n```\n"), numbered, F.lit("\n```"))


def encode_component(text: Column) -> Column:
    """Percent-encoding that leaves letters, digits and ``-_.!~*'()`` as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def search_url(template: str, query: Column) -> Column:
    """A URL template with its first {query} filled in."""
    head, mark, tail = template.partition("{query}")
    return F.concat(F.lit(head), encode_component(query), F.lit(tail)) if mark else F.lit(template)


def breakpoint(module: Column, path: Column, line: Column) -> Column:
    """A debugger's source line breakpoint, of a line that counts from 0."""
    doubled = F.replace(F.translate(path, "/", "\\"), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("`"), module, F.lit("!"), doubled, F.lit(":"), (line + 1).cast("string"), F.lit("`"))


def score_text(score: Column) -> Column:
    return F.format_string("%.4f", score)


def time_remaining(mean_ms: Column, batches: Column) -> Column:
    """An estimate as text, of the mean duration and the number of batches left."""
    total = F.ceil(mean_ms * batches / 1000)
    minutes = F.floor(total / 60)
    text = F.when(minutes > 0, F.concat(F.lit(" (~"), minutes.cast("string"), F.lit("m remaining)")))
    text = text.otherwise(F.concat(F.lit(" (~"), (total % 60).cast("string"), F.lit("s remaining)")))
    return F.when((batches > 0) & mean_ms.isNotNull(), text).otherwise("")
