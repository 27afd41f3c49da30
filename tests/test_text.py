import base64
import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tessarine.functions import text as T
from tessarine.functions import vectors as V
from tessarine.operators import references


def one(spark, expr, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], (str, type(None))) else 'int'}" for n in names)).select(expr.alias("x")).first().x


def scrub(spark, patterns, path, source):
    return one(spark, T.scrub(F.col("t"), F.col("p"), patterns), t=source, p=path)


@pytest.mark.parametrize(
    "patterns, path, source, want",
    [
        ({"**/*.h": [r"\bBASE_EXPORT\b"]}, "d:/src/foo.h", "class BASE_EXPORT Foo {", "class             Foo {"),
        ({"**/*.h": ["a|b", "c|d"]}, "x.h", "a b c d e", "        e"),
        ({"**/*.{h,cc,cpp}": [r"\bEXPORT\b"]}, "x.md", "EXPORT", None),
        ({"**/*.h": [r"(?<=\bclass\s{1,9})M\w+_EXPORT(?=\s)"]}, "x.h", "class MX_EXPORT Foo", "class" + 11 * " " + "Foo"),
        ({"**/*.h": [r"(?<=\bclass\s{1,9})M\w+_EXPORT"]}, "x.h", "void MX_EXPORT foo();", None),
        ({"**/*.h": ["x"], "**/foo.*": ["y"]}, "a/foo.h", "xyz", "  z"),
        ({"**/*.h": []}, "a.h", "x", None),
    ],
)
def test_scrub(spark, patterns, path, source, want):
    got = scrub(spark, patterns, path, source)
    assert got == want and (got is None or len(got) == len(source))


def test_scrub_map(spark):
    assert T.scrub_map_error({"**": ["a", "(?<=x)b"]}) is None and T.scrub_map_error(None) is None
    assert "list" in T.scrub_map_error({"**": "a"}) and "no string" in T.scrub_map_error({"**": [1]}) and "invalid" in T.scrub_map_error({"**": ["("]})


def test_hashes_and_paths(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert one(spark, T.combined_hash(F.col("a"), F.col("b")), a="x", b=None) == sha("x")
    assert one(spark, T.combined_hash(F.col("a"), F.col("b")), a="x", b="y") == sha(sha("x") + sha("y"))
    assert one(spark, T.index_path(F.col("p"), "c"), p="/a/Foo.cc") == f"c/f/Foo.cc.{sha('/a/Foo.cc')[:16].upper()}.idx"
    assert one(spark, T.output_path(F.col("p"), "c"), p="/a/9.b.cc") == f"c/_/9.b.{sha('/a/9.b.cc')[:16].upper()}.jsonl"
    assert one(spark, T.workspace_path(F.col("p"), "/w"), p="/w/a\\b") == "a/b" and one(spark, T.workspace_path(F.col("p"), "/w"), p="/wx/a") == ""
    assert one(spark, T.group_key(F.col("p")), p="/A.d/Foo_x.Cc") == "/a.d/foo_x" and one(spark, T.group_key(F.col("p")), p="/a/.git") == "/a/.git"
    assert T.bloom_shape(10_000_000, 0.001) == (143_775_876, 10)


@pytest.mark.parametrize(
    "text, want",
    [
        ("a/b.cc:42:7", ("a/b.cc", 42, 7)), ("a/b.cc:42", ("a/b.cc", 42, None)), ("C:1", None), ("b.cc(3)", ("b.cc", 3, None)), ("b.cc(3, 4)", ("b.cc", 3, 4)), ("b.cc#L9", ("b.cc", 9, None)),
        ("b.cc#L9-L12", ("b.cc", 9, None)), ("b.cc", None), ("a:1:2:3", ("a:1", 2, 3)),
    ],
)
def test_line_column(spark, text, want):
    got = one(spark, T.line_column(F.col("t")), t=text)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    "line, kind, path",
    [
        ("see https://a.b/c?d=1, ok", "url", "https://a.b/c?d=1"), ("at file:///c/x.h;", "file_uri", "file:///c/x.h"), (r"in C:\x\y.cc now", "drive", r"C:\x\y.cc"), (r"on \\srv\a b", "unc", r"\\srv\a"),
        ("run /usr/bin/x", "absolute", "/usr/bin/x"), (r"cd ..\a\b", "dotted", r"..\a\b"), ("edit src/a.cc please", "relative", "src/a.cc"), ("edit a-b.cc please", "name", "a-b.cc"), ("nothing here", None, None),
    ],
)
def test_first_path(spark, line, kind, path):
    got = one(spark, T.first_path(F.col("t")), t=line)
    assert (got.kind, got.path) == (kind, path) if kind else got is None


def test_small_ones(spark):
    assert one(spark, T.strip_punctuation(F.col("t")), t="a.b).,;") == "a.b" and one(spark, T.peek_suffix(F.col("t")), t="(4, 5) x") == "(4, 5)"
    assert one(spark, T.signature(F.col("t")), t=" void  f( int a,\n  int b ) const ") == "void f(int a, int b) const"
    assert one(spark, T.json_payload(F.col("t")), t='x ===JSON_START===\n```json\n[1]\n```') == "[1]" and one(spark, T.json_payload(F.col("t")), t=" {} ") == "{}"
    assert one(spark, T.marked_results(F.col("t")), t='["RESULT_012", "RESULT_003", "RESULT_012", "RESULT_004"]') == [4, 1]
    assert one(spark, T.signature_end(F.col("t")), t="f(a) {") == 6 and one(spark, T.signature_end(F.col("t")), t="f(a\n b);x") == 8 and one(spark, T.signature_end(F.col("t")), t="abc\nde") == 3
    assert one(spark, T.trim_end(F.col("t")), t="a b\u00a0\t\r") == "a b"
    assert one(spark, T.ensure_md(F.col("t")), t="x.MD") == "x.MD" and one(spark, T.ensure_md(F.col("t")), t="x") == "x.md"
    assert one(spark, T.breakpoint(F.lit("m"), F.col("t"), F.lit(4)), t="a/b") == r"`m!a\\b:5`"
    assert one(spark, T.encode_component(F.col("t")), t="a b&*'()!~é") == "a%20b%26*'()!~%C3%A9"
    assert one(spark, T.cpp_boilerplate(F.col("t")), t="} // x\n#endif\n\n// y") and not one(spark, T.cpp_boilerplate(F.col("t")), t="} x")
    assert one(spark, T.time_remaining(F.col("a"), F.col("b")), a=61_000, b=2) == " (~2m remaining)" and one(spark, T.time_remaining(F.col("a"), F.col("b")), a=900, b=2) == " (~2s remaining)"
    assert one(spark, T.code_block(F.col("t"), F.lit("a/x.PY")), t="1") == "```python\n1\n```"
    assert one(spark, F.size(T.lines(F.col("t"))), t="") == 1 and one(spark, T.lines(F.col("t")), t="a\r\nb\n") == ["a\r", "b", ""]


def test_delimited():
    assert references.delimited('x "C:/My Files/a.txt" y', 8) == "C:/My Files/a.txt"
    assert references.delimited("f(a[bc]d)", 5) == "bc" and references.delimited("f(a)b", 5) is None and references.delimited("(a) b (c)", 4) is None


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [r.d for r in df.select(V.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(1) and got[2:] == [None, None]
    text = base64.b64encode(struct.pack("<2f", 1.5, -2.0)).decode()
    row = df.limit(1).select(V.from_base64(F.lit(text)).alias("v"), V.to_base64(F.array(F.lit(1.5), F.lit(-2.0)).cast("array<float>")).alias("t")).first()
    assert row.v == [1.5, -2.0] and row.t == text
