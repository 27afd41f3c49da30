import hashlib

import numpy as np
import pytest

from tessarine.operators import chunking, parsers

CPP, MD = parsers.CppParser(), parsers.MarkdownParser()


def brief(found, *kinds):
    return [(s["type"], s["name"], s["start_line"], s["start_column"], s["end_line"], s["end_column"]) for s in found if not kinds or s["type"] in kinds]


@pytest.mark.parametrize(
    "text, want",
    [
        ("\nnamespace media {\nnamespace win {\nint x;\n}\n}\n", [(1, "media", 1, 0, 5, 1), (1, "win", 2, 0, 4, 1)]),
        ("namespace {\n}", [(1, "(anonymous namespace)", 0, 0, 1, 1)]),
        ("namespace a::b {\n}", [(1, "a::b", 0, 0, 1, 1)]),
        ("\nTEST_F(Foo, Bar) {\n  go();\n}\n", [(20, "TEST_F", 1, 0, 3, 1)]),
        ("class Foo;", [(2, "Foo", 0, 0, 0, 9)]),
        ("class EXPORT_ME Foo final : public A, B<C> {\n};", [(2, "Foo", 0, 0, 1, 1)]),
        ("struct {\n int a;\n} v;", [(3, "", 0, 0, 2, 1)]),
        ("union U { int a; float b; };", [(4, "U", 0, 0, 0, 27)]),
        ("enum class E : int { A, B };", [(5, "E", 0, 0, 0, 27)]),
        ("int* f(int x) {\n  return g(x);\n}", [(20, "f", 0, 0, 2, 1)]),
        ("auto f(int x) -> std::vector<int> {\n}", [(20, "f", 0, 0, 1, 1)]),
        ("int a = f(3);\nint b[] = {1, 2};\nusing X = int(int);\n", []),
        ("if (x) { y(); }", []),
        ('const char* s = "class X { void f() {} };";', []),
        ("#define F(x) \\\n  void x() {}\n#include <a/b.h>\n", [(61, "F", 0, 0, 1, 13), (40, "", 2, 0, 2, 16)]),
        ("bool operator==(const A& a, const A& b) {\n}", [(20, "operator==", 0, 0, 1, 1)]),
    ],
)
def test_cpp_symbols(text, want):
    assert brief(CPP.symbols(text)) == want


def test_cpp_members():
    text = "class P : B {\n public:\n  P() : a_(1), b_{2} { go(); }\n  explicit P(int a);\n  ~P() {}\n  P(const P&) = delete;\n  virtual int* get(int a) const = 0;\n  static void run() { auto f = [](int x) { return x; }; }\n  int a_ = make(1);\n};\n"
    got = [(s["type"], s["fully_qualified_name"], s["signature"]) for s in CPP.symbols(text)]
    assert got == [
        (2, "P", None), (22, "P::P", "P()"), (24, "P::P", "explicit P(int a)"), (23, "P::~P", "~P()"), (22, "P::P", "P(const P&)"),
        (24, "P::get", "virtual int* get(int a) const"), (21, "P::run", "static void run()"),
    ]


def test_cpp_out_of_line():
    text = "namespace n {\nvoid A::B::f(int x) const {\n}\nA::A(int a)\n    : a_(a), b_{a} {\n  go();\n}\nA::~A() {}\nstatic\nint\ng( int a,\n   int b );\n}\n"
    got = [(s["type"], s["name"], s["fully_qualified_name"], s["signature"], s["start_line"], s["end_line"]) for s in CPP.symbols(text)[1:]]
    assert got == [
        (20, "f", "n::A::B::f", "void A::B::f(int x) const", 1, 2), (22, "A", "n::A::A", "A::A(int a)", 3, 6), (23, "~A", "n::A::~A", "A::~A()", 7, 7), (24, "g", "n::g", "static int g(int a, int b)", 8, 11),
    ]


def test_cpp_comments_merge():
    text = "// a\n// b\n  // c\nint x; // d\n// e\n/* f\n g */\n"
    assert [(s["start_line"], s["end_line"]) for s in CPP.symbols(text)] == [(0, 1), (2, 2), (3, 3), (4, 4), (5, 6)]


def test_any_text_parses():
    for text in ("", "{", "}}}", "((((", "class", "namespace", '"', "/*", "R\"(", "template<", "#include", "operator()(", "a::~", "::", "enum {", "é{ü}(ß);"):
        CPP.symbols(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("# Overview", [(80, "Overview", 0, 0, 0, 10)]),
        ("# A\n\nbody of line.\n", [(80, "A", 0, 0, 2, 13)]),
        ("### x\n#### y", []),
        ("# A\n## B\nx\n### C\ny\n\n# D\n## E\nz", [(80, "A", 0, 0, 4, 1), (81, "B", 1, 0, 4, 1), (80, "D", 6, 0, 8, 1), (81, "E", 7, 0, 8, 1)]),
        ("```\n# no\n```\n~~~ x\n# no\n```\n~~~\n# yes #", [(80, "yes", 7, 0, 7, 7)]),
        ("#no\n#\n   ## ok", [(81, "ok", 2, 3, 2, 8)]),
        ("## 😀 b\n", [(81, "😀 b", 0, 0, 0, 7)]),
    ],
)
def test_markdown_symbols(text, want):
    assert brief(MD.symbols(text)) == want


def ranges(parser, text, path="p"):
    lines = text.split("\n")
    return [(a + 1, b) for a, b, _ in parser.chunks(lines, parser.symbols(text), path)]


WORDS = "some words that fill a line of this section well enough to count as a chunk of text"


def test_markdown_chunks():
    text = f"{WORDS}\n\n# Api\n\n{WORDS}\n\n## Methods\n{WORDS}\n\n# Empty\n## Real\n{WORDS}\n"
    chunks = MD.chunks(text.split("\n"), MD.symbols(text), "d/a.md")
    assert [(a + 1, b) for a, b, _ in chunks] == [(1, 1), (3, 5), (7, 8), (10, 12)] or [(a + 1, b) for a, b, _ in chunks] == [(1, 1), (3, 5), (7, 8), (11, 12)]
    heads = [t.split("---\n\n")[0] for *_, t in chunks]
    assert heads[0] == "---\nfile: d/a.md\n" and heads[1].endswith("section: Api\n") and heads[2].endswith("section: Api > Methods\n") and heads[3].endswith("section: Empty > Real\n")


def test_cpp_chunks():
    body = "\n".join(f"  int value_{k} = compute_something({k});" for k in range(200))
    text = f"// Copyright\n#include <a>\n\n// about the thing\nvoid thing(int a) {{\n{body}\n}}\n\n// Forward declarations of what comes\nvoid foo();\nint bar(int x, int y, int z);\nclass Baz {{\n{body}\n}};\n"
    lines = text.split("\n")
    chunks = CPP.chunks(lines, CPP.symbols(text), "a.cc")
    assert chunks[0][0] == 3 and chunks[0][2].startswith("// file: a.cc\n// Function: thing\n\n// about")
    inside = [t for a, b, t in chunks if "// Function: thing" in t]
    assert len(inside) >= 2 and all("// signature: void thing(int a)" in t for t in inside[1:]) and "// signature" not in inside[0]
    assert not any("Copyright" in t for *_, t in chunks)
    assert ranges(CPP, "#include <a>\n#include <b>\n") == []


def written_out(lines):
    """The packing rule once more, in the plainest form."""
    out, at = [], 0
    while at < len(lines):
        end = at + 1
        while end < len(lines) and sum(len(x) + 1 for x in lines[at : end + 1]) <= 3584:
            end += 1
        part = list(range(at, end))
        while part and not lines[part[0]].strip():
            part.pop(0)
        while part and not lines[part[-1]].strip():
            part.pop()
        if part and len("\n".join(lines[k] for k in part).strip()) >= 75:
            out.append((part[0], part[-1] + 1))
        if end == len(lines):
            return out
        at = max(end - 8, at + 1)
    return out


def test_packing(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        lines = r.text.split("\n")
        assert [(a, b) for a, b, _ in parsers.pack(lines, 0, len(lines))] == written_out(lines)
    assert parsers.pack(["x" * 9000, "y" * 80], 0, 2)[0][:2] == (0, 1)


def test_chunks_of_files(spark):
    files = spark.createDataFrame([("a.md", f"# T\n{WORDS}\n"), ("b.txt", f"{WORDS}\n\n"), ("c.cc", None), ("d.h", "")], "path string, text string")
    got = {r.path: r for r in chunking.chunks_of(files).collect()}
    assert set(got) == {"a.md", "b.txt"} and (got["a.md"].start_line, got["a.md"].end_line) == (1, 2) and got["b.txt"].text == WORDS
    assert got["b.txt"].sha256 == hashlib.sha256(WORDS.encode()).hexdigest()
    twice = chunking.chunks_of(files).union(chunking.chunks_of(files))
    assert chunking.distinct_chunks(twice).count() == 2
    assert chunking.symbols_of(files).count() == 1


def test_headings_as_columns_agree(spark):
    text = f"intro\n# A\n{WORDS}\n## B\n\n```\n# x\n```\n## C #\ny\n\n\n# D\n# E\nz\n"
    lines = spark.createDataFrame([("p", k, x) for k, x in enumerate(text.split("\n"))], "path string, line int, line_text string")
    got = sorted((r.start_line, r.end_line, r.breadcrumb) for r in chunking.sections(chunking.headings(lines), lines).collect())
    assert got == MD.sections(text.split("\n"), MD.symbols(text))


def test_chunks_in_small_slices(spark, monkeypatch):
    """Texts go to Python and chunks come back in runs of bounded size, in whatever cut."""
    assert list(chunking._slices(np.array([3, 4, 20, 0, 1]))) == [(0, 5)] and list(chunking._slices(np.array([], int))) == []
    monkeypatch.setattr(chunking, "SLICE", 7)
    assert list(chunking._slices(np.array([3, 4, 20, 0, 1, 6, 9]))) == [(0, 2), (2, 3), (3, 6), (6, 7)]
    texts = {k: None if k % 5 == 0 else "\n".join(f"{k} line {n} of a text that is long enough" for n in range(k * 9)) for k in range(1, 30)}
    files = spark.createDataFrame(list(texts.items()), "path long, text string")
    want = {(k, a + 1, b, x) for k, t in texts.items() if t is not None for a, b, x in parsers.DEFAULT.chunks(t.split("\n"), [], str(k)) if b > a}
    assert {(r.path, r.start_line, r.end_line, r.text) for r in chunking.chunks_of(files).collect()} == want
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
