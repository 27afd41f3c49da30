import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessarine.functions import globs, terms


def matches(pattern, text):
    return re.search(pattern.replace("(?md:^)", "(?m:^)"), text) is not None


CASES = [
    ("Get*Configs", ["GetSupportedConfigs", "GetConfigs"], ["SetConfigs"]),
    ("foo*bar", ["foobar", "foo x bar"], ["foo\nbar"]),
    ("D3D1?", ["D3D11", "D3D12"], ["D3D1", "D3D1\n"]),
    ("void*test(int*)", ["void foo_test(int* ptr)"], ["int*test(void*)"]),
    ("(int)", ["(int)"], ["int"]),
    ("off", ["turn off the light"], ["offset", "turnoff", "_off"]),
    ("hdr*", ["hdr10", "hdr_metadata"], ["thdr"]),
    ("*hdr", ["thdr", "a\nhdr"], ["hdr10"]),
    ("->Create", ["ptr->Create(args)"], ["ptr->CreateAndDestroy()"]),
    ("prefix(A|B)", ["prefix(A|B)"], ["prefixA"]),
    ("a.b+c", ["a.b+c"], ["axbbc"]),
    ("[x]^$\\", ["[x]^$\\"], ["x"]),
]


@pytest.mark.parametrize("engine", ["java", "re2"])
@pytest.mark.parametrize("query, yes, no", CASES)
def test_single_terms(engine, query, yes, no):
    [pattern] = terms.patterns(query, engine)
    assert all(matches(pattern, t) for t in yes) and not any(matches(pattern, t) for t in no)


@pytest.mark.parametrize(
    "query, want",
    [
        ("", []), ("   ", []), ("\t\t", []), ("a  b\tc", [("a",), ("b",), ("c",)]), ("(x|y) z", [("x", "y"), ("z",)]), ("( x | y z )", [("x", "y z")]), ("(|) foo", [("foo",)]),
        ("(unclosed foo", [("(unclosed foo",)]), ("(A|B)(C|D)", [("A", "B"), ("C", "D")]), ("(plain)rest", [("(plain)",), ("rest",)]), ("a(b", [("a(b",)]), ("((a|b) c", [("(a", "b"), ("c",)]),
    ],
)
def test_tokens(query, want):
    assert terms.tokens(query.strip()) == want


def test_other_modes():
    assert terms.search_patterns(" a.*b ", is_regex=True) == ["a.*b"] and terms.search_patterns(" ", is_regex=True) == []
    assert terms.search_patterns("x (a|b)", engine="re2") == [r"(?i)\bx\b", r"(?i)(?:\ba\b|\bb\b)"]
    assert terms.any_pattern("", "re2") == "" and terms.any_pattern("a b", "re2") == r"\ba\b|\bb\b" and terms.all_patterns("a b*", "re2") == [r"\ba\b", r"\bb[^\n]*"]
    assert re.search(terms.line_glob("f?o*bar"), "xfoo bar") and not re.search(terms.line_glob("a.b"), "axb")


@given(st.text(alphabet="ab_1 (|)*?.\\[]{}+^$\t-", max_size=20))
def test_any_query_compiles_in_both_dialects(query):
    for engine in ("java", "re2"):
        for p in terms.patterns(query, engine):
            re.compile(p.replace("(?md:^)", "(?m:^)"))


@given(st.text(alphabet="ab1.-+", min_size=1, max_size=8))
def test_a_term_matches_itself_between_blanks(term):
    assert matches(terms.patterns(term)[0], f" {term} ")


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("**/*.h", ["a.h", "d:/src/foo.h", "x\\y.h"], ["a.hpp", "a.cc"]),
        ("**/*.{h,cc,cpp}", ["a/b.cc", "b.cpp"], ["b.c", "b.hpp", "b.md"]),
        ("src/*/x", ["src/a/x"], ["src/a/b/x", "src/x"]),
        ("src/**", ["src/a", "src/a/b"], ["osrc/a"]),
        ("a?[bc][!d].txt", ["axbe.txt"], ["axbd.txt", "a/be.txt"]),
        ("a+b(c)", ["a+b(c)"], ["aab(c)"]),
    ],
)
def test_path_globs(glob, yes, no):
    r = re.compile(globs.glob_regex(glob))
    assert all(r.search(p) for p in yes) and not any(r.search(p) for p in no)


def test_directories():
    assert globs.outermost(["/a/b", "/a", "/ab", "/A/c", "/d/"]) == ["/a", "/ab", "/d"]
    assert globs.include_dirs([], ["/w"], "/kb") == ["/kb", "/w"] and globs.include_dirs(["/x"], ["/w"], "/x/kb") == ["/x"]
    assert globs.split_globs(" a, ,b ") == ["a", "b"] and globs.split_globs(None) == []


def test_membership(spark):
    from pyspark.sql import functions as F

    paths = ["/r/chrome/a.CC", "/r/chromeos/a.cc", "/r/chrome/out/a.cc", "/r/chrome/a.py", "/r/chrome/.cc"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    keep = df.where(globs.member(F.col("path"), [".cc"], ["/R/chrome"], ["**/out/**"]))
    assert [r.path for r in keep.collect()] == ["/r/chrome/a.CC"]


def test_boundaries_of_a_regular_expression(spark):
    """As in RE2 and JavaScript: letters beyond ASCII end a word."""
    cases = [r"T[a-h]+e[nr]\b", r"\bne", r"e\Bn", r"n\B", r"[\]b]e\b", r"\\b", r"(?:\b|x)n\b", r"\b"]
    texts = ["Taten", "Tatenü", "üTaten", "ünen", "Tater\u0301", "ene", "be", "beé", "a\\b", "né n", "", "ü", "xnß", "n_"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for c in cases:
        [pattern] = terms.search_patterns(c, is_regex=True)
        assert [r.t for r in df.where(F.col("t").rlike(pattern)).collect()] == [t for t in texts if re.search(c, t, re.A)], c
    assert terms.search_patterns(r"a\b", is_regex=True, engine="re2") == [r"a\b"]
    assert terms.search_patterns(r"\Q\b\E[\b&&[a]]", is_regex=True) == [r"\Q\b\E[\b&&[a]]"]
