import math
import random

import pytest

from tessarine.operators import lexical

SCHEMA = "file_path string, total_lines int, pattern_index int, frequency long, line_numbers array<int>"


def rank(spark, rows, n, **options):
    found = lexical.rank_matches(spark.createDataFrame(rows, SCHEMA), n, **options).collect()
    return {r.file_path: r for r in found}


def brute(rows, n, k1=1.2, b=0.15, w=0.5):
    df, files = {}, {}
    for path, total, p, tf, lines in rows:
        df[p] = df.get(p, 0) + 1
        files.setdefault(path, (total, []))[1].append((p, tf, set(lines)))
    idf = {p: math.log((n - d + 0.5) / (d + 0.5) + 1) for p, d in df.items()}
    mean = sum(t for t, _ in files.values()) / len(files)
    out = {}
    for path, (total, own) in files.items():
        score = sum(idf[p] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * total / mean)) for p, tf, _ in own)
        every = [x for *_, s in own for x in s]
        out[path] = score + w * sum(idf[p] for p, _, s in own for x in s if every.count(x) > 1)
    return out


def test_nothing(spark):
    assert rank(spark, [], 10) == {}


def test_frequency_rarity_and_length(spark):
    got = rank(spark, [("a", 100, 0, 2, [1, 2]), ("b", 100, 0, 20, list(range(20)))], 1000)
    assert got["b"].score > got["a"].score > 0
    rows = [("rare", 100, 0, 1, [1])] + [(f"c{k}", 100, 1, 1, [1]) for k in range(500)]
    got = rank(spark, rows, 1000)
    assert got["rare"].score > got["c0"].score
    rows = [("long", 5000, 0, 5, [1]), ("short", 50, 0, 5, [1])]
    got = rank(spark, rows, 1000)
    assert got["short"].score > got["long"].score
    got = rank(spark, rows, 1000, b=0.0)
    assert got["short"].score == pytest.approx(got["long"].score)


def test_shared_lines(spark):
    rows = [("near", 100, 0, 1, [10]), ("near", 100, 1, 1, [10]), ("far", 100, 0, 1, [10]), ("far", 100, 1, 1, [50])]
    got = rank(spark, rows, 1000)
    assert got["near"].score > got["far"].score and got["far"].line_numbers == [10, 50]
    assert rank(spark, rows, 1000, proximity=0.0)["near"].score == pytest.approx(rank(spark, rows, 1000, proximity=0.0)["far"].score)
    assert rank(spark, [("a", 9, 0, 3, [30, 10, 50]), ("a", 9, 1, 2, [10, 20])], 10)["a"].line_numbers == [10, 20, 30, 50]


def test_all_forms_against_brute_force(spark):
    rng = random.Random(3)
    rows = [
        (f"f{f}", 20 + f, p, rng.randrange(1, 9), sorted(rng.sample(range(20), rng.randrange(1, 6)))) for f in range(40) for p in range(4) if rng.random() < 0.6
    ]
    want = brute(rows, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    for how in (lexical.rank_matches, lexical.rank_lines):
        got = {r.file_path: r.score for r in how(df, 60).collect()}
        assert got == pytest.approx(want)


def test_search_over_files(spark):
    files = spark.createDataFrame([("a/x.cc", "the cat\nThe dog the end\nno"), ("b/y.h", "cat\n\ncat dog"), ("c/z.md", "bird"), ("d/n", None), ("e/e", "")], "path string, text string")
    got = [r.path for r in lexical.search(files, "the cat").collect()]
    assert set(got) == {"a/x.cc", "b/y.h"}
    assert [r.path for r in lexical.search(files, "cat", include="b/*").collect()] == ["b/y.h"]
    assert lexical.search(files, "cat", limit=1).count() == 1 and lexical.search(files, "cat", limit=-1).count() == 2
    assert lexical.search(files, "  ").count() == 0
    assert lexical.search(files, "T.e", is_regex=True).first().line_numbers == [1]
    text = lexical.with_text(lexical.search(files, "dog"), files).collect()
    assert {(r.path, r.line, r.line_text) for r in text} == {("a/x.cc", 1, "The dog the end"), ("b/y.h", 2, "cat dog")}
    assert lexical.totals(lexical.search(files, "cat")).first() == (2, 3)
