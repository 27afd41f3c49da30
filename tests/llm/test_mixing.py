import hashlib
from collections import Counter
from fractions import Fraction
from math import floor

import pytest

from tessarine.llm import _run, mixing
from tests.llm import cases


def brute(rows, weights=None, budget=1_000_000, seed=17, blocks=1024):
    """Counter of (doc_id, source, n_chars) -> copies, by one running sum of fractions for each source."""
    key = lambda s: "n" if s is None else f"s{s}"
    by = {}
    for doc_id, source, n in rows:
        by.setdefault(key(source), []).append((doc_id, source, n))
    chars = {k: sum(max(n or 0, 0) for *_, n in v) for k, v in by.items()}
    chars = {k: v for k, v in chars.items() if v}
    weight = {k: 1 if weights is None else {key(s): w for s, w in weights.items()}.get(k, 0) for k in chars}
    out = Counter()
    for k in chars:
        each = Fraction(sum(chars.values()) * budget * weight[k], sum(weight.values()) * chars[k] * 1_000_000) if sum(weight.values()) else 0
        at = Fraction(int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16) % 1_000_000, 1_000_000)
        for row in sorted(by[k], key=lambda r: ((r[0] or 0) % blocks, r[0] is not None, r[0] or 0, r[2] is not None, r[2] or 0)):
            step = each if (row[2] or 0) > 0 else 0
            out[row] += floor(at + step) - floor(at)
            at += step
    return Counter({k: v for k, v in out.items() if v})


ROWS = [(k * 37 % 4001, f"s{k % 5 if k % 3 else 0}", (k * k) % 900) for k in range(600)] + [(None, "s1", 10), (5, None, 70), (6, None, None), (7, "s2", -3), (8, "s1", 50), (8, "s1", 50)]


@pytest.mark.parametrize("weights, blocks", [(None, 1024), (None, 7), ({"s0": 5, "s1": 1, None: 2}, 16), ({"absent": 1}, 4)])
def test_against_brute_force(spark, weights, blocks):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, n_chars long").repartition(5)
    got = Counter((r.doc_id, r.source, r.n_chars) for r in mixing.mix(docs, weights, blocks=blocks).collect())
    assert got == brute(ROWS, weights, blocks=blocks)


def test_source_totals_are_within_one(spark):
    docs = spark.createDataFrame([(k, "a" if k % 10 else "b", 100) for k in range(1000)], "doc_id long, source string, n_chars long")
    got = Counter(r.source for r in mixing.mix(docs, {"a": 3, "b": 1}).collect())
    assert abs(got["a"] - 750) <= 1 and abs(got["b"] - 250) <= 1


def test_copies_are_numbered(spark):
    docs = spark.createDataFrame([(1, "a", 10), (2, "b", 1000)], "doc_id long, source string, n_chars long")
    copies = sorted(r.copy for r in mixing.mix(docs).collect() if r.doc_id == 1)
    assert copies == list(range(1, len(copies) + 1)) and len(copies) in (50, 51)


def test_awkward_and_empty(spark):
    docs = cases.awkward(spark)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy_"]
    got = Counter((r.doc_id, r.source, r.n_chars) for r in out.collect())
    assert got == brute([(r.doc_id, r.source, r.n_chars) for r in docs.collect()])
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_totals_of_many_rows_are_exact(spark):
    """A third of a million rows, and rates below a millionth: whole totals are within one."""
    docs = spark.range(1_200_000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "10L AS n_chars")
    got = {r.source: r["count"] for r in mixing.mix(docs, {"s0": 1, "s1": 3, "s2": 5}).groupBy("source").count().collect()}
    want = {"s0": 1_200_000 / 9, "s1": 400_000, "s2": 1_200_000 * 5 / 9}
    assert all(abs(got[k] - n) <= 1 for k, n in want.items())
    few = {r.source: r["count"] for r in mixing.mix(docs.where("doc_id < 600000"), {"s0": 1, "s1": 9_999_999}, budget_millionths=100_000).groupBy("source").count().collect()}
    assert abs(few["s1"] - 60_000) <= 1 and few.get("s0", 0) <= 1


def test_blocks_and_joins_do_not_change_totals(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, n_chars long")
    monkeypatch.setattr(_run, "SHIP_BYTES", 0)
    got = Counter((r.doc_id, r.source, r.n_chars) for r in mixing.mix(docs).collect())
    assert got == brute(ROWS)


def test_weights_below_zero_are_refused(spark):
    with pytest.raises(ValueError):
        mixing.mix(cases.empty(spark), {"a": -1})
