import itertools
import math
from collections import Counter

import numpy as np
import pytest

from tessarine.llm import hmm
from tests.llm import cases


def model(states=2, symbols=4, seed=0):
    rng = np.random.default_rng(seed)
    e = rng.random((symbols, states))
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), e / e.sum(axis=0))


def brute(m, line):
    """The likelihood of one line, summed over all paths of states."""
    total = 0.0
    for path in itertools.product(range(m.states), repeat=len(line)):
        p = m.initial[path[0]]
        for t, (s, o) in enumerate(zip(path, line, strict=True)):
            p *= (m.transition[path[t - 1], s] if t else 1) * m.emission[o, s]
        total += p
    return math.log(total)


def packed(lines):
    return hmm.Packed(np.concatenate([np.array(x) for x in lines]), np.array([len(x) for x in lines]))


LINES = [[0, 1, 3], [2], [1, 1, 1, 0, 2], [3, 0], [2, 2, 1, 0]]


def test_likelihood_is_exact():
    m = model()
    p = packed(LINES)
    _, scale = hmm.forward(m, p)
    got = np.zeros(len(LINES))
    got[p.order] = np.bincount(p.line, weights=np.log(scale), minlength=len(LINES))
    assert got == pytest.approx([brute(m, x) for x in LINES])


def test_expected_counts_by_enumeration():
    m = model(seed=4)
    first, transition, emission, value = hmm.expected_counts(m, packed(LINES))
    want = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for line in LINES:
        whole = math.exp(brute(m, line))
        for path in itertools.product(range(2), repeat=len(line)):
            p = m.initial[path[0]]
            for t, (s, o) in enumerate(zip(path, line, strict=True)):
                p *= (m.transition[path[t - 1], s] if t else 1) * m.emission[o, s]
            p /= whole
            want[0][path[0]] += p
            for t, (s, o) in enumerate(zip(path, line, strict=True)):
                want[2][o, s] += p
                if t:
                    want[1][path[t - 1], s] += p
    assert first == pytest.approx(want[0]) and transition == pytest.approx(want[1]) and emission == pytest.approx(want[2])
    assert value == pytest.approx(sum(brute(m, x) for x in LINES))


def test_lines_of_like_length_run_together(monkeypatch):
    """Packs with a long line each take the steps of one long line, and their counts are those of the packs one by one."""
    monkeypatch.setattr(hmm, "PACK_WORDS", 400)
    rng = np.random.default_rng(6)
    packs = [[rng.integers(0, 4, n) for n in (2, 90 + k, 0, 7, 5, 6, 1)] for k in range(4)]
    codes = [np.concatenate(x).astype("<u2").tobytes() for x in packs]
    lines = [np.array([len(y) for y in x], dtype="<u4").tobytes() for x in packs]
    m, again = model(seed=2), list(hmm.by_length(codes, lines))
    got = [hmm.expected_counts(m, p) for p in again]
    want = [hmm.expected_counts(m, packed([y for y in x if len(y)])) for x in packs]
    for a, b in zip(zip(*got, strict=True), zip(*want, strict=True), strict=True):
        assert sum(a) == pytest.approx(sum(b))
    assert len(again) == 2 and sum(len(p.running) for p in again) <= 93 + 7
    assert sum(len(p.symbols) for p in again) == sum(len(y) for x in packs for y in x)


def decoded(encoded):
    """{doc_id: (lines of classes, sum of log shares)} of packs."""
    out = {}
    for r in encoded.collect():
        codes, lines, per_row = (np.frombuffer(x, k) for x, k in ((r.codes, "<u2"), (r.lines, "<u4"), (r.per_row, "<u4")))
        shares, at, line = np.frombuffer(r.shares, "<f8"), 0, 0
        for k, n in enumerate(per_row.tolist()):
            own = []
            for size in lines[line : line + n].tolist():
                own.append(codes[at : at + size].tolist())
                at += size
            line += n
            out[r.rows[k].f0] = ([x for x in own if x], shares[k])
        assert at == len(codes) and line == len(lines)
    return out


DOCS = [(1, "a b\nc a a"), (2, "b"), (3, None), (4, ""), (5, " \n\n "), (6, "C  a\tb d\n"), (7, "e f g h")]


@pytest.mark.parametrize("ship_bytes", [1 << 20, 0])
def test_scores_against_brute_force(spark, ship_bytes, monkeypatch):
    monkeypatch.setattr(hmm, "PACK_WORDS", 5)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    encoded = hmm.encode(docs, ["doc_id"], own=2, shared=3, ship_bytes=ship_bytes)
    m = model(symbols=5, seed=9)
    got = {r.doc_id: r for r in hmm.score(encoded, m, ["doc_id"]).collect()}
    texts = {d: [x.split() for x in (t or "").lower().split("\n") if x.split()] for d, t in DOCS}
    times = Counter(w for lines in texts.values() for line in lines for w in line)
    code = {}
    for doc_id, (lines, _) in decoded(encoded).items():
        assert [len(x) for x in lines] == [len(x) for x in texts[doc_id]]
        for a, b in zip(lines, texts[doc_id], strict=True):
            for c, w in zip(a, b, strict=True):
                assert code.setdefault(w, c) == c
    assert {code["a"], code["b"]} == {0, 1} and all(code[w] >= 2 for w in "cdefgh")
    total = Counter()
    for w, n in times.items():
        total[code[w]] += n
    for doc_id, lines in texts.items():
        want = sum(brute(m, [code[w] for w in x]) + sum(math.log(times[w] / total[code[w]]) for w in x) for x in lines)
        assert got[doc_id].words == sum(map(len, lines))
        assert got[doc_id].log_likelihood == pytest.approx(want)
        assert (got[doc_id].bits_per_word is None) == (not lines)


def test_training_raises_the_likelihood_and_ignores_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    encoded = hmm.encode(docs.repartition(3), ["doc_id"], 192, 64)
    m = hmm.train(encoded, states=3, symbols=256, tolerance=1e-3)
    gains = np.diff(m.history)
    assert (gains > 0).all() and (gains[:-1] >= 1e-3).all() and gains[-1] < 1e-3 and 3 < m.iterations < 100
    a = hmm.train(encoded.coalesce(1), states=3, symbols=256, max_iterations=2)
    b = hmm.train(encoded.repartition(5), states=3, symbols=256, max_iterations=2)
    assert a.transition == pytest.approx(b.transition, rel=1e-4) and a.emission == pytest.approx(b.emission, rel=1e-3, abs=1e-7)


def test_a_word_of_the_whole_corpus_counts(spark):
    """Documents whose words occur elsewhere are likelier than equal ones whose words don't."""
    base = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(30))) for k in range(40)]
    docs = [*base, (100, "p q r s t u v"), (101, "p q r s t u v"), (200, "g h i j k l m")]
    got = {r.doc_id: r.log_likelihood for r in hmm.train_and_score(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], 50, 8, states=2).collect()}
    assert got[100] == pytest.approx(got[101]) and got[100] > got[200] + 3


def test_awkward_and_empty(spark):
    docs = cases.awkward(spark)
    got = hmm.train_and_score(docs, ["doc_id"], 40, 24, states=2, max_iterations=2).collect()
    assert len(got) == docs.count()
    assert all((r.words == 0) == (r.bits_per_word is None) for r in got)
    twice = [r for r in got if r.doc_id == 1]
    assert twice[0] == twice[1] and next(r for r in got if r.doc_id == 6).words == 40_000
    assert hmm.train_and_score(cases.empty(spark), ["doc_id"], 40, 24).count() == 0


def test_kept_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b a", "x", 7, 2.0, [1], "t"), (2, None, None, None, None, None, None)], "doc_id long, text string, codes string, words int, `_s` double, lines array<int>, rows string")
    out = hmm.train_and_score(docs, docs.columns, 4, 4, states=2, max_iterations=1)
    assert out.columns == [*docs.columns, "words_", "log_likelihood", "bits_per_word"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].codes, got[1].words, got[1].lines, got[1].words_) == ("x", 7, [1], 3) and got[2].words_ == 0 and got[2].rows is None
