import random

import numpy as np
import pytest

from tessarine.llm import ngram_join
from tests.llm import cases


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(2, 120))]
        docs.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            docs.append(" ".join(w if rng.random() > 0.06 else word() for w in base))
        if rng.random() < 0.3:
            docs.append(" ".join(base))
    rng.shuffle(docs)
    return [(100 + k, d) for k, d in enumerate(docs)]


def found(df):
    return {(r.doc_id_a, r.doc_id_b): r.jaccard for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 3])
def test_pairs_against_brute_force(spark, block):
    docs = corpus()
    want = cases.jaccard_pairs(docs)
    got = found(ngram_join.all_pairs(spark.createDataFrame(docs, "doc_id long, text string"), block=block))
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in got)
    assert len(got) >= 0.95 * len(want) > 20


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_tree_is_exact(threshold):
    rng = np.random.default_rng(5)
    own = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
        for _ in range(rng.integers(1, 6)):
            keep = base[rng.random(len(base)) > 0.15]
            more = rng.integers(0, 1 << 63, len(base) // 8, dtype=np.uint64)
            if len(s := np.unique(np.concatenate([keep, more]))):
                own.append(s)
    i, j, value = ngram_join.similar(own, threshold)
    got = {(min(a, b), max(a, b)): v for a, b, v in zip(i.tolist(), j.tolist(), value.tolist(), strict=True)}
    sets = [set(s.tolist()) for s in own]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= threshold})


def test_nodes_rule_pairs_out():
    """Groups that share nothing are parted above the leaves."""
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 1 << 63, 4 + 40 * g, dtype=np.uint64)) for g in range(6) for _ in range(64)]
    tree = ngram_join.Tree(own)
    seen = sum(len(a) for a, _ in tree.pairs(0.8))
    assert seen < len(own) * (len(own) - 1) / 2 / 5


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    got = found(ngram_join.all_pairs(docs))
    assert got == {(1, 2): 1.0}
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # one of the two rows of document 1; rows without words or an id stay
    assert ids == [(False, k) for k in (1, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0)] * 2


def test_empty_table(spark):
    assert found(ngram_join.all_pairs(cases.empty(spark))) == {}
    assert ngram_join.deduplicate(cases.empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = corpus(3)
    kept = {r.doc_id for r in ngram_join.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    label = {d: d for d, _ in docs}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in cases.jaccard_pairs(docs):
        x, y = sorted((root(a), root(b)))
        label[y] = x
    roots = {root(d) for d, _ in docs}
    assert len(kept ^ roots) <= 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in ngram_join.components(edges).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[100] == got[101] == 100


def brute_links(docs, threshold=0.5):
    """{(doc_id, class_id, links)}, one for each doc_id and set."""
    items = sorted({(d, cases.shingles(t)) for d, t in docs if d is not None}, key=lambda x: (x[0], sorted(x[1])))
    items = [x for x in items if x[1] or all(not y[1] for y in items if y[0] == x[0])]
    label, links = list(range(len(items))), [0] * len(items)

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (_, x) in enumerate(items):
        for j in range(i + 1, len(items)):
            y = items[j][1]
            k = len(x & y)
            if k and k >= threshold * (len(x) + len(y) - k):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return sorted((d, items[root(i)][0], links[i]) for i, (d, _) in enumerate(items))


def test_links_of_copies_and_near_copies(spark):
    """Copies and near copies are one group; each text of a repeated doc_id has its own row."""
    base = [f"w{k}" for k in range(200)]
    near = ["x", *base[1:]]
    other = [f"v{k}" for k in range(90)]
    docs = [(k, " ".join(base)) for k in range(2, 8)] + [(k, " ".join(near)) for k in range(20, 25)]
    docs += [(9, " ".join(other)), (9, " ".join(base)), (30, " ".join(other)), (31, " ".join(["y", *other[1:]])), (40, "on its own"), (41, None)]
    want = brute_links(docs)
    for block in (4096, 4):
        got = sorted(tuple(r) for r in ngram_join.linked(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect())
        assert got == want
    assert (2, 2, 11) in want and (9, 2, 11) in want and (9, 9, 2) in want and (40, 40, 0) in want and (41, 41, 0) in want


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in ngram_join.query(spark, sf).collect())
    assert sum(x == y for x, y in zip(got, brute_links(docs), strict=True)) >= len(got) - 2


def test_awkward_rows_have_links(spark):
    got = sorted(tuple(r) for r in ngram_join.linked(cases.awkward(spark)).collect())
    assert got == [(1, 1, 1), (2, 1, 1), *((k, k, 0) for k in range(3, 10))]
    assert ngram_join.linked(cases.empty(spark)).count() == 0


def test_texts_of_one_id_have_their_own_fate(spark):
    """A near copy goes, another text of its doc_id stays; near copies under one doc_id are one."""
    base = [f"w{k}" for k in range(100)]
    other = " ".join(f"v{k}" for k in range(80))
    docs = [(1, " ".join(base)), (2, " ".join(["x", *base[1:]])), (2, other), (3, " ".join(f"u{k}" for k in range(50))), (3, " ".join(f"u{k}" for k in range(49)))]
    kept = ngram_join.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3] and other in {r.text for r in kept}


def test_no_link_at_the_threshold_is_left_out(spark):
    """Pairs of texts that share just half of their n-grams, each apart from all others."""
    docs = []
    for k in range(500):
        shared = [f"s{k}x{j}" for j in range(22)]
        docs += [(2 * k, " ".join([*shared, *(f"a{k}x{j}" for j in range(10))])), (2 * k + 1, " ".join([*shared, *(f"b{k}x{j}" for j in range(10))]))]
    got = sorted(tuple(r) for r in ngram_join.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(d, d - d % 2, 1) for d, _ in docs]


@pytest.mark.parametrize("chunk, paired", [(1 << 21, 16), (500, 2)])
@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8])
def test_links_of_common_words(spark, threshold, chunk, paired, monkeypatch):
    """Short texts over few words, where every n-gram is shared: all links, whatever the chunks, buckets and long runs."""
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(ngram_join, "BUCKET_TOKENS", chunk)
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "FRONTIER", 64 if paired == 2 else 1 << 16)
    rng = random.Random(8)
    docs = []
    for k in range(250):
        base = [rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 60]))]
        docs += [(k, " ".join(base)), (1000 + k, " ".join(w if rng.random() > 0.05 else f"w{rng.randrange(40)}" for w in base))]
    got = sorted(tuple(r) for r in ngram_join.linked(spark.createDataFrame(docs, "doc_id long, text string"), threshold=threshold).collect())
    assert got == brute_links(docs, threshold)
