import random
import re

import numpy as np
import pytest

from tessarine.llm import _run, toxicity
from tests.llm import cases


def made(n, seed=1):
    """Prose of made-up words; toxic documents have words of a toxic stem, some near a pronoun or disguised."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for k in range(n):
        own = [word() for _ in range(rng.randrange(20, 80))]
        bad = k % 4 == 0
        for _ in range(rng.randrange(2, 5) if bad else 0):
            insult = "zarg" + word()[:4] if rng.random() < 0.8 else rng.choice(["1d!ot", "st*pid", "m0r0n"])
            own.insert(rng.randrange(len(own)), rng.choice(["you " + insult, insult.upper() + "!!", insult]))
        docs.append((k, " ".join(own)))
        labels.append((k, int(bad)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = made(1600)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(frame.where("doc_id < 1200"), spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 1200"))
    got = {r.doc_id: r.toxicity.toxic for r in toxicity.score(frame.where("doc_id >= 1200"), model).collect()}
    right = sum(got[d] == bool(y) for d, y in labels if d >= 1200)
    assert right >= 0.95 * 400


def test_features():
    lexicon = toxicity.Lexicon(toxicity._hash_words(toxicity.BASE), [np.zeros(0, dtype=np.uint64)] * 3, toxicity._hash_words(toxicity.PRONOUNS))
    import pyarrow as pa

    x = toxicity.features(pa.array(["You utter IDIOT!", "a 1d10t b c d e f g you", "fine day, is it?", "", None, "ÉTÉ été"]), lexicon)
    at = {n: k for k, n in enumerate(toxicity.FEATURES)}
    assert x[0, at["lexicon"]] == pytest.approx(1 / 3) and x[0, at["near_share"]] == 1 and x[0, at["shouting"]] == pytest.approx(1 / 3) and x[0, at["exclaim"]] == pytest.approx(1 / 16)
    assert x[1, at["lexicon"]] == pytest.approx(1 / 9) and x[1, at["near_share"]] == 0 and x[1, at["hidden"]] == pytest.approx(1 / 9)
    assert x[2, at["lexicon"]] == 0 and x[2, at["question"]] > 0 and x[2, at["inner"]] == 0
    assert not x[3].any() and not x[4].any()
    assert x[5, at["length"]] == pytest.approx(np.log(3))
    pair = toxicity.Tokens(np.frombuffer("ÉTÉ été".encode(), dtype=np.uint8), np.array([0, 11]))
    assert pair.hash[0] == pair.hash[1]


def test_isotonic_against_the_min_max_rule():
    rng = np.random.default_rng(3)
    raw = np.round(rng.normal(size=60), 1)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    edges, values = toxicity.isotonic(raw, y)
    xs = np.unique(raw)
    for x in xs:
        want = max(min(y[(raw >= a) & (raw <= b)].mean() for b in xs[xs >= x]) for a in xs[xs <= x])
        assert values[np.searchsorted(edges, x, side="right") - 1] == pytest.approx(want)
    assert (np.diff(values) > 0).all()


def test_trees_against_a_walk_from_the_root():
    rng = np.random.default_rng(2)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 2] > 0.5)).astype(float)
    trees = toxicity.grow(x, y, trees=25)
    raw = toxicity.predict(trees, x)
    for k in range(0, 500, 50):
        value = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + (x[k, f[node]] >= c[node])
            value += leaf[node - 7]
        assert raw[k] == pytest.approx(value)
    assert ((raw > 0) == (y > 0)).mean() > 0.97


def test_awkward_and_empty(spark):
    docs, labels = made(400)
    train = spark.createDataFrame(docs, "doc_id long, text string").unionByName(cases.awkward(spark).select("doc_id", "text"))
    extra = [(None, 1), (5000, 1), (3, None), (7, 9), (11, 0), (11, 1), (12, 1), (12, 1)]
    model = toxicity.fit(train, spark.createDataFrame(labels + extra, "doc_id long, toxic int"))
    own = cases.awkward(spark)
    out = toxicity.score(own, model)
    assert out.columns == [*own.columns, "toxicity"]
    got = out.collect()
    assert all(r.toxicity.probability == 0 and not r.toxicity.toxic for r in got if not (r.text or "").strip())
    assert not any(r.toxicity.toxic for r in got)
    assert toxicity.score(cases.empty(spark), model).count() == 0
    none = toxicity.fit(own, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none is None and {(r.toxicity.probability, r.toxicity.toxic) for r in toxicity.score(own, None).collect()} == {(None, False)}


def test_documents_that_share_a_token_all_train(spark):
    """Tokens without letters, or one frequent word, don't make documents copies of each other."""
    docs, labels = made(1600)
    frame = spark.createDataFrame([(k, t + " - 26 zz") for k, t in docs], "doc_id long, text string")
    model = toxicity.fit(frame.where("doc_id < 1200"), spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 1200"))
    assert model is not None
    got = {r.doc_id: r.toxicity.toxic for r in toxicity.score(frame.where("doc_id >= 1200"), model).collect()}
    assert sum(got[d] == bool(y) for d, y in labels if d >= 1200) >= 0.95 * 400


def plain_features(text, lexicon):
    """The features of one text, token by token. lexicon: sets of words, stems by length, and pronouns, folded."""
    fold = str.maketrans("@$013457", "asoieast")

    def letters(token):
        out = []
        for c in token.translate(fold):
            if "A" <= c <= "Z" or ("\u00c0" <= c <= "\u00de" and c != "\u00d7"):
                c = c.lower()
            if c.isascii() and not c.isalpha():
                continue
            out.append(c)
        return "".join(out)

    tokens = re.findall(r"[^\t\n\f\r ]+", text)
    n, raw = max(len(tokens), 1), text.encode()
    folded = [letters(t).encode() for t in tokens]
    word = [f in lexicon[0] for f in folded]
    stem = [any(len(f) >= k and f[:k] in lexicon[1][k] for k in toxicity.STEMS) for f in folded]
    hit = [a or b for a, b in zip(word, stem, strict=True)]
    you = [k for k, f in enumerate(folded) if f in lexicon[2]]
    near = [h and any(abs(k - y) <= toxicity.NEAR for y in you) for k, h in enumerate(hit)]
    spelled = [sum(c.isalpha() if c.isascii() else len(c.encode()) for c in t) for t in tokens]
    capitals = [sum("A" <= c <= "Z" for c in t) for t in tokens]
    inner = []
    for t, m in zip(tokens, spelled, strict=True):
        b = t.encode()
        at = [k for k, c in enumerate(b) if c >= 128 or chr(c).isalpha()]
        inner.append(m > 1 and at[-1] - at[0] + 1 > m)
    size, hits = max(len(raw), 1), sum(hit)
    return [
        sum(word) / n, sum(stem) / n, np.log1p(hits), sum(near) / max(hits, 1), sum(near) / n, sum(capitals) / max(sum(spelled), 1),
        sum(m > 1 and m == c for m, c in zip(spelled, capitals, strict=True)) / n, raw.count(b"!") / size, raw.count(b"?") / size,
        sum(33 <= c < 127 and not chr(c).isalnum() for c in raw) / size, sum(inner) / n, sum(a and b for a, b in zip(inner, hit, strict=True)) / n, np.log1p(len(tokens)),
    ]


def test_features_of_all_documents_against_brute_force(spark, sf):
    import pyarrow as pa

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + ["", "1d10t YOU! ÉCOLE", "- 26 & You, a.b.c"]
    stems = {4: {b"zarg", b"pfau"}, 5: {b"mente"}, 6: {b"schlic"[:6]}}
    known = set(b"the and de la und you der idiot".split()), stems, {w.encode() for w in toxicity.PRONOUNS}
    lexicon = toxicity.Lexicon(
        toxicity._hash_words(w.decode() for w in known[0]), [toxicity._hash_words(w.decode() for w in stems[k]) for k in toxicity.STEMS], toxicity._hash_words(toxicity.PRONOUNS)
    )
    got = toxicity.features(pa.array(texts), lexicon)
    want = np.array([plain_features(t or "", known) for t in texts])
    bad = np.abs(got - want).max(axis=0)
    assert dict(zip(toxicity.FEATURES, bad > 1e-9, strict=True)) == dict.fromkeys(toxicity.FEATURES, False)


def test_every_labelled_text_trains_and_partitions_do_not_matter(spark, sf, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    texts = {(r.text, r.toxic) for r in docs.join(labels.dropDuplicates(["doc_id"]), "doc_id").where("text IS NOT NULL AND toxic IN (0, 1)").collect()}
    seen, models = [], []
    written = _run.written
    monkeypatch.setattr(toxicity._run, "written", lambda df: seen.append(written(df)) or seen[-1])
    for n in (1, 5):
        models.append(toxicity.fit(docs.repartition(n), labels))
        assert seen[-1].count() == len(texts)
    a, b = models
    assert (a is None) == (b is None)
    if a:
        assert (a.lexicon.words == b.lexicon.words).all() and a.trees.leaf == pytest.approx(b.trees.leaf) and a.values == pytest.approx(b.values)


def test_query_scores_by_a_walk_over_each_document(spark):
    """The query's probabilities are those of single documents, one by one."""
    import pyarrow as pa

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[::97]:
        x = toxicity.features(pa.array([r.text], pa.string()), model.lexicon)[0]
        raw = model.trees.base
        for f, c, leaf in zip(model.trees.feature, model.trees.cut, model.trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[f[node]] >= c[node])
            raw += leaf[node - len(f)]
        below = [v for e, v in zip(model.edges, model.values, strict=True) if e <= raw + 1e-12]
        p = (below[-1] if below else model.values[0]) if (r.text or "").split() else 0.0
        assert got[r.doc_id].probability == pytest.approx(p) and got[r.doc_id].toxic == (p >= 0.5)
