import math
import re
from collections import Counter, defaultdict

import pytest

from tessarine.llm import language_id
from tests.llm import cases


def words(text):
    return re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())


def grams(word, n):
    for i in range(len(word) - n + 1):
        yield word[i : i + n], i == 0, i + n == len(word)


class Brute:
    """The same model with dictionaries of strings."""

    def __init__(self, docs, min_count=3, smoothing=0.5):
        counts = [defaultdict(Counter) for _ in range(6)]
        for text, lang in docs:
            for w in words(text):
                counts[0][w][lang] += 1
                for n in range(1, 6):
                    for g in grams(w, n):
                        counts[n][g][lang] += 1
        self.languages = sorted({lang for _, lang in docs})
        self.tables = []
        for own in counts:
            kept = {k: c for k, c in own.items() if sum(c.values()) >= min_count}
            total = {x: sum(c[x] + smoothing for c in kept.values()) for x in self.languages}
            self.tables.append({k: [math.log((c[x] + smoothing) / total[x]) for x in self.languages] for k, c in kept.items()})

    def word(self, w):
        if w in self.tables[0]:
            return self.tables[0][w]
        for n in range(5, 0, -1):
            hits = [self.tables[n][g] for g in grams(w, n) if g in self.tables[n]]
            if hits:
                return [sum(x) / len(hits) for x in zip(*hits, strict=True)]
        return None

    def score(self, text):
        each = [self.word(w) for w in words(text)]
        seen = [s for s in each if s]
        if not seen:
            return None, 0.0, 0.0
        mean = [sum(x) / len(seen) for x in zip(*seen, strict=True)]
        top = sorted(mean)
        return self.languages[mean.index(top[-1])], top[-1] - top[-2], len(seen) / len(each)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    train = [(t, x) for d, t, x in rows if d % 3]
    brute = Brute(train)
    model = language_id.fit(docs.where("doc_id % 3 <> 0"))
    assert model.languages == brute.languages and [len(h) for h in model.hashes] == [len(t) for t in brute.tables]
    for r in language_id.identify(docs, model).collect():
        lang, margin, evidence = brute.score(r.text)
        assert r._language.lang_id == lang and r._language.margin == pytest.approx(margin, abs=1e-4) and r._language.evidence == pytest.approx(evidence)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    held = language_id.identify(docs.where("doc_id % 2 = 1"), model)
    n, right, kept = held.selectExpr("count(*)", "count_if(lang = _language.lang_id)", "count_if(_language.accepted)").first()
    assert right >= 0.99 * n and kept >= 0.99 * n


def test_the_sample_is_bounded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = language_id.fit(docs, max_train_docs=40)
    assert 0 < len(small.hashes[0]) < len(language_id.fit(docs).hashes[0])


def test_awkward_and_empty(spark, sf):
    docs = cases.awkward(spark)
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = language_id.stage(spark, docs, sf)
    assert kept.columns == docs.columns
    out = language_id.identify(docs, model, into="_own").collect()
    assert all(not r._own.accepted and r._own.lang_id is None and r._own.margin == 0 for r in out if r.doc_id in (3, 4, 5, 8) or (r.text is None))
    assert [r._own for r in out if r.doc_id == 1][0] == [r._own for r in out if r.doc_id == 1][1]
    assert language_id.stage(spark, cases.empty(spark), sf).count() == 0
    blank = language_id.fit(cases.empty(spark))
    assert language_id.identify(docs, blank, into="_own").where("_own.accepted").count() == 0
    one = language_id.fit(docs.where("lang = 'en'"))
    assert language_id.identify(docs, one, into="_own").where("_own.accepted").count() > 0
