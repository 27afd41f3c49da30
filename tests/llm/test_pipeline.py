from collections import Counter

import corpus_pipeline
from tessarine.llm import secrets
from tests.llm import cases
from tests.llm.test_language_id import Brute
from tests.llm.test_mixing import brute as mixed


def groups(pairs, ids):
    label = {d: d for d in ids}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {root(d) for d in ids}


def test_run_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    brute = Brute([(r[1], r[2]) for r in rows])
    kept = [r for r in rows if (s := brute.score(r[1]))[0] and s[1] >= 0.05 and s[2] >= 0.5]
    stay = groups(cases.jaccard_pairs([(r[0], r[1]) for r in kept]), [r[0] for r in kept])
    kept = [r for r in kept if r[0] in stay]
    bad = {d for d, _ in cases.contaminated([(r[0], r[1]) for r in kept], bench)}
    kept = [r for r in kept if r[0] not in bad]
    look = secrets._finder(secrets.VOCABULARY, 16, 2.4, ())()
    texts = {}
    for k, (doc_id, text, lang, source, n) in enumerate(kept):
        for start, length, *_ in reversed(look(text)):
            text = text[:start] + "[SECRET]" + text[start + length :]
        kept[k] = (doc_id, text, lang, source, len(text) if text != kept[k][1] else n)
        texts[doc_id] = text
    want = mixed([(r[0], r[3], r[4]) for r in kept])
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.source, r.n_chars) for r in got) == want
    assert all(r.text == texts[r.doc_id] for r in got)


def test_every_stage_keeps_the_columns(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "secrets", "mixing"]
    for docs in (cases.awkward(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns or name == "mixing"
            out.collect()
