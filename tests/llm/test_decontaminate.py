import random

from tessarine.llm import decontaminate
from tests.llm import cases


def found(df):
    return {(r.doc_id, r.item_id): (r.words, r.doc_word, r.item_word) for r in df.collect()}


def run(spark, docs, bench, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    own = decontaminate.matches(d, b, **options)
    return found(own.selectExpr("doc_id", "explode(matches) m").selectExpr("doc_id", "m.item_id", "m.words", "m.doc_word", "m.item_word"))


def random_tables(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    return [(k, text(rng.randrange(0, 60))) for k in range(40)], [(k, text(rng.randrange(0, 25))) for k in range(12)]


def test_against_brute_force(spark):
    """A vocabulary of three words gives long and many ties."""
    for seed in range(3):
        docs, bench = random_tables(seed)
        assert run(spark, docs, bench, min_words=6) == cases.contaminated(docs, bench, 6)


def test_small_shards_and_items(spark, monkeypatch):
    docs, bench = random_tables(7)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 200)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 30)
    assert run(spark, docs, bench, min_words=6) == cases.contaminated(docs, bench, 6)


def test_items_of_one_word(spark):
    docs = [(1, "a b c"), (2, "c c d"), (3, "e"), (4, "")]
    bench = [(1, "c"), (2, "e"), (3, "a b"), (4, "z"), (5, "d e")]
    for least in (1, 2):
        assert run(spark, docs, bench, min_item_words=least) == cases.contaminated(docs, bench, 13, least)
    assert run(spark, docs, bench, min_words=1, min_item_words=1) == cases.contaminated(docs, bench, 1, 1)


def test_a_column_of_the_result_s_name_stays(spark):
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    out = decontaminate.matches(spark.createDataFrame([(1, "a b c d e", 7)], "doc_id long, text string, matches int"), bench)
    assert out.columns == ["doc_id", "text", "matches", "matches_"] and (out.first().matches, len(out.first().matches_)) == (7, 1)


def test_short_items_need_all_their_words(spark):
    bench = [(1, "one two three four five six"), (2, "one two three"), (3, None), (4, "")]
    docs = [(1, "x ONE two\nthree  four five six y"), (2, "one two three four five seven"), (3, "one two three")]
    assert run(spark, docs, bench) == {(1, 1): (6, 1, 0)}


def test_awkward_and_empty(spark, sf):
    bench = spark.createDataFrame([(5, "The cat sat on the mat"), (None, "vier fünf sechs sieben acht neun"), (6, " ".join(cases.LONG.split()[100:160]))], "item_id long, text string")
    docs = cases.awkward(spark)
    own = decontaminate.matches(docs, bench, into="found")
    assert own.columns == [*docs.columns, "found"]
    got = sorted((r.doc_id, r.m.item_id, r.m.words) for r in own.selectExpr("doc_id", "explode(found) m").collect())
    assert got == [(1, 5, 6), (1, 5, 6), (2, 5, 6), (6, 6, 60)]
    assert decontaminate.matches(cases.empty(spark), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, none).where("size(matches) > 0").count() == 0


def test_stage_removes_only_affected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bad = {d for d, _ in cases.contaminated(rows, bench)}
    left = decontaminate.stage(spark, docs, sf)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - bad and bad
