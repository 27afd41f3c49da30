import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessarine import schema
from tessarine.functions.vectors import cosine_distance
from tessarine.operators import intervals, knn, maintain, references, training
from tessarine.sources import config, files, models
from tessarine.sources.store import TableStore
from tessarine.streaming import mutations


def test_diff_and_resolution(spark):
    stored = spark.createDataFrame([("f", "a", 1, 2), ("f", "b", 3, 4), ("f", "c", 5, 6)], "path string, sha256 string, start_line int, end_line int")
    new = spark.createDataFrame([("f", "a", 1, 2), ("f", "b", 4, 5), ("f", "d", 7, 8)], stored.schema)
    got = {(r.sha256, r.action, r.start_line) for r in maintain.chunk_diff(stored, new).collect()}
    assert got == {("b", "move", 4), ("c", "delete", 5), ("d", "embed", 7)}


def test_store_changes_as_one(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "db"), {"files": schema.FILES, "vectors": schema.VECTORS})
    assert store.version() == 0 and store.read("files").count() == 0
    one = spark.createDataFrame([(1, "a", "h")], schema.FILES)
    assert store.commit(files=one) == 1 and store.read("files").count() == 1
    bad = one.withColumn("file_id", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.commit(files=bad)
    assert store.version() == 1 and store.read("files").first().file_path == "a"
    assert store.commit(vectors=spark.createDataFrame([(1, [0.5])], schema.VECTORS)) == 2
    assert store.read("files").count() == 1 and store.read("vectors").count() == 1 and store.read("vectors", 1).count() == 0
    assert store.compact() == 3 and store.versions() == [3] and store.read("vectors").count() == 1


def test_ids_are_consecutive(spark):
    got = sorted(r.vector_id for r in maintain.with_ids(spark.range(1000).repartition(7), 50, ["id"]).collect())
    assert got == list(range(50, 1050))
    assert maintain.with_ids(spark.range(0), 5, ["id"]).count() == 0


def test_stream_drains(spark, tmp_path):
    changes = [("A", "dirty", 1), ("b", "dirty", 2), ("a", "delete", 3), ("c", "dirty", 4), ("b", "dirty", 5), ("x.skip", "dirty", 6)]
    spark.createDataFrame(changes, schema.MUTATIONS).write.parquet(str(tmp_path / "q"))
    seen = []
    stream = mutations.queue(mutations.change_stream(spark, str(tmp_path / "q")), lambda p: ~p.endswith(".skip"))
    vanished = lambda dirty: dirty.where("path = 'c'")
    mutations.drain(stream, lambda d, g, n: seen.append(({r.path for r in d.collect()}, {r.path for r in g.collect()})), str(tmp_path / "cp"), vanished).awaitTermination()
    assert seen == [({"b"}, {"a", "c"})]


def test_files_and_json(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, text in (("a.cc", "int a;\n"), ("b.h", "é"), ("c.py", "x"), ("skip_b.cc", "y")):
        (tmp_path / "src" / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.scan(spark, str(tmp_path), [".cc", ".h"], ["**/skip_*"]).collect()}
    assert got == {"a.cc": "int a;\n", "b.h": "é"}
    with pytest.warns(UserWarning):
        assert files.scan(spark, str(tmp_path / "none")).count() == 0
    assert files.scan_all(spark, [str(tmp_path), str(tmp_path / "src")]).count() == 4
    assert files.training_files(spark, str(tmp_path), [".CC"], ["**/SKIP*"]).count() == 1
    row = [("q", "t", ("p", 1, 2), [("n", 3, 4)], [])]
    files.write_jsonl(spark.createDataFrame(row, schema.TRAINING).coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("*.json"))
    assert json.loads(part.read_text())["easyNegatives"] == []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text("\n" + part.read_text() + "\n")
    assert files.read_jsonl(spark, str(tmp_path / "in")).first().hardNegatives[0].startLine == 3
    (tmp_path / "in" / "y.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_jsonl(spark, str(tmp_path / "in")).collect()
    done = spark.createDataFrame([("a", "{}"), ("a", "[1]"), ("b", "{}"), ("b", "oops"), ("c", " ")], "output string, line string")
    assert [r.output for r in files.processed(done).collect()] == ["a"]
    assert files.add_document(spark, str(tmp_path), "note", "hello").endswith("note.md") and (tmp_path / "note.md").read_text() == "hello"
    with pytest.raises(Exception, match="(?i)exist"):
        files.add_document(spark, str(tmp_path), "note.md", "x")


def test_config():
    good = {"outputDir": "o", "rootDirs": ["r"], "fileExtensions": [".h"], "excludePatterns": [], "modelId": "m", "concurrency": 2}
    raw = lambda s: f"---\n{json.dumps(s)}\n---\n# Phase 1: find\nfirst {{{{FILE_LIST}}}}\n# Phase 2: judge\nsecond\n"
    c = config.training_config(raw(good))
    assert (c.first_template, c.second_template, c.settings["maxHardNegatives"]) == ("first {{FILE_LIST}}", "second", 5)
    assert config.prompt(c.first_template, ["a"], []) == "first - a"
    for change in ({"outputDir": ""}, {"rootDirs": []}, {"concurrency": 0}, {"modelId": None}, {"phase1Tools": ["x"]}):
        with pytest.raises(ValueError):
            config.training_config(raw(good | change))
    for text in ("", "---\n{}\n---\nno second"):
        with pytest.raises(ValueError):
            config.training_config(text)
    easy = {"trainingSamplesDir": "d", "minTopK": 2, "maxTopK": 9, "numNegatives": 1, "concurrency": 1}
    assert config.easy_negative_config(json.dumps(easy))["maxTopK"] == 9
    for change in ({"maxTopK": 2}, {"minTopK": 0}, {"numNegatives": 1.5}, {"trainingSamplesDir": ""}):
        with pytest.raises(ValueError):
            config.easy_negative_config(json.dumps(easy | change))


def test_model_clients(spark):
    def client(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError
        return [None if "none" in t else [float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("a",), ("none",), (None,), ("boom",), ("bb",)], "t string").coalesce(1)
    got = [r.v for r in df.select(models.embedder(client, models.ModelConfig("m", 2, "", "p:", 1))(F.col("t")).alias("v")).collect()]
    assert got == [[3.0, 1.0], None, None, None, [4.0, 1.0]]
    known = models.remote_vectors(spark.createDataFrame([("x",), ("y",), ("x",)], "sha256 string"), lambda keys: ["d" if k == "x" else None for k in keys])
    assert [tuple(r) for r in known.collect()] == [("x", "d")]
    assert models.filtered(df, lambda ts: [t == "a" for t in ts], "t").count() == 1 and models.filtered(df, None).count() == 5
    ranked = models.reranked(df.where("t IS NOT NULL"), lambda ts: [2, 0, 2, 99], ["t"], "t").orderBy("rank").collect()
    assert [(r.t, r["rank"]) for r in ranked] == [("boom", 1), ("a", 2)]


def test_neighbours(spark):
    v = spark.createDataFrame([(k, [float(k % 3), float(k % 5), 1.0]) for k in range(40)] + [(99, None), (98, [1.0])], "vector_id long, embedding array<float>")
    one = [r.vector_id for r in knn.nearest(v, [1.0, 1.0, 1.0], 5).collect()]
    q = spark.createDataFrame([("q", [1.0, 1.0, 1.0]), ("z", [0.0, 0.0, 0.0])], "query_id string, query array<float>")
    for size in (1 << 20, 1):
        every = knn.nearest_for_all(v, q, 5, "query_id", ship_bytes=size).orderBy("rank").collect()
        assert [r.vector_id for r in every if r.query_id == "q"] == one and not [r for r in every if r.query_id == "z"]
    assert knn.nearest_for_all(v, q.where("false"), 5, "query_id").count() == 0


def test_neighbours_of_all_in_bounded_memory(spark):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40_000, 8)).astype("f4")
    x[100:200], x[300] = x[7], 0
    shelf = knn._Shelf(np.arange(len(x))[::-1].copy(), x[::-1])
    tracemalloc.start()
    got = [tuple(np.concatenate(c)) for c in zip(*shelf.nearest(x[:1500], 6), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20  # all distances at once are 480 MB
    wide = x.astype("f8")
    for q in (0, 7, 150, 299, 300, 1499):
        dot, squares = np.zeros(len(x)), np.zeros(len(x))
        for d in range(8):
            dot, squares = dot + wide[q, d] * wide[:, d], squares + wide[:, d] * wide[:, d]
        with np.errstate(all="ignore"):
            distance = 1 - np.clip(dot / np.sqrt(squares[q] * squares), -1, 1)
        best = [] if q == 300 else [k for k in np.lexsort((np.arange(len(x)), distance)) if k != 300][:6]
        own = np.asarray(got[0]) == q
        assert np.asarray(got[1])[own].tolist() == best and np.asarray(got[2])[own].tolist() == distance[best].tolist()


@pytest.mark.parametrize("ship", [1 << 20, 3000, 400])
def test_neighbours_of_all_each_way(spark, ship):
    rng = random.Random(2)
    lists = [[float(rng.randrange(-3, 4)) for _ in range(4)] for _ in range(150)] + [None, [1.0, None, 2.0, 1.0], [], [0.0] * 4, [2.0]]
    v = spark.createDataFrame([(k, e) for k, e in enumerate(lists)], "vector_id long, embedding array<float>").repartition(3)
    # the way depends on which side fits: vectors, few queries, neither
    q = v.where("vector_id % 40 = 2" if ship == 3000 else "true").selectExpr("vector_id AS query_id", "embedding AS query")

    def distance(a, b):
        if len(a) != len(b) or not any(a) or not any(b):
            return None
        return 1 - max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5))

    good = {k: e for k, e in enumerate(lists) if e and None not in e}
    want = {}
    for a in good if ship != 3000 else [k for k in good if k % 40 == 2]:
        near = sorted((distance(good[a], e), k) for k, e in good.items() if distance(good[a], e) is not None)
        want |= {(a, n + 1): (k, d) for n, (d, k) in enumerate(near[:7])}
    found = knn.nearest_for_all(v, q, 7, "query_id", ship_bytes=ship).collect()
    assert {(r.query_id, r["rank"]): (r.vector_id, r.distance) for r in found} == want


def test_nearest_by_rounded_distance(spark):
    # 5 is nearer than 4 and 3, but not by the digits shown
    angles = {1: 0.0, 5: 0.100001, 4: 0.100002, 3: 0.100003, 2: 0.2}
    v = spark.createDataFrame([(k, [math.cos(a), math.sin(a)]) for k, a in angles.items()], "vector_id long, embedding array<double>")
    assert [r.vector_id for r in knn.nearest(v, [1.0, 0.0], 2, offset=1).collect()] == [5, 4]
    assert [tuple(r) for r in knn.nearest(v, [1.0, 0.0], 2, offset=1, digits=4).collect()] == [(3, 0.005), (4, 0.005)]
    # one over the root of a product, and never beyond 1, as DuckDB has it
    rng = random.Random(4)
    pairs = [[[rng.randrange(-(1 << 23), 1 << 23) / (1 << 20) for _ in range(7)] for _ in range(2)] for _ in range(300)]  # whose products are exact
    pairs += [(a, [3 * x for x in a]) for a, _ in pairs]
    found = spark.createDataFrame(pairs, "a array<double>, b array<double>").select(cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()
    c = duckdb.connect()
    assert [r.d for r in found] == [c.execute("SELECT 1 - list_cosine_similarity(?::DOUBLE[], ?::DOUBLE[])", [a, b]).fetchone()[0] for a, b in pairs]


def test_intervals(spark):
    s = spark.createDataFrame(
        [("f", 1, "n", 0, 20, "n"), ("f", 2, "c", 3, 12, "n::c"), ("f", 21, "m", 5, 8, "n::c::m"), ("f", 21, "k", 10, 11, None), ("f", 60, "x", 6, 6, None)],
        "path string, type int, name string, start_line int, end_line int, fully_qualified_name string",
    )
    p = spark.createDataFrame([("f", x, 30) for x in (6, 9, 13, 25)] + [("g", 0, 4)], "path string, line int, line_count int")
    held = {(r.path, r.line): r.symbol.name if r.symbol else None for r in intervals.innermost_container(p, s).collect()}
    assert held == {("f", 6): "m", ("f", 9): "c", ("f", 13): "n", ("f", 25): None, ("g", 0): None}
    bounds = {(r.path, r.line): (r.min_line, r.max_line) for r in intervals.context_bounds(p, s).collect()}
    assert bounds == {("f", 6): (5, 8), ("f", 9): (9, 9), ("f", 13): (13, 20), ("f", 25): (21, 29), ("g", 0): (0, 3)}
    r = spark.createDataFrame([("f", 1, 5, 0.1), ("f", 5, 6, 0.9), ("f", 7, 9, 0.5), ("g", 1, 1, 0.2)], "path string, start_line int, end_line int, score double")
    assert sorted(tuple(x) for x in intervals.merge_results(r).collect()) == [("f", 1, 6, 0.9), ("f", 7, 9, 0.5), ("g", 1, 1, 0.2)]
    assert sorted(tuple(x) for x in intervals.context_sections(r.drop("score"), ["path"]).collect()) == [("f", 1, 9), ("g", 1, 1)]
    w = {(x.line): (x.start_line, x.end_line, x.container_name) for x in intervals.reference_windows(p.where("path = 'f'"), s, 2, 2).collect()}
    assert w == {6: (5, 8, "m"), 9: (7, 11, "c"), 13: (11, 15, "n"), 25: (23, 27, None)}


def test_references(spark):
    lines = spark.createDataFrame([("f", 0, "foo(foo1, foo)"), ("f", 1, "  x = foo;"), ("f", 2, "none"), ("f", 3, "x = foo;")], "path string, line int, line_text string")
    assert sorted((r.line, r.column) for r in references.occurrences(lines, "foo").collect()) == [(0, 0), (0, 10), (1, 6), (3, 4)]
    refs = spark.createDataFrame([("f", 0, 0), ("f", 0, 4), ("f", 0, 10), ("f", 1, 6), ("f", 1, 5), ("f", 9, 0), ("f", 1, 99)], "path string, line int, column int")
    assert sorted((r.line, r.column) for r in references.verified(refs, lines, "foo").collect()) == [(0, 0), (0, 10), (1, 6)]
    ask = spark.createDataFrame([(1, "f", 2, 5, "foo", "x = foo;"), (2, "f", 0, 9, "foo", "foo(foo1, foo)"), (3, "f", 0, 0, "foo", "absent")], "request int, path string, line int, column int, name string, source_line string")
    got = {r.request: (r.found_line, r.found_column) for r in references.resolve_position(lines, ask).collect()}
    assert got == {1: (1, 6), 2: (0, 10), 3: (None, None)}
    code = "int a;\n/* one\n\n two */\nvoid f();\n// x\n\nint b;\nint c; /* d */\nint e;"
    points = spark.createDataFrame([("f", 4), ("f", 7), ("f", 9), ("f", 0)], "path string, line int")
    got = {r.line: (r.comment_start, r.comment_end) for r in references.comment_above(spark.createDataFrame([("f", code)], "path string, text string"), points).collect()}
    assert got == {4: (1, 3), 7: (None, None), 9: (None, None), 0: (None, None)}


def test_training(spark):
    c = spark.createDataFrame([(1, "f", 1, 5, "f", 4, 9), (1, "f", 1, 3, "f", 4, 9), (1, "f", 10, 12, "f", 4, 9), (1, "g", 4, 9, "f", 4, 9)], "sample int, path string, start_line int, end_line int, positive_path string, positive_start int, positive_end int")
    assert training.outside_positive(c).count() == 3
    rows = spark.range(100).select((F.col("id") % 4).alias("g"), "id")
    a, b = (sorted(r.id for r in training.sampled(rows, "g", ["id"], 5, seed=s).collect()) for s in (1, 2))
    assert len(a) == len(b) == 20 and a != b
    groups = training.file_groups(spark.createDataFrame([("/a/X.cc",), ("/a/x.h",), ("/b/x.h",)], "path string"))
    assert {(r.group_key, len(r.paths)) for r in groups.collect()} == {("/a/x", 2), ("/b/x", 1)}


def test_cycles_of_the_index(spark, tmp_path):
    """Files come, change, move and go; vectors follow their chunks."""
    from tessarine.plans import indexing

    text = lambda n: " ".join(f"{n}word{k}" for k in range(20))
    store = indexing.open_store(spark, str(tmp_path / "index"))
    embed = lambda t: F.when(~t.contains("fail"), F.array(F.length(t).cast("float")))

    def cycle(now, files_, gone=()):
        frame = spark.createDataFrame(files_, "path string, text string") if files_ else spark.createDataFrame([], "path string, text string")
        indexing.refresh(store, frame, spark.createDataFrame([(g,) for g in gone], "path string"), embed, now)
        names = {r.file_id: (r.file_path, r.sha256) for r in store.read("files").collect()}
        rows = store.read("chunks").collect()
        assert maintain.integrity(*(store.read(n) for n in ("files", "chunks", "vectors", "deleted_chunks", "deleted_vectors"))).where("n > 0 AND fault <> 'orphan_files'").count() == 0
        assert len({r.chunk_id for r in rows}) == len({r.vector_id for r in rows}) == len(rows)
        return names, {names[r.file_id][0]: r for r in rows}

    names, one = cycle(1, [("a.txt", text("a")), ("b.txt", text("b"))])
    assert set(one) == {"a.txt", "b.txt"} and all(v for _, v in names.values())
    _, two = cycle(2, [("a.txt", "\n\n" + text("a")), ("b.txt", text("b"))])
    assert two["a.txt"].start_line == 3 and two["a.txt"].vector_id == one["a.txt"].vector_id and two["b.txt"] == one["b.txt"]
    _, three = cycle(3, [("c.txt", text("a"))], ["a.txt"])
    assert set(three) == {"b.txt", "c.txt"} and three["c.txt"].vector_id == one["a.txt"].vector_id
    names, four = cycle(4, [("d.txt", text("fail"))], ["b.txt"])
    assert set(four) == {"c.txt"} and dict(names.values())["d.txt"] == "" and store.read("deleted_chunks").first().vector_id == one["b.txt"].vector_id
    _, five = cycle(5, [("e.txt", text("b")), ("f.txt", text("b"))])
    assert {five["e.txt"].vector_id, five["f.txt"].vector_id} > {one["b.txt"].vector_id} and store.read("deleted_chunks").count() == 0
