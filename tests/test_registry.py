"""Every registered query against its SQL, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessarine.plans import catalog


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v.item() if hasattr(v, "item") else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in values)


@pytest.fixture(scope="module")
def tables(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sf, tables, name):
    df = catalog.QUERIES[name](spark, sf)
    found = tables.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables():
    """No registered SQL leans on a cap that isn't the feature."""
    limited = {n for n, s in catalog.ORACLE_SQL.items() if "LIMIT" in s.upper()}
    assert limited <= {
        "q1_bm25_search", "top1_ranked_order", "join15_hit_text", "q2_semantic_search", "agg16_knowledge_base", "join1_resolved_hits",
        "top2_fn9_fn10_nearest", "top3_fn11_farthest", "top4_nearest_offset",
    }


def test_plans_prune_and_push(spark, sf):
    from pyspark.sql import functions as F

    from tessarine.functions.globs import selected
    from tessarine.operators import lexical

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = docs.where("doc_id > 5").where(selected(F.col("source"), "src1*")).select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(doc_id,5)" in plan.partition("PushedFilters: [")[2][:120] and "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    hits = lexical.file_hits(docs.select(F.col("doc_id").alias("path"), "text"), ["(?i)the", "(?i)of"])
    ranked = lexical.rank_files(hits, 2, 200)
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 3 and "PythonUDF" not in plan
