"""Embedding models and remote vector caches as batch clients inside partitions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelConfig:
    name: str
    dimensions: int
    query_prefix: str = ""
    index_prefix: str = ""
    batch: int = 8


def prefixed(text: Column, model: ModelConfig, indexing: bool = True) -> Column:
    """The text as the model wants it, for the index or as a query."""
    return F.concat(F.lit(model.index_prefix if indexing else model.query_prefix), text)


def embedder(client: Callable[[list[str]], list[list[float] | None]], model: ModelConfig, indexing: bool = True) -> Callable[[Column], Column]:
    """A function of a text column that gives vectors.

    The client gets ``model.batch`` texts at a time. Texts for which it has nothing, a batch
    that raises, and vectors of another length are NULL.
    """

    def embedded(texts: pa.Array) -> pa.Array:
        values, out = texts.to_pylist(), []
        wanted = [k for k, t in enumerate(values) if t is not None]
        found: dict[int, list[float]] = {}
        for at in range(0, len(wanted), model.batch):
            part = wanted[at : at + model.batch]
            try:
                answers = client([values[k] for k in part])
            except Exception:
                continue
            found.update((k, v) for k, v in zip(part, answers, strict=False) if v is not None and len(v) == model.dimensions)
        out = [found.get(k) for k in range(len(values))]
        return pa.array(out, pa.list_(pa.float32()))

    udf = F.arrow_udf(embedded, "array<float>").asNondeterministic()
    return lambda text: udf(prefixed(text, model, indexing))


def remote_vectors(wanted: DataFrame, client: Callable[[list[str]], list[str | None]], batch: int = 1000) -> DataFrame:
    """(sha256, data) of hashes that a remote cache knows, asked for in batches; a failed batch counts as unknown."""

    def asked(batches):
        for b in batches:
            keys = [k for k in b.column("sha256").to_pylist() if k is not None]
            for at in range(0, len(keys), batch):
                part = keys[at : at + batch]
                try:
                    answers = client(part)
                except Exception:
                    continue
                hits = [(k, v) for k, v in zip(part, answers, strict=False) if v is not None]
                yield pa.RecordBatch.from_pydict({"sha256": pa.array([k for k, _ in hits], pa.string()), "data": pa.array([v for _, v in hits], pa.string())})

    return wanted.select("sha256").distinct().mapInArrow(asked, "sha256 string, data string")


def filtered(rows: DataFrame, keep: Callable[[list[str]], list[bool]] | None, text: str = "text") -> DataFrame:
    """rows that a model's filter keeps; all of them without one."""
    if keep is None:
        return rows
    return rows.where(F.arrow_udf(lambda texts: pa.array(keep(texts.to_pylist()), pa.bool_()), "boolean").asNondeterministic()(text))


def reranked(rows: DataFrame, order: Callable[[list[str]], list[int]], by: list[str], text: str = "text", most: int = 1000) -> DataFrame:
    """A short ranked list with ``rank`` as a model orders it; what the model leaves out drops.

    The list goes to the driver, so one of more than ``most`` rows is a ValueError.
    """
    held = rows.orderBy(*by).limit(most + 1).toPandas()
    if len(held) > most:
        raise ValueError(f"more than {most} rows to rerank")
    chosen = [i for i in dict.fromkeys(order(held[text].tolist())) if 0 <= i < len(held)]
    picked = held.iloc[chosen].assign(rank=range(1, len(chosen) + 1))
    return rows.sparkSession.createDataFrame(picked, f"{rows.schema.toDDL()}, rank INT") if chosen else rows.where("false").withColumn("rank", F.lit(0))
