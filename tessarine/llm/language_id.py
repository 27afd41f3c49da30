"""Language identification: known words first, character n-grams for the others.

The model holds, for each language, the log relative frequency of every word that
its training sample has at least ``min_count`` times, and of the character n-grams
(n = 1 .. 5, marked at word starts and ends) inside those words. A text's score for
a language is the mean over its words. A known word counts with its own frequency.
An unseen word backs off: the longest n with a known n-gram of that word decides,
with the mean over the known n-grams of that length. A word with none is no evidence.

Words are runs of letters (ASCII letters and every non-ASCII character), lower case.

Defined results: a null or empty text, or one without a word that gives evidence, has
``lang_id`` NULL, ``margin`` 0 and ``accepted`` false. If two languages have the same
score, the first in alphabetical order wins, with margin 0. Rows are scored one by
one, so repeated rows get repeated results; an empty table gives an empty result and
a table without labels a model that rejects every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm import _run, _text

LONGEST = 5
_SALT = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Model:
    languages: list[str]
    #: By n, 0 for whole words: sorted hashes and one row of log frequencies for each.
    hashes: list[np.ndarray]
    scores: list[np.ndarray]


def _word_table(data: np.ndarray, rows: np.ndarray):
    start, end, pointers = _text.words(data, rows, _text.NOT_LETTER)
    ranges = _text.Ranges(data)
    return start, end, pointers, ranges, ranges.hash(start, end)


def _grams(data: np.ndarray, ranges: _text.Ranges, start: np.ndarray, end: np.ndarray, n: int):
    """(word, hash) of every character n-gram of the words given by their byte ranges."""
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(chars, start), np.searchsorted(chars, end)
    bounds = np.append(chars, len(data))
    word, at = _text.spread(first, np.maximum(last - first - n + 1, 0))
    lo, hi = bounds[at], np.where(at + n >= last[word], end[word], bounds[np.minimum(at + n, len(bounds) - 1)])
    edge = (at == first[word]).astype(np.uint64) + np.uint64(2) * (at + n == last[word]).astype(np.uint64)
    return word, _text.mix64(ranges.hash(lo, hi) + (edge + np.uint64(4 * n)) * _SALT)


def _counts(batches):
    """Counts of words (n = 0) and n-grams by language, for each slice of a partition."""
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        names = sorted(set(lang))
        code = np.array([names.index(x) for x in lang])
        offsets, raw = _text.buffers(batch.column("text"))
        for lo, hi in _text.slices(offsets):
            rows = offsets[lo : hi + 1] - offsets[lo]
            data = raw[offsets[lo] : offsets[hi]]
            start, end, pointers, ranges, hashes = _word_table(data, rows)
            word_lang = code[lo:hi][_text.rows_of(pointers)]
            for n in range(LONGEST + 1):
                if n == 0:
                    key, by = hashes, word_lang
                else:
                    owner, key = _grams(data, ranges, start, end, n)
                    by = word_lang[owner]
                for k, name in enumerate(names):
                    found, times = np.unique(key[by == k], return_counts=True)
                    if len(found):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "lang": pa.array([name] * len(found)),
                                "n": pa.array(np.full(len(found), n, dtype=np.int32)),
                                "hash": pa.array(found.view(np.int64)),
                                "times": pa.array(times.astype(np.int64)),
                            }
                        )


def fit(docs: DataFrame, max_train_docs: int = 8000, min_count: int = 3, smoothing: float = 0.5) -> Model:
    """Fit on at most about ``max_train_docs`` labelled rows of docs(doc_id, text, lang).

    The bound makes the model's size independent of the corpus.
    """
    labelled = _run.text_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = _run.bounded(labelled.select("doc_id", "text", "lang"), "doc_id", max_train_docs)
    counts = (
        sample.select("lang", F.lower("text").alias("text"))
        .mapInArrow(_counts, "lang string, n int, hash long, times long")
        .groupBy("n", "hash", "lang")
        .agg(F.sum("times").alias("times"))
    )
    kept = counts.groupBy("n", "hash").agg(
        F.sum("times").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "times"))).alias("by")
    )
    kept = kept.where(F.col("total") >= min_count).select("n", "hash", F.explode("by").alias("lang", "times"))
    table = kept.toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    hashes, scores = [], []
    size = table.column("n").to_numpy()
    key = table.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    code = np.searchsorted(np.array(languages), np.array(table.column("lang").to_pylist())) if languages else np.zeros(0, dtype=int)
    times = table.column("times").to_numpy().astype(float)
    for n in range(LONGEST + 1):
        own = size == n
        found, at = np.unique(key[own], return_inverse=True)
        grid = np.full((len(found), len(languages)), smoothing)
        np.add.at(grid, (at, code[own]), times[own])
        hashes.append(found)
        scores.append(np.log(grid / grid.sum(axis=0)).astype(np.float32) if len(found) else grid.astype(np.float32))
    model = Model(languages, hashes, scores)
    if sum(h.nbytes + s.nbytes for h, s in zip(hashes, scores, strict=True)) > _run.SHIP_BYTES:
        raise ValueError("the model outgrew its bound: lower max_train_docs or raise min_count")
    return model


def _score_words(model: Model, data: np.ndarray, ranges: _text.Ranges, start, end, hashes) -> tuple[np.ndarray, np.ndarray]:
    """Scores by language of distinct words, and whether a word gives any evidence."""
    out = np.zeros((len(hashes), len(model.languages)), dtype=np.float64)
    known = _text.find(model.hashes[0], hashes)
    out[known >= 0] = model.scores[0][known[known >= 0]]
    open_ = np.flatnonzero(known < 0)
    for n in range(LONGEST, 0, -1):
        if not len(open_):
            break
        owner, key = _grams(data, ranges, start[open_], end[open_], n)
        at = _text.find(model.hashes[n], key)
        owner, at = owner[at >= 0], at[at >= 0]
        hits = np.bincount(owner, minlength=len(open_))
        for k in range(len(model.languages)):
            sums = np.bincount(owner, weights=model.scores[n][at, k], minlength=len(open_))
            out[open_, k] = np.where(hits > 0, sums / np.maximum(hits, 1), 0)
        open_ = open_[hits == 0]
    evidence = np.ones(len(hashes), dtype=bool)
    evidence[open_] = False
    return out, evidence


def scorer(model: Model, min_margin: float, min_evidence: float):
    """An Arrow UDF: text in lower case -> struct(lang_id, margin, evidence, accepted)."""

    def score(texts: pa.Array) -> pa.Array:
        names = np.array([*model.languages, None], dtype=object)
        best, margin, share = [], [], []
        offsets, raw = _text.buffers(texts)
        for lo, hi in _text.slices(offsets):
            rows = offsets[lo : hi + 1] - offsets[lo]
            data = raw[offsets[lo] : offsets[hi]]
            n = hi - lo
            start, end, pointers, ranges, hashes = _word_table(data, rows)
            if not len(hashes) or not model.languages:
                best.append(np.full(n, -1))
                margin.append(np.zeros(n))
                share.append(np.zeros(n))
                continue
            _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            each, evidence = _score_words(model, data, ranges, start[first], end[first], hashes[first])
            row = _text.rows_of(pointers)
            seen = np.bincount(row, weights=evidence[inverse], minlength=n)
            total = np.stack([np.bincount(row, weights=each[inverse, k], minlength=n) for k in range(each.shape[1])], axis=1)
            mean = total / np.maximum(seen, 1)[:, None]
            top = mean.argmax(axis=1)
            ordered = np.sort(mean, axis=1)
            gap = ordered[:, -1] - ordered[:, -2] if each.shape[1] > 1 else np.full(n, np.inf)
            best.append(np.where(seen > 0, top, -1))
            margin.append(np.where(seen > 0, gap, 0.0))
            share.append(seen / np.maximum(np.diff(pointers), 1))
        _run.give_back()
        code = np.concatenate([*best, np.zeros(0, dtype=int)]).astype(int)
        gap, part = np.concatenate([*margin, np.zeros(0)]), np.concatenate([*share, np.zeros(0)])
        accepted = (code >= 0) & (gap >= min_margin) & (part >= min_evidence)
        return pa.StructArray.from_arrays(
            [pa.array(names[code].tolist(), pa.string()), pa.array(gap), pa.array(part), pa.array(accepted)],
            names=["lang_id", "margin", "evidence", "accepted"],
        )

    return F.arrow_udf(score, "lang_id string, margin double, evidence double, accepted boolean").asNondeterministic()


def identify(docs: DataFrame, model: Model, min_margin: float = 0.05, min_evidence: float = 0.5, into: str = "_language") -> DataFrame:
    """docs with a struct column ``into``; every other column stays as it is.

    A text is accepted if at least ``min_evidence`` of its words give evidence and the
    best language leads by ``min_margin`` (natural log, per word).
    """
    [into] = _run.fresh(docs, into)
    return _run.text_batches(docs).withColumn(into, scorer(model, min_margin, min_evidence)(F.lower("text")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", "_language.lang_id", "_language.margin", "_language.evidence", "_language.accepted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can't be told go."""
    [own] = _run.fresh(docs, "_language")
    return identify(docs, fit(docs), into=own).where(F.col(own)["accepted"]).drop(own)
