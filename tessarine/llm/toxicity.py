"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text, over its whitespace-separated tokens:

- lexicon density: tokens in the lexicon, tokens that begin with one of its stems, and the
  log of their number;
- second-person proximity: lexicon tokens with a second-person pronoun within
  ``NEAR`` tokens, per lexicon token and per token;
- capitals: capital letters per letter, and tokens in capitals per token;
- punctuation: exclamation marks, question marks and other ASCII symbols per character;
- obfuscation: tokens with digits or symbols between letters, and lexicon tokens found only
  once look-alike characters are read as letters and symbols are dropped (``1d!0t``);
- the log of the number of tokens.

The lexicon is ``BASE`` plus words and stems (4 to 6 bytes) that the labelled sample ties to
toxic documents. One part of the sample gives the lexicon, another the trees, a third the
isotonic calibration of their output to probabilities. Fitting takes at most about
``max_train_docs`` labelled documents; of equal texts with the same label it takes one.

Case folding covers ASCII and Latin-1 letters.

Defined results: a null or empty text, or one without tokens, has probability 0. With fewer
than ``MIN_CLASS`` documents of either class in a part of the sample there is no model: the
probability is NULL and ``toxic`` false. Rows are scored on their own; repeated rows score
alike. Where docs has a column of the result's name, the result's gets an underscore. A label
counts if it is 0 or 1; a doc_id with several labels is left out. Rows with
a NULL doc_id are scored but not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm import _run, _text

BASE = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "dumb", "imbecile", "bastard", "garbage", "filth", "vermin")
PRONOUNS = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "tú", "ti", "vos", "su", "vosotros")
NEAR = 5
STEMS = (4, 5, 6)
MIN_CLASS = 10
FEATURES = ("lexicon", "stems", "hits", "near_share", "near_density", "capitals", "shouting", "exclaim", "question", "symbols", "inner", "hidden", "length")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _a, _b in zip(b"@$013457", b"asoieast", strict=True):
    _FOLD[_a] = _b
_LETTER = ~_text.NOT_LETTER
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~_LETTER & ~_DIGIT


@dataclass
class Lexicon:
    words: np.ndarray  # sorted hashes
    stems: list[np.ndarray]  # sorted hashes, by STEMS
    pronouns: np.ndarray


@dataclass
class Trees:
    feature: np.ndarray  # trees x inner nodes, of complete trees in level order
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    edges: np.ndarray  # raw score from which on ..
    values: np.ndarray  # .. the probability holds


class Tokens:
    """Folded tokens of one slice of texts."""

    def __init__(self, data: np.ndarray, rows: np.ndarray):
        self.start, self.end, self.pointers = _text.words(data, rows)
        letter = _LETTER[data]
        folded = _FOLD[data]
        wide = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        folded[wide] += 0x20
        kept = _LETTER[folded]
        place = np.concatenate([[0], np.cumsum(kept)])
        self.ranges = _text.Ranges(folded[kept])
        self.lo, self.hi = place[self.start], place[self.end]
        self.hash = self.ranges.hash(self.lo, self.hi)
        self.size = self.hi - self.lo
        self.letters = np.concatenate([[0], np.cumsum(letter)])
        at = np.arange(len(data), dtype=np.int64)
        before = np.maximum.accumulate(np.where(letter, at, -1)) if len(data) else at
        after = np.minimum.accumulate(np.where(letter, at, len(data))[::-1])[::-1] if len(data) else at
        first = np.where(len(data), after[np.minimum(self.start, max(len(data) - 1, 0))], 0) if len(data) else self.start
        last = before[self.end - 1] if len(data) else self.end
        spelled = self.letters[self.end] - self.letters[self.start]
        self.inner = (spelled > 1) & (last - first + 1 > spelled)

    def stem(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes; 0 for shorter tokens."""
        return np.where(self.size >= n, self.ranges.hash(self.lo, np.minimum(self.lo + n, self.hi)), np.uint64(0))


def _hash_words(words) -> np.ndarray:
    text = " ".join(words).encode()
    tokens = Tokens(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    return np.unique(tokens.hash)


def _slices(texts: pa.Array):
    offsets, raw = _text.buffers(texts)
    for lo, hi in _text.slices(offsets):
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]]


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi, rows, data in _slices(texts):
        t, n = Tokens(data, rows), hi - lo
        row = _text.rows_of(t.pointers)
        tokens = np.maximum(np.diff(t.pointers), 1)
        chars = np.maximum(np.diff(rows), 1)

        def per(mark, row=row, n=n):
            return np.bincount(row[mark], minlength=n)

        def share(mark, rows=rows):
            sums = np.concatenate([[0], np.cumsum(mark)])
            return sums[rows[1:]] - sums[rows[:-1]]

        word = _text.find(lexicon.words, t.hash) >= 0
        stem = np.zeros(len(word), dtype=bool)
        for size, table in zip(STEMS, lexicon.stems, strict=True):
            stem |= _text.find(table, t.stem(size)) >= 0
        hit = word | stem
        you = np.flatnonzero(_text.find(lexicon.pronouns, t.hash) >= 0)
        near = np.zeros(len(word), dtype=bool)
        if len(you):
            at = np.flatnonzero(hit)
            place = np.searchsorted(you, at)
            for other in (you[np.minimum(place, len(you) - 1)], you[np.maximum(place - 1, 0)]):
                near[at] |= (np.abs(other - at) <= NEAR) & (row[other] == row[at])
        hits = per(hit)
        upper = (data >= 65) & (data <= 90)
        ups = np.concatenate([[0], np.cumsum(upper)])
        spelled = t.letters[t.end] - t.letters[t.start]
        shout = (spelled > 1) & (ups[t.end] - ups[t.start] == spelled)
        columns = (
            per(word) / tokens, per(stem) / tokens, np.log1p(hits), per(near) / np.maximum(hits, 1), per(near) / tokens,
            share(upper) / np.maximum(share(_LETTER[data]), 1), per(shout) / tokens, share(data == 33) / chars, share(data == 63) / chars,
            share(_SYMBOL[data]) / chars, per(t.inner) / tokens, per(t.inner & hit) / tokens, np.log1p(np.diff(t.pointers)),
        )
        out[lo:hi] = np.stack(columns, axis=1)
    return out


def _word_counts(batches):
    """(kind, hash, toxic documents, clean documents) of words (kind 0) and stems."""
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
        for lo, hi, rows, data in _slices(batch.column("text")):
            t = Tokens(data, rows)
            row = _text.rows_of(t.pointers)
            for kind in (0, *STEMS):
                key = t.stem(kind) if kind else t.hash
                own = key[t.size >= max(kind, 3)]
                order = np.lexsort((row[t.size >= max(kind, 3)], own))
                own, who = own[order], row[t.size >= max(kind, 3)][order]
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (who[1:] != who[:-1])
                found, at = np.unique(own[new], return_inverse=True)
                bad = np.bincount(at, weights=toxic[lo:hi][who[new]], minlength=len(found)).astype(np.int64)
                both = np.bincount(at, minlength=len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), kind, dtype=np.int32)), pa.array(found.view(np.int64)), pa.array(bad), pa.array(both - bad)],
                    names=["kind", "hash", "toxic", "clean"],
                )


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Trees:
    """Newton boosting with the logistic loss over binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    rate_of = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(rate_of / (1 - rate_of)))
    raw = np.full(len(y), base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, cut, leaf = np.zeros((trees, inner), dtype=int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=int)
        for level in range(depth):
            for own in range(1 << level):
                mask = node == own
                gain, best = 1e-6, None
                total_g, total_h = g[mask].sum(), h[mask].sum()
                for f in range(x.shape[1]):
                    if not len(cuts[f]) or not mask.any():
                        continue
                    size = len(cuts[f]) + 1
                    left_g = np.cumsum(np.bincount(code[mask, f], g[mask], size))[:-1]
                    left_h = np.cumsum(np.bincount(code[mask, f], h[mask], size))[:-1]
                    right_g, right_h = total_g - left_g, total_h - left_h
                    value = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - total_g**2 / (total_h + penalty)
                    value[(left_h < 1e-3) | (right_h < 1e-3)] = 0
                    if value.max() > gain:
                        gain, best = value.max(), (f, cuts[f][value.argmax()])
                if best:
                    slot = (1 << level) - 1 + own
                    feature[k, slot], cut[k, slot] = best
            slot = (1 << level) - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[k, slot]] >= cut[k, slot])
        sums_g, sums_h = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[k] = rate * sums_g / (sums_h + penalty)
        raw += leaf[k, node]
    return Trees(feature, cut, leaf, base)


def predict(trees: Trees, x: np.ndarray) -> np.ndarray:
    raw, at = np.full(len(x), trees.base), np.arange(len(x))
    depth = int(np.log2(trees.leaf.shape[1]))
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        node = np.zeros(len(x), dtype=int)
        for level in range(depth):
            slot = (1 << level) - 1 + node
            node = 2 * node + (x[at, feature[slot]] >= cut[slot])
        raw += leaf[node]
    return raw


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores from which on, probabilities), both ascending."""
    xs, at = np.unique(raw, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []
    for x, w, s in zip(xs, weight, total, strict=True):
        blocks.append([x, w, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, w2, s2 = blocks.pop()
            blocks[-1][1] += w2
            blocks[-1][2] += s2
    return np.array([b[0] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = 12_000, min_toxic: int = 5, min_ratio: float = 20.0) -> Model | None:
    """A model of docs(doc_id, text) with labels(doc_id, toxic), or None without enough of them."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    usable = usable.where("toxic = most").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = _run.bounded(usable, "doc_id", max_train_docs)  # at most that many narrow rows are broadcast
    sample = _run.text_batches(docs).select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id"))
    sample = _run.written(sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(20))))
    sizes = {r["toxic"]: r["n"] for r in sample.where("part < 10").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < MIN_CLASS:
        return None
    counts = sample.where("part < 10").select("toxic", "text").mapInArrow(_word_counts, "kind int, hash long, toxic long, clean long")
    counts = counts.groupBy("kind", "hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") / sizes[1]) / ((F.col("clean") + 0.5) / sizes[0])
    table = counts.where((F.col("toxic") >= min_toxic) & (ratio >= min_ratio)).select("kind", "hash").toArrow()
    kind, key = table.column("kind").to_numpy(), table.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    lexicon = Lexicon(np.unique(np.concatenate([_hash_words(BASE), key[kind == 0]])), [np.unique(key[kind == n]) for n in STEMS], _hash_words(PRONOUNS))
    rest = sample.where("part >= 10").select("doc_id", "part", "toxic", _featured(lexicon)("text").alias("x")).orderBy("doc_id").toArrow()
    y = rest.column("toxic").to_numpy().astype(float)
    x = np.array(rest.column("x").to_pylist()).reshape(-1, len(FEATURES))
    grown = rest.column("part").to_numpy() < 16
    if any(min(y[m].sum(), (1 - y[m]).sum()) < MIN_CLASS / 2 for m in (grown, ~grown)):
        return None
    trees = grow(x[grown], y[grown])
    return Model(lexicon, trees, *isotonic(predict(trees, x[~grown]), y[~grown]))


def _featured(lexicon: Lexicon):
    def featured(texts: pa.Array) -> pa.Array:
        x = features(texts, lexicon)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))

    return F.arrow_udf(featured, "array<double>")


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5, into: str = "toxicity") -> DataFrame:
    """docs with a struct column ``into`` of probability and toxic."""
    kind = "struct<probability: double, toxic: boolean>"
    [into] = _run.fresh(docs, into)
    if model is None:
        return docs.withColumn(into, F.struct(F.lit(None).cast("double").alias("probability"), F.lit(False).alias("toxic")))

    def scored(texts: pa.Array) -> pa.Array:
        x = features(texts, model.lexicon)
        at = np.searchsorted(model.edges, predict(model.trees, x), side="right") - 1
        p = np.where(x[:, -1] > 0, model.values[np.maximum(at, 0)], 0.0)
        return pa.StructArray.from_arrays([pa.array(p), pa.array(p >= threshold)], names=["probability", "toxic"])

    return docs.withColumn(into, F.arrow_udf(scored, kind).asNondeterministic()("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", "toxicity.probability", "toxicity.toxic")
