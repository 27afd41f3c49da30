"""Benchmark decontamination with suffix arrays over the training text.

Each slice of the documents (``SHARD_BYTES`` of text) is a shard with a suffix array of
its own: the word suffixes of its documents, sorted by word hashes to the depth of the
longest benchmark item (prefix doubling, only ties are sorted again). Every suffix of
every item is binary-searched in every shard for the interval of training suffixes that
share its first ``min(min_words, words of the item)`` words; each of them is extended to
its longest verbatim match. No task sees more than one shard, and no suffix is skipped.

The benchmark is broadcast in slices of ``ITEM_BYTES`` of text. A shard's suffix array is
built once and every slice is searched in it, one slice in memory at a time.

Words are runs of characters other than blank, tab, newline, form feed and carriage
return, in lower case. A document is affected by an item if they share a run of at
least ``min_words`` words, or the whole item where it is shorter. Items of fewer than
``min_item_words`` words are too common to be evidence and never match.

Defined results: null and empty texts (and items) match nothing. For each row and item
the longest match is reported; among equals the one that begins first in the document,
then first in the item. Positions count words from 0. Repeated rows have repeated
matches; repeated items are reported by their own ids (a NULL item_id as NULL). An
empty documents or benchmark table gives no matches. Where docs has a column of the result's
name, the result's gets an underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm import _run, _text

SHARD_BYTES = 4 << 20
#: Largest slice of the benchmark, in bytes of text, that a task holds at once.
ITEM_BYTES = 8 << 20
MATCH = "array<struct<item_id: bigint, words: int, doc_word: int, item_word: int>>"
_END = np.uint64(0)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array, and the pointers of its rows."""
    offsets, raw = _text.buffers(texts)
    hashes, pointers = [], [np.zeros(1, dtype=np.int64)]
    base = 0
    for lo, hi in _text.slices(offsets):
        rows = offsets[lo : hi + 1] - offsets[lo]
        data = raw[offsets[lo] : offsets[hi]]
        start, end, at = _text.words(data, rows)
        hashes.append(_text.Ranges(data).hash(start, end))
        pointers.append(at[1:] + base)
        base += len(start)
    return np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)]), np.concatenate(pointers)


class Suffixes:
    """Word suffixes of some rows: hashes, words left in the row, and prefix sums for equality."""

    def __init__(self, hashes: np.ndarray, pointers: np.ndarray):
        self.hashes, self.pointers = hashes, pointers
        self.row = _text.rows_of(pointers)
        self.left = pointers[1:][self.row] - np.arange(len(hashes))
        self._ranges = _text.Ranges(hashes)
        #: What suffixes are ordered by: 32 bits a word, above 0, the end of a row.
        self.symbol = np.maximum(hashes >> np.uint64(32), np.uint64(1))

    def at(self, position: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The symbol that comes ``depth`` words into a suffix."""
        inside = depth < self.left[position]
        return np.where(inside, self.symbol[np.where(inside, position + depth, 0)], _END)

    def pair(self) -> np.ndarray:
        """The first two symbols of each suffix as one key."""
        position = np.arange(len(self.hashes))
        return (self.symbol << np.uint64(32)) | self.at(position, np.ones(len(position), dtype=np.int64))

    def hash(self, position: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self._ranges.hash(position, position + length)


def suffix_array(own: Suffixes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, sorted two-word keys): suffixes in the order of their first ``depth`` symbols."""
    key = own.pair()
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    k = 2
    rank = np.empty(len(order), dtype=np.int64)
    while k < depth:
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank[order] = head
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        position = order[slots]
        inside = k < own.left[position]
        follow = np.where(inside, rank[np.where(inside, position + k, 0)] + 1, 0)
        composite = (head[slots] << 32) | follow
        sort = np.argsort(composite, kind="stable")
        order[slots] = position[sort]
        composite = composite[sort]
        new[slots[1:]] |= composite[1:] != composite[:-1]
        k *= 2
    return order, sorted_key


def common_length(train: Suffixes, a: np.ndarray, test: Suffixes, b: np.ndarray) -> np.ndarray:
    """Words that suffixes a (training) and b (test) have in common at their beginning."""
    most = np.minimum(train.left[a], test.left[b])
    length = np.zeros(len(a), dtype=np.int64)
    step = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
    while step:
        longer = length + step
        fits = longer <= most
        used = np.where(fits, longer, 0)
        length = np.where(fits & (train.hash(a, used) == test.hash(b, used)), longer, length)
        step >>= 1
    return length


def _bound(train: Suffixes, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, test: Suffixes, q: np.ndarray, depth: np.ndarray, upper: bool):
    """First slot in lo .. hi whose suffix isn't below (upper: is above) the first ``depth`` words of q."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        suffix, own = order[mid], q[open_]
        common = np.minimum(common_length(train, suffix, test, own), depth[open_])
        ended = common == depth[open_]
        below = np.where(ended, upper, train.at(suffix, common) < test.at(own, common))
        lo[open_] = np.where(below, mid + 1, lo[open_])
        hi[open_] = np.where(below, hi[open_], mid)


def search(train: Suffixes, order: np.ndarray, keys: np.ndarray, test: Suffixes, queries: np.ndarray, depth: np.ndarray):
    """(row, item row, words, word of the row, word of the item) of the longest match of each pair.

    order and keys: the suffix array of ``train``, sorted at least to the largest ``depth``.
    """
    single = depth == 1
    rest = np.uint64(0xFFFFFFFF)
    least = np.where(single, test.symbol[queries] << np.uint64(32), test.pair()[queries])
    lo, hi = np.searchsorted(keys, least, "left"), np.searchsorted(keys, np.where(single, least | rest, least), "right")
    some = lo < hi
    queries, depth, lo, hi = queries[some], depth[some], lo[some], hi[some]
    first = _bound(train, order, lo, hi, test, queries, depth, False)
    last = _bound(train, order, first, hi, test, queries, depth, True)
    owner, slot = _text.spread(first, last - first)
    suffix, q = order[slot], queries[owner]
    words = common_length(train, suffix, test, q)
    row, item = train.row[suffix], test.row[q]
    doc_word, item_word = suffix - train.pointers[row], q - test.pointers[item]
    best = np.lexsort((item_word, doc_word, -words, item, row))
    keep = np.ones(len(best), dtype=bool)
    keep[1:] = (row[best][1:] != row[best][:-1]) | (item[best][1:] != item[best][:-1])
    best = best[keep]
    return row[best], item[best], words[best], doc_word[best], item_word[best]


class Items:
    """A slice of the benchmark: its suffixes that can begin a match."""

    def __init__(self, ids: list, texts: list, min_words: int, min_item_words: int):
        self.ids = ids
        self.hashes, self.pointers = _word_hashes(pa.array(texts, pa.string()))
        size = np.diff(self.pointers)
        need = np.minimum(size, min_words)
        row = _text.rows_of(self.pointers)
        left = self.pointers[1:][row] - np.arange(len(row))
        self.queries = np.flatnonzero((size[row] >= min_item_words) & (left >= need[row]))
        self.depth = need[row][self.queries]
        self.deepest = int(self.depth.max(initial=0))


def items(benchmark: DataFrame, min_words: int, min_item_words: int) -> list[Items]:
    """The benchmark in slices of at most ITEM_BYTES; it is read through the driver row by row."""
    out, ids, texts, size = [], [], [], 0
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.lower("text")).toLocalIterator()
    for item_id, text in rows:
        if texts and size + len(text) > ITEM_BYTES:
            out.append(Items(ids, texts, min_words, min_item_words))
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(text)
        size += len(text)
    return [*out, Items(ids, texts, min_words, min_item_words)] if texts else out


def _matcher(parts: list[Items], spark):
    # as plain arrays: executors have no copy of this package to read a class from
    shipped = [spark.sparkContext.broadcast((p.ids, p.hashes, p.pointers, p.queries, p.depth)) for p in parts if len(p.queries)]
    deepest = max((part.deepest for part in parts), default=0)

    def loaded(part):
        """A slice, which isn't kept beyond its use where there are several."""
        own = part.value
        if len(shipped) > 1 and getattr(part, "_path", None):
            del part._value
        return own

    def match(texts: pa.Array) -> pa.Array:
        found = []
        offsets, _ = _text.buffers(texts)
        for lo, hi in _text.slices(offsets, SHARD_BYTES):
            train = Suffixes(*_word_hashes(texts.slice(lo, hi - lo)))
            if not len(train.hashes) or not shipped:
                continue
            order, keys = suffix_array(train, deepest)
            several = []
            for ids, hashes, pointers, queries, depth in map(loaded, shipped):
                row, item, *rest = search(train, order, keys, Suffixes(hashes, pointers), queries, depth)
                several.append((row + lo, np.array(ids, dtype=object)[item], *rest))
            row, *rest = (np.concatenate(x) for x in zip(*several, strict=True))
            sort = np.argsort(row, kind="stable")
            found.append((row[sort], *(x[sort] for x in rest)))
        _run.give_back()
        row, item, words, doc_word, item_word = (np.concatenate([np.zeros(0, dtype=object if k == 1 else np.int64), *(x[k] for x in found)]) for k in range(5))
        pointers = np.searchsorted(row.astype(np.int64), np.arange(len(texts) + 1))
        values = pa.StructArray.from_arrays(
            [pa.array(item.tolist(), pa.int64()), *(pa.array(x.astype(np.int32)) for x in (words, doc_word, item_word))],
            names=["item_id", "words", "doc_word", "item_word"],
        )
        return pa.ListArray.from_arrays(pa.array(pointers.astype(np.int32)), values)

    return F.arrow_udf(match, MATCH).asNondeterministic()


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_item_words: int = 5, into: str = "matches") -> DataFrame:
    """docs with the longest match of each item in the array column ``into``."""
    if min_words < 1 or min_item_words < 1:
        raise ValueError("min_words and min_item_words are at least 1")
    _run.text_batches(docs)
    [into] = _run.fresh(docs, into)
    return docs.withColumn(into, _matcher(items(benchmark, min_words, min_item_words), docs.sparkSession)(F.lower("text")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.words", "m.doc_word", "m.item_word")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a passage of the benchmark go."""
    [own] = _run.fresh(docs, "_matches")
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=own)
    return found.where(F.size(own) == 0).drop(own)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\t\n\f\r ]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\t\n\f\r ]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS p FROM b WHERE len(w) >= 5),
hits AS (
  SELECT doc_id, item_id, n, dw.p AS doc_word, bw.p AS item_word,
         dw.p - row_number() OVER (PARTITION BY doc_id, item_id, dw.p - bw.p ORDER BY dw.p) AS island
  FROM dw JOIN bw USING (word)),
runs AS (
  SELECT doc_id, item_id, n, min(doc_word) AS doc_word, min(item_word) AS item_word, count(*) AS words
  FROM hits GROUP BY doc_id, item_id, n, doc_word - item_word, island),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, doc_word, item_word) AS k
  FROM runs WHERE words >= least(13, n))
SELECT doc_id, item_id, words::INTEGER AS words, doc_word::INTEGER AS doc_word, item_word::INTEGER AS item_word
FROM best WHERE k = 1
"""
