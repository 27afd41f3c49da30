"""N-gram Jaccard join: documents whose word n-gram sets overlap enough.

A document's set are the n-grams of its words (runs of characters other than blank, tab,
newline, form feed and carriage return, lower case); one of fewer than n words has all of
them as its only element. Documents with equal sets form a class; classes are joined. The
query ``linked`` has one row for each document: the group that links connect it with, and
its number of links, copies counted one by one. ``all_pairs`` has the pairs of classes and
the membership instead. Neither unfolds pairs of copies.

1. Sets that can be similar are found by prefixes. All n-grams have one order, by the number of
   sets that have them, then by hash; two sets of similarity t or more share one among the first
   size - ceil(t * size) + 1 of each. N-grams of one set alone come first and tie nothing, so a
   set with enough of them is done. A shared one ties two sets if the rest of both after its
   place leaves room for the needed overlap; among more than ``PAIRED`` sets it ties all whose
   sizes can meet. Connected components of ties (min-label propagation with pointer jumping, each
   round a written table, until nothing moves) become the partitions of the join. No pair is lost.
   The n-grams travel as packed arrays, by bucket to be counted and back to their sets.
2. In each partition the sets are packed, by size and min-hash, into a signature tree. A leaf
   is one set, a node holds the OR of its children's token bitmaps and their range of sizes.
   The tree is traversed against itself level by level; a pair of nodes is dropped if its
   sizes alone, or the bits that both bitmaps have, leave no room for the needed overlap.
3. Surviving leaf pairs are counted exactly, and reduced in their task: to sums of links and
   a spanning forest. What leaves a task grows with its sets, not with their pairs.

Sets of a component are cut into blocks by octave of their size and, where an octave has more
than ``block`` sets, by hash; pairs of blocks whose sizes can meet are tasks of their own, so
no task holds a whole large component.

Defined results: a document is a doc_id and a set. Rows that repeat both are one document; a
doc_id that repeats with another set is another document of the same id, with a row (or pairs)
of its own. Rows with a NULL doc_id join nothing and have no row; documents without words
(null or empty texts) have a row without links. Pairs are (smaller, larger) doc_id. Sets are
told apart by 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm import _run, _text

FANOUT = 8
#: N-grams of sets that are sent off together, and their most sets: a set's number has two bytes.
CHUNK_TOKENS, CHUNK_SETS = 1 << 21, 1 << 16
#: N-grams of one bucket, about.
BUCKET_TOKENS = 1 << 20
#: Most sets with a shared n-gram that are looked at pair by pair.
PAIRED = 16
#: Pairs of nodes that are looked at in one step of the traversal.
FRONTIER = 1 << 16


def sets_of(texts: pa.Array, n: int):
    """(first row, sets) of slices of lower-case texts."""
    offsets, raw = _text.buffers(texts)
    for lo, hi in _text.slices(offsets):
        rows = offsets[lo : hi + 1] - offsets[lo]
        data = raw[offsets[lo] : offsets[hi]]
        start, end, pointers = _text.words(data, rows)
        yield lo, _text.shingles(_text.Ranges(data).hash(start, end), pointers, n)


def node_of(own: np.ndarray) -> int:
    """The id of a set."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_hash, node, size) of the documents that have words."""

    def signed(batches):
        for batch in batches:
            for lo, found in sets_of(batch.column("text"), n):
                _run.give_back()
                at = [k for k, own in enumerate(found) if len(own)]
                if not at:
                    continue
                rows_at = pa.array(np.array(at) + lo)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(rows_at),
                        "text_hash": batch.column("text_hash").take(rows_at),
                        "node": pa.array([node_of(found[k]) for k in at], pa.int64()),
                        "size": pa.array(np.array([len(found[k]) for k in at], dtype=np.int32)),
                    }
                )

    return _texts(_run.text_batches(docs)).mapInArrow(signed, "doc_id long, text_hash long, node long, size int")


def _runs(batches, key: str):
    """The rows of each value of ``key``, of batches sorted by it, as lists of columns."""
    now, held = None, []
    for batch in batches:
        at = batch.schema.get_field_index(key)
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[at] != now:
                yield now, list(zip(*held, strict=True))
                held = []
            now = row[at]
            held.append(row)
    if held:
        yield now, list(zip(*held, strict=True))


_PARTS = "bucket int, chunk long, low binary, row binary, times binary, nodes binary, sizes binary"


def _parts(bucket, chunk, low, row, times=None, nodes=None, sizes=None) -> pa.RecordBatch:
    empty = [None] * len(bucket)
    columns = [pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), *(pa.array(x or empty, pa.binary()) for x in (low, row, times, nodes, sizes))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PARTS.split(", ")])


def _joined(parts, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in parts if x is not None), dtype=kind)


def prefixes(texts: DataFrame, n: int, threshold: float, buckets: int) -> DataFrame:
    """(key, node, size, place): the n-grams that more than one set has, of the prefix of each set, and their places in it.

    A key is a bucket and 32 bits of a hash. Where n-grams share a key, all count as often as the key does, which
    changes their order, the same for all sets, and may tie more.
    """

    def cut(batches):
        from pyspark import TaskContext

        chunk, own, size = TaskContext.get().partitionId() << 32, {}, 0

        def emit():
            nonlocal chunk, size
            sizes = np.array([len(x) for x in own.values()], dtype="<u4")
            flat = np.concatenate(list(own.values()))
            bucket = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            low, row = flat.astype("<u4")[order], np.repeat(np.arange(len(sizes)), sizes).astype("<u2")[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            some = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
            yield _parts([b for b, _, _ in some], [chunk] * len(some), [low[lo:hi].tobytes() for _, lo, hi in some], [row[lo:hi].tobytes() for _, lo, hi in some])
            nodes = np.array(list(own), dtype="<i8")
            yield _parts([chunk % buckets], [chunk], None, None, None, [nodes.tobytes()], [sizes.tobytes()])
            chunk, size = chunk + 1, 0
            own.clear()
            _run.give_back()

        for batch in batches:
            for _, found in sets_of(batch.column("text"), n):
                for x in found:
                    if len(x) and (node := node_of(x)) not in own:
                        own[node] = x
                        size += len(x)
                        if size >= CHUNK_TOKENS or len(own) == CHUNK_SETS:
                            yield from emit()
        if own:
            yield from emit()

    def counted(batches):
        for bucket, (_, chunks, lows, rows, _, nodes, sizes) in _runs(batches, "bucket"):
            whole = [k for k, x in enumerate(nodes) if x is not None]
            if whole:
                yield _parts([bucket] * len(whole), [chunks[k] for k in whole], None, None, None, [nodes[k] for k in whole], [sizes[k] for k in whole])
            low, row = _joined(lows, "<u4"), _joined(rows, "<u2")
            part = np.repeat(np.arange(len(lows)), [len(x or b"") // 4 for x in lows])
            _, at, times = np.unique(low, return_inverse=True, return_counts=True)
            keep = np.flatnonzero(times[at] > 1)
            low, row, times = low[keep], row[keep], np.minimum(times[at[keep]], 0xFFFF).astype("<u2")
            cuts = np.searchsorted(part[keep], np.arange(len(lows) + 1)).tolist()
            some = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
            yield _parts([bucket] * len(some), [chunks[k] for k, _, _ in some], *([x[lo:hi].tobytes() for _, lo, hi in some] for x in (low, row, times)))
            _run.give_back()

    def placed(batches):
        for _, (bucket, _, lows, rows, times, nodes, sizes) in _runs(batches, "chunk"):
            node, size = _joined(nodes, "<i8"), _joined(sizes, "<u4").astype(np.int64)
            low, row, times = _joined(lows, "<u4"), _joined(rows, "<u2"), _joined(times, "<u2")
            key = np.repeat(np.array(bucket, dtype=np.int64), [len(x or b"") // 4 for x in lows]) << 32 | low
            order = np.lexsort((key, times, row))
            key, row = key[order], row[order].astype(np.int64)
            count = np.bincount(row, minlength=len(node))
            place = (size - np.cumsum(count))[row] + np.arange(len(row))
            keep = place <= (size - np.ceil(threshold * size - 1e-9))[row]
            row = row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[row]), pa.array(size[row]), pa.array(place[keep])], names=["key", "node", "size", "place"])
            _run.give_back()

    sent = _run.text_batches(texts).mapInArrow(cut, _PARTS).repartition("bucket").sortWithinPartitions("bucket")
    back = sent.mapInArrow(counted, _PARTS).repartition("chunk").sortWithinPartitions("chunk")
    return back.mapInArrow(placed, "key long, node long, size long, place long")


def ties(keys: DataFrame, threshold: float) -> DataFrame:
    """(a, b): nodes that a shared key ties together."""

    def tied(batches):
        held: list[tuple[np.ndarray, ...]] = []
        before = None  # key, head of its sizes that meet, last size: of a long run that has begun

        def ties_of(rows, last: bool):
            nonlocal before
            key, node, size, place = rows
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(fresh)
            long = np.diff(first, append=len(key)) > PAIRED
            if before is not None:
                long[0] |= key[0] == before[0]
            done = len(key) if last or long[-1] else int(first[-1])
            long = np.repeat(long, np.diff(first, append=len(key)))
            out = []
            for d in range(1, PAIRED):
                i = np.flatnonzero((key[d:done] == key[: max(done - d, 0)]) & ~long[d:done])
                j = i + d
                needed = threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9
                near = np.minimum(size[i] - place[i], size[j] - place[j]) >= needed
                out.append((node[i[near]], node[j[near]]))
            at = np.flatnonzero(long)
            if len(at):
                begins, previous, heads = fresh[at].copy(), np.concatenate([size[at[:1]], size[at[:-1]]]), np.concatenate([node[at[:1]], node[at]])
                if before is not None and key[at[0]] == before[0]:
                    begins[0], heads[0], previous[0] = False, before[1], before[2]
                begins |= previous < threshold * size[at] - 1e-9
                head = heads[np.maximum.accumulate(np.where(begins, np.arange(1, len(at) + 1), 0))]
                out.append((head, node[at]))
            before = (key[-1], head[-1], size[-1]) if long[-1] else None
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = a != b
            new[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"]), tuple(x[done:] for x in rows)

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            if sum(len(x[0]) for x in held) >= FRONTIER:
                found, rest = ties_of(tuple(map(np.concatenate, zip(*held, strict=True))), False)
                held = [rest]
                yield found
        if sum(len(x[0]) for x in held):
            yield ties_of(tuple(map(np.concatenate, zip(*held, strict=True))), True)[0]

    return keys.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(tied, "a long, b long")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): the rows that can join, in lower case."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.lower("text").alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of the component of each end of edges(a, b).

    Labels only fall, so the rounds end; pointer jumping makes them about the log of the longest path.
    """
    both = _run.written(edges.union(edges.select("b", "a")).distinct())
    labels = _run.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        lower = _run.written(lower)
        up = lower.select(F.col("id").alias("low"), F.col("low").alias("up"))
        least = F.least("low", "up")
        moved = _run.written(lower.join(up, "low").select("id", least.alias("label"), (F.col("label") != least).alias("moved")))
        _run.forget(lower, labels)
        labels = moved
        if labels.where("moved").isEmpty():
            _run.forget(both)
            return labels.select("id", "label")


class Tree:
    """Signature tree of some sets: per level, OR of bitmaps, sizes from .. to, and most tokens that share a bit."""

    def __init__(self, own: list[np.ndarray]):
        size = np.array([len(s) for s in own])
        self.order = np.lexsort(([int(s[0]) for s in own], size))
        size = size[self.order]
        bits = 1 << int(np.clip(int(4 * size[-1]).bit_length(), 6, 13))
        flat = np.concatenate([own[k] for k in self.order])
        row = np.repeat(np.arange(len(own)), size)
        bit = (flat >> np.uint64(40)).astype(np.int64) & (bits - 1)
        bitmap = np.zeros((len(own), bits // 64), dtype=np.uint64)
        np.bitwise_or.at(bitmap, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        shared = size - np.bitwise_count(bitmap).sum(axis=1)
        self.levels = [(bitmap, size, size, shared)]
        while len(self.levels[-1][0]) > 1:
            bitmap, low, high, shared = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(bitmap, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(shared, cut))
            )

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether nodes a and b can hold a pair of sets of at least this similarity."""
        bitmap, low, high, shared = self.levels[level]
        fits = (high[a] >= threshold * low[b] - 1e-9) & (high[b] >= threshold * low[a] - 1e-9)
        needed = threshold / (1 + threshold) * (low[a] + low[b])
        at = np.flatnonzero(fits)
        common = np.bitwise_count(bitmap[a[at]] & bitmap[b[at]]).sum(axis=1)
        room = common + np.minimum(shared[a[at]], shared[b[at]])
        fits[at] = (room >= needed[at] - 1e-9) & (np.minimum(high[a[at]], high[b[at]]) >= needed[at] - 1e-9)
        return fits

    def pairs(self, threshold: float):
        """Pairs (a < b) of leaves that no bound rules out, in parts."""
        root = len(self.levels) - 1
        stack = [(root, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONTIER:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            keep = self.possible(level, a, b, threshold)
            a, b = a[keep], b[keep]
            if level == 0:
                other = a < b
                yield a[other], b[other]
                continue
            below = len(self.levels[level - 1][0])
            left, right = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
            a, b = (a[:, None] * FANOUT + left).ravel(), (b[:, None] * FANOUT + right).ravel()
            inside = (a < below) & (b < below) & (a <= b)
            a, b = a[inside], b[inside]
            if len(a):
                stack.append((level - 1, a, b))


def similar(own: list[np.ndarray], threshold: float, wanted=None):
    """(i, j, similarity) of all pairs of sets with at least this similarity, by tree and exact counts.

    wanted: a function of (i, j) that says which pairs belong to this task.
    """
    tree = Tree(own)
    size = np.array([len(s) for s in own])
    pointers = np.concatenate([[0], np.cumsum(size)])
    _, token = np.unique(np.concatenate(own), return_inverse=True)
    flag = np.zeros(int(token.max(initial=0)) + 1, dtype=np.uint8)
    out = []
    for a, b in tree.pairs(threshold):
        i, j = tree.order[a], tree.order[b]
        if wanted is not None:
            mine = wanted(i, j)
            i, j = i[mine], j[mine]
        sort = np.argsort(i, kind="stable")
        i, j = i[sort], j[sort]
        for part in np.split(np.arange(len(i)), np.flatnonzero(i[1:] != i[:-1]) + 1):
            if not len(part):
                continue
            first, others = i[part[0]], j[part]
            tokens = token[pointers[first] : pointers[first + 1]]
            flag[tokens] = 1
            _, at = _text.spread(pointers[others], size[others])
            common = np.add.reduceat(flag[token[at]], np.cumsum(size[others]) - size[others], dtype=np.int64)
            flag[tokens] = 0
            value = common / (size[first] + size[others] - common)
            hit = value >= threshold
            out.append((np.full(int(hit.sum()), first), others[hit], value[hit]))
    return [np.concatenate([*(x[k] for x in out), np.zeros(0, dtype=t)]) for k, t in enumerate((int, int, float))]


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs tie together what no pair before them did."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = top[up]
            x = up
        return x

    keep = np.zeros(len(a), dtype=bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        keep[k] = x != y
        top[y] = x
    return keep


def _task(nodes: list, texts: list, blocks: list, copies: list, left: int, right: int, n: int, threshold: float):
    """(node, node, similarity, copies of each) of the pairs of one task: rows of the blocks left and right of one component."""
    own, keep, seen = [], [], set()
    for lo, found in sets_of(pa.array(texts, pa.large_string()), n):
        for k, s in enumerate(found):
            if len(s) and nodes[lo + k] not in seen and node_of(s) == nodes[lo + k]:
                seen.add(nodes[lo + k])
                own.append(s)
                keep.append(lo + k)
    if len(own) < 2:
        return None
    block, node, times = np.array(blocks)[keep], np.array(nodes, dtype=np.int64)[keep], np.array(copies, dtype=np.int64)[keep]
    wanted = None if left == right else lambda i, j: block[i] != block[j]
    i, j, value = similar(own, threshold, wanted)
    return node[i], node[j], value, times[i], times[j]


def _pairs_of(a, b, value, copies_a, copies_b):
    """Rows of a task: its pairs."""
    return a, b, value, np.ones(len(a), dtype=np.int64)


def _links_of(a, b, value, copies_a, copies_b):
    """Rows of a task: the linked documents of each node (as a pair with itself), and a spanning forest (with no count)."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    links = np.zeros(len(node), dtype=np.int64)
    np.add.at(links, at, np.concatenate([copies_b, copies_a]))
    tied = _forest(a, b)
    return np.concatenate([node, a[tied]]), np.concatenate([node, b[tied]]), np.concatenate([np.ones(len(node)), value[tied]]), np.concatenate([links, np.zeros(tied.sum(), dtype=np.int64)])


def _verify(n: int, threshold: float, reduce):
    def verified(batches):
        key, rows = None, ([], [], [], [])
        done = []

        def finish():
            if len(rows[0]) > 100:
                _run.give_back()
            if key is not None and len(rows[0]) > 1 and (found := _task(*rows, key[1], key[2], n, threshold)):
                done.append(reduce(*found))

        def emit():
            columns = [pa.array(np.concatenate(x)) for x in zip(*done, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["node_a", "node_b", "jaccard", "links"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "left", "right", "node", "text", "block", "copies")]
            for component, left, right, *values in zip(*columns, strict=True):
                if (component, left, right) != key:
                    finish()
                    key, rows = (component, left, right), ([], [], [], [])
                    if len(done) > 200 or sum(len(x[0]) for x in done) > 100_000:
                        yield emit()
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
        finish()
        if done:
            yield emit()

    return verified


def join(
    docs: DataFrame, reduce=_pairs_of, n: int = 3, threshold: float = 0.5, block: int = 4096, scratch: list | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, classes, members) of docs(doc_id, text). The written tables that they read are added to ``scratch``.

    found(node_a, node_b, jaccard, links): what ``reduce`` leaves of the pairs of classes with threshold <= similarity < 1.
    classes(node, doc_id, text_hash, copies, size): the smallest document of each class, and the number of its documents.
    members(doc_id, text_hash, node): the text or texts of every document that has words.
    """
    signed = _run.written(signatures(docs, n))
    members = signed.select("doc_id", "text_hash", "node", "size").distinct()
    once = members.groupBy("node", "doc_id").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"))
    classes = once.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("low"), F.count("*").alias("copies"), F.first("size").alias("size"))
    classes = _run.written(classes.select("node", "low.doc_id", "low.text_hash", "copies", "size"))
    # one text of each class is enough; if there are too many copies to ship their list, they are counted along
    copies = once.join(classes.select("node", F.col("doc_id").alias("low")), "node").where("doc_id != low").select("doc_id", "text_hash")
    texts = _texts(docs)
    if copies.count() * 64 <= _run.SHIP_BYTES:
        texts = texts.join(F.broadcast(copies), ["doc_id", "text_hash"], "left_anti")
    tokens = classes.agg(F.sum("size")).first()[0] or 0
    labels = components(ties(prefixes(texts.select("text"), n, threshold, tokens // BUCKET_TOKENS + 1), threshold))
    octave = F.floor(F.log2("size")).cast("long")
    grouped = labels.select(F.col("id").alias("node"), F.col("label").alias("component")).join(classes, "node").withColumn("octave", octave)
    parts = grouped.groupBy("component", "octave").agg(F.ceil(F.count("*") / block).alias("parts")).where("parts > 1")
    grouped = _run.join_small(grouped, parts, ["component", "octave"], "left")
    number = F.col("octave") * (1 << 32) + F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    placed = _run.written(grouped.select("component", "node", "doc_id", "text_hash", "copies", "size", number.alias("block")))
    if scratch is not None:
        scratch += [signed, classes, labels, placed]
    spans = placed.groupBy("component", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    right = spans.select("component", F.col("block").alias("right"), F.col("low").alias("low_right"), F.col("high").alias("high_right"))
    tasks = spans.withColumnRenamed("block", "left").join(right, "component")
    tasks = tasks.where((F.col("left") <= F.col("right")) & (F.col("high") >= threshold * F.col("low_right") - 1e-9) & (F.col("high_right") >= threshold * F.col("low") - 1e-9))
    tasks = tasks.select("component", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    wanted = placed.join(tasks, ["component", "block"]).select("component", "left", "right", "block", "doc_id", "text_hash", "node", "copies")
    work = _run.join_small(_texts(docs), wanted, ["doc_id", "text_hash"]).repartition("component", "left", "right").sortWithinPartitions("component", "left", "right", "node")
    found = work.select("component", "left", "right", "node", "text", "block", "copies").mapInArrow(
        _verify(n, threshold, reduce), "node_a long, node_b long, jaccard double, links long"
    )
    return found, classes, members.select("doc_id", "text_hash", "node")


def all_pairs(docs: DataFrame, **options) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard): pairs of classes by their smallest doc_ids, and each class's smallest with its others."""
    pairs, classes, members = join(docs, **options)
    low = classes.select(F.col("node").alias("node_a"), F.col("doc_id").alias("a"))
    near = pairs.join(low, "node_a").join(low.withColumnsRenamed({"node_a": "node_b", "a": "b"}), "node_b").where("a != b")
    near = near.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"), F.round("jaccard", 9).alias("jaccard"))
    equal = members.select("doc_id", F.col("node").alias("node_a")).join(low, "node_a").where("doc_id != a")
    return near.unionByName(equal.select(F.col("a").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))).distinct()


def groups(docs: DataFrame, scratch: list, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, classes, members) as ``join`` has them with links, classes with the ``root`` node of their group."""
    found, classes, members = join(docs, _links_of, scratch=scratch, **options)
    found = _run.written(found)
    labels = components(found.where("node_a != node_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    scratch += [found, labels]
    return found, classes.join(labels.withColumnsRenamed({"id": "node", "label": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node")), members


def linked(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, links) of each document of docs(doc_id, text).

    class_id is the smallest doc_id of the documents that links connect, directly or through
    others; links are the other documents of at least the threshold's similarity, copies too.
    """
    found, classes, members = groups(docs, [], **options)
    links = found.where("node_a = node_b").groupBy(F.col("node_a").alias("node")).agg(F.sum("links").alias("near"))
    low = classes.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    each = classes.join(low, "root").join(links, "node", "left")
    each = each.select("node", "class_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    with_words = members.select("doc_id", "node").distinct().join(each, "node").select("doc_id", "class_id", "links")
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    rest = ids.join(with_words.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return with_words.unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked(docs)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of similar ones: that with the smallest doc_id.

    Decided by doc_id and text, so of a doc_id with several texts each has its own fate. Documents
    without words and rows without a doc_id stay; of rows that repeat a doc_id and a text one stays.
    """
    scratch: list[DataFrame] = []
    _, classes, members = groups(docs.select("doc_id", "text"), scratch, **options)
    key, text = _run.fresh(docs, "_id", "_text")
    first = F.min(F.struct("doc_id", "text_hash"))
    alone = classes.groupBy("root").agg(first.alias("kept"))
    fate = members.join(classes.select("node", "root"), "node").join(alone, "root")
    gone = _run.written(fate.where("doc_id != kept.doc_id OR text_hash != kept.text_hash").select(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).distinct())
    _run.forget(*scratch)
    ids = docs.groupBy(F.col("doc_id").cast("long").alias(key)).agg(F.count("*").alias("n"))
    repeated = _run.written(ids.where(f"n > 1 AND {key} IS NOT NULL").select(key))
    hashed = docs.withColumns({key: F.col("doc_id").cast("long"), text: F.xxhash64("text")})
    left = _run.join_small(hashed, gone, [key, text], "left_anti", 24)
    if repeated.isEmpty():
        return left.select(*(F.col(f"`{c}`") for c in docs.columns))
    once = left.join(repeated, key, "left_anti")
    again = left.join(repeated, key, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*(F.col(f"`{c}`") for c in docs.columns))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of similar ones stays."""
    return deduplicate(docs)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\t\n\f\r ]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g
  FROM d WHERE len(w) > 0),
c AS (SELECT g, row_number() OVER () AS c, count(*) AS copies, min(doc_id) AS low FROM s GROUP BY g),
t AS (SELECT c, len(g) AS n, unnest(g) AS gram FROM c),
o AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.gram = b.gram AND a.c <> b.c GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 2 * k >= na + nb - k),
near AS (SELECT a AS c, sum(copies) AS near FROM e JOIN c ON c.c = e.b GROUP BY a),
r(c, m) AS (SELECT c, c FROM c UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.c),
low AS (SELECT r.c, min(c.low) AS class_id FROM r JOIN c ON c.c = r.m GROUP BY r.c)
SELECT doc_id, class_id, (copies - 1 + coalesce(near, 0))::BIGINT AS links
FROM s JOIN c USING (g) JOIN low ON low.c = c.c LEFT JOIN near ON near.c = c.c
UNION ALL
SELECT DISTINCT doc_id, doc_id, 0::BIGINT FROM d WHERE doc_id NOT IN (SELECT doc_id FROM s)
"""
