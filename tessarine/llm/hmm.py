"""Language-model scoring with a hidden Markov model.

A sequence is a line of a document, its symbols the line's words (runs of characters
other than blank, tab, newline, form feed, carriage return; lower case).

Vocabulary. Every word of every document is counted, so what is gathered grows with the
corpus. Each of the ``own`` most frequent words is an emission class of its own; the others
share ``shared`` classes by hash. A state emits a class, and a class emits each of its words
as often as the word stands among them:

    P(word | state) = P(class(word) | state) * count(word) / count(class(word))

A word that the vocabulary doesn't have counts as one that was seen once. The second factor
is the same for all states, so training needs the classes only.

Training is Baum-Welch over every document: each partition runs the scaled forward and
backward recursions over its lines and emits its expected counts (initial, transition,
emission), Spark adds them up, and the M-step normalises the sums, with ``smoothing`` added
to each count. It ends when the mean log likelihood of a word gains less than ``tolerance``;
``max_iterations`` is only a stop for a corpus on which that never happens.

The score is the exact log likelihood of a document under the trained model, the sum over
its lines of the logs of the scale factors of the forward recursion, and of the words' shares
of their classes.

Documents are packed, ``PACK_WORDS`` words at a time. Lines of a pack are sorted by length and
advanced together, position by position, so the recursions are matrix products over all lines
that still run. Training, to which lines are all the same, sorts those of up to ``GROUP_WORDS``
words first and cuts them into packs anew: then few lines outlast the others of their pack.

Defined results: a null or empty text, or one without words, has ``words`` 0,
``log_likelihood`` 0 and ``bits_per_word`` NULL. An empty table trains on nothing and
keeps the initial model. Repeated rows count as often as they occur and score alike. Where a
kept column has the name of a result, the result's name gets an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessarine.llm import _run, _text

#: Words of one pack of documents; a longer document is a pack of its own.
PACK_WORDS = 150_000
#: Words whose lines are sorted together for training; two bytes each.
GROUP_WORDS = 8_000_000
#: Most classes of a model, so that a code has two bytes.
MOST_CLASSES = 1 << 16
_INITIAL, _LIKELIHOOD, _TRANSITION = -1, -2, -16


@dataclass
class Model:
    initial: np.ndarray  # states
    transition: np.ndarray  # states x states
    emission: np.ndarray  # classes x states
    iterations: int = 0
    #: Mean log likelihood of a word before each M-step, classes only.
    history: tuple = ()

    @property
    def states(self) -> int:
        return len(self.initial)


def start_model(states: int, symbols: int, seed: int, stay: float = 0.9, away: float = 0.3) -> Model:
    """Each class has a random home state, which emits it 1 / ``away`` times as often as the others, and states tend to
    last. From a model with equal states Baum-Welch would not move.
    """
    rng = np.random.default_rng(seed)
    emission = np.full((symbols, states), away)
    emission[np.arange(symbols), rng.integers(0, states, symbols)] = 1
    transition = np.full((states, states), (1 - stay) / max(states - 1, 1))
    np.fill_diagonal(transition, stay)
    transition *= rng.uniform(0.8, 1.2, transition.shape)
    return Model(np.full(states, 1 / states), transition / transition.sum(axis=1, keepdims=True), emission / emission.sum(axis=0))


def _kept(docs: DataFrame, keep: list[str]) -> T.StructField:
    fields = [T.StructField(f"f{k}", docs.schema[c].dataType) for k, c in enumerate(keep)]
    return T.StructField("rows", T.ArrayType(T.StructType(fields)))


def _binary(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.BinaryType()) for name in names]


def pack(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(pack, rows, per_row, lines, slots, vocabulary): documents, lines of each, words of each line, places in the pack's
    distinct words, and those words' hashes.
    """
    kept = _kept(docs, keep)
    source = _run.text_batches(docs).select(*(F.col(f"`{c}`").alias(f"f{k}") for k, c in enumerate(keep)), F.lower("text").alias("text"))

    def packed(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rows, per_row, lines, hashes, size = [], [], [], [], 0

        def flush():
            nonlocal number, size
            words, slots = np.unique(np.concatenate(hashes), return_inverse=True)
            table = pa.Table.from_batches(rows).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
            own = pa.StructArray.from_arrays(columns, names=table.column_names)
            out = {
                "pack": pa.array([number], pa.int64()),
                "rows": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                "per_row": pa.array([np.concatenate(per_row).astype("<u4").tobytes()], pa.binary()),
                "lines": pa.array([np.concatenate(lines).astype("<u4").tobytes()], pa.binary()),
                "slots": pa.array([slots.astype("<u4" if len(words) > 1 << 16 else "<u2").tobytes()], pa.binary()),
                "vocabulary": pa.array([words.tobytes()], pa.binary()),
            }
            for x in (rows, per_row, lines, hashes):
                x.clear()
            number, size = number + 1, 0
            _run.give_back()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            offsets, raw = _text.buffers(batch.column("text"))
            only = batch.select([f"f{k}" for k in range(len(keep))])
            for lo, hi in _text.slices(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                data = raw[offsets[lo] : offsets[hi]]
                start, end, pointers = _text.words(data, at)
                hashes.append(_text.Ranges(data).hash(start, end))
                cuts = np.union1d(np.searchsorted(start, np.flatnonzero(data == 10) + 1), pointers)
                lines.append(np.diff(cuts))
                per_row.append(np.diff(np.searchsorted(cuts, pointers)))
                rows.append(only.slice(lo, hi - lo))
                size += len(start)
                if size >= PACK_WORDS:
                    yield flush()
        if rows:
            yield flush()

    schema = T.StructType([T.StructField("pack", T.LongType()), kept, *_binary("per_row", "lines", "slots", "vocabulary")])
    return source.mapInArrow(packed, schema)


def _slots(slots: bytes, vocabulary: np.ndarray) -> np.ndarray:
    return np.frombuffer(slots, dtype="<u4" if len(vocabulary) > 1 << 16 else "<u2").astype(np.int64)


def vocabulary(packs: DataFrame) -> DataFrame:
    """(hash, times) of every word of the corpus."""

    def counted(batches):
        for batch in batches:
            for slots, words in zip(batch.column("slots").to_pylist(), batch.column("vocabulary").to_pylist(), strict=True):
                own = np.frombuffer(words, dtype=np.int64)
                times = np.bincount(_slots(slots, own), minlength=len(own))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(times)], names=["hash", "times"])

    return packs.select("slots", "vocabulary").mapInArrow(counted, "hash long, times long").groupBy("hash").agg(F.sum("times").alias("times"))


def _coded(rows, per_row: bytes, lines: bytes, slots: bytes, words: np.ndarray, code: np.ndarray, share: np.ndarray) -> dict:
    at = _slots(slots, words)
    size = np.frombuffer(lines, dtype="<u4").astype(np.int64)
    counts = np.frombuffer(per_row, dtype="<u4").astype(np.int64)
    row = np.repeat(np.repeat(np.arange(len(counts)), counts), size)
    return {
        "rows": rows, "per_row": pa.array([per_row], pa.binary()), "lines": pa.array([lines], pa.binary()),
        "codes": pa.array([code.astype("<u2")[at].tobytes()], pa.binary()),
        "shares": pa.array([np.bincount(row, weights=share[at], minlength=len(counts)).astype("<f8").tobytes()], pa.binary()),
    }


def encode(docs: DataFrame, keep: list[str], own: int = 24_576, shared: int = 8_192, ship_bytes: int = _run.SHIP_BYTES) -> DataFrame:
    """(rows, per_row, lines, codes, shares): packs with the class of each word, and each document's sum of the logs of its
    words' shares of their classes.

    Words seen more than once are shipped as a table while they fit in ``ship_bytes``; beyond that each pack's words are
    joined with the vocabulary.
    """
    if own < 0 or shared < 1 or own + shared > MOST_CLASSES:
        raise ValueError(f"own and shared make at most {MOST_CLASSES} classes, and at least one is shared")
    packs = _run.written(pack(docs, keep))
    counts = _run.written(vocabulary(packs))
    # bounded by the parameter
    top = counts.orderBy(F.col("times").desc(), "hash").limit(own).select("hash").toArrow().column("hash").to_numpy().astype(np.int64)
    top = np.sort(top)
    spark = docs.sparkSession
    known = spark.createDataFrame(pa.table({"hash": pa.array(top), "own": pa.array(np.arange(len(top), dtype=np.int32))}))
    code = F.coalesce("own", (F.pmod("hash", F.lit(shared)) + own).cast("int"))
    classed = counts.join(F.broadcast(known), "hash", "left").select("hash", "times", code.alias("code"))
    sums = classed.where(F.col("code") >= own).groupBy("code").agg(F.sum("times").alias("times")).toArrow()
    total = np.ones(shared)
    total[sums.column("code").to_numpy() - own] = sums.column("times").to_numpy()
    schema = T.StructType([packs.schema["rows"], *_binary("per_row", "lines", "codes", "shares")])

    def code_of(words: np.ndarray, times: np.ndarray):
        """Classes and log shares of words that occur ``times`` in the corpus."""
        at = _text.find(top, words)
        by_hash = np.mod(words, shared)
        return np.where(at >= 0, at, by_hash + own), np.where(at >= 0, 0.0, np.log(times / total[by_hash]))

    often = counts.where("times > 1")
    if often.count() * 16 <= ship_bytes:
        table = often.toArrow()
        word, times = table.column("hash").to_numpy().astype(np.int64), table.column("times").to_numpy().astype(np.int64)
        order = np.argsort(word)
        shipped = spark.sparkContext.broadcast((word[order], times[order]))

        def coded(batches):
            word, times = shipped.value
            for batch in batches:
                for k in range(batch.num_rows):
                    _, _, per_row, lines, slots, raw = (c[k].as_py() if j != 1 else None for j, c in enumerate(batch.columns))
                    words = np.frombuffer(raw, dtype=np.int64)
                    at = _text.find(word, words)
                    n = np.where(at >= 0, times[np.maximum(at, 0)] if len(times) else 1, 1)
                    yield pa.RecordBatch.from_pydict(_coded(batch.column("rows").slice(k, 1), per_row, lines, slots, words, *code_of(words, n)))
                _run.give_back()

        done = packs.mapInArrow(coded, schema)
    else:

        def places(batches):
            for batch in batches:
                for number, raw in zip(batch.column("pack").to_pylist(), batch.column("vocabulary").to_pylist(), strict=True):
                    words = np.frombuffer(raw, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number)), pa.array(words)], names=["pack", "hash"])

        def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
            words = np.frombuffer(left.column("vocabulary")[0].as_py(), dtype=np.int64)
            word, times = right.column("hash").to_numpy().astype(np.int64), right.column("times").to_numpy().astype(np.int64)
            order = np.argsort(word)
            at = _text.find(word[order], words)
            n = np.where(at >= 0, times[order][np.maximum(at, 0)] if len(times) else 1, 1)
            parts = (left.column(c)[0].as_py() for c in ("per_row", "lines", "slots"))
            return pa.table(_coded(left.column("rows").combine_chunks(), *parts, words, *code_of(words, n)), schema=out_schema)

        out_schema = _arrow(schema)
        uses = packs.select("pack", "vocabulary").mapInArrow(places, "pack long, hash long").join(often, "hash").select("pack", "hash", "times")
        done = packs.groupBy("pack").cogroup(uses.groupBy("pack")).applyInArrow(looked_up, schema)
    done = _run.written(done)
    _run.forget(packs, counts)
    return done


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _unpack(per_row: bytes, lines: bytes, codes: bytes):
    """(classes, words of each line, lines of each row) of a pack."""
    return (np.frombuffer(x, dtype=kind).astype(np.int64) for x, kind in ((codes, "<u2"), (lines, "<u4"), (per_row, "<u4")))


class Packed:
    """Some lines, longest first: position t of the lines that have one is one slice.

    start: where each line begins in ``symbols``; without it they lie end to end.
    """

    def __init__(self, symbols: np.ndarray, words: np.ndarray, start: np.ndarray | None = None):
        self.order = np.argsort(-words, kind="stable")
        length = words[self.order]
        steps = int(length[0]) if len(length) else 0
        # lines that are longer than t
        self.running = len(length) - np.searchsorted(length[::-1], np.arange(steps), side="right")
        start = (np.cumsum(words) - words if start is None else start)[self.order]
        step = np.repeat(np.arange(steps), self.running)
        self.begin = np.concatenate([[0], np.cumsum(self.running)])
        self.line = np.arange(len(step)) - self.begin[step]
        self.symbols = symbols[start[self.line] + step].astype(np.int64)


def by_length(codes: list[bytes], lines: list[bytes]):
    """The lines of some packs as ``Packed`` ones of about ``PACK_WORDS`` words, the longest in the first."""
    symbols, words = np.frombuffer(b"".join(codes), "<u2"), np.frombuffer(b"".join(lines), "<u4").astype(np.int64)
    start = np.cumsum(words) - words
    order = np.argsort(-words, kind="stable")
    order = order[words[order] > 0]
    piece = (np.cumsum(words[order]) - 1) // PACK_WORDS
    for own in np.split(order, np.flatnonzero(np.diff(piece)) + 1):
        if len(own):
            yield Packed(symbols, words[own], start[own])


def forward(model: Model, packed: Packed, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables (states x words) and scale factors, position by position."""
    alpha = np.take(np.ascontiguousarray(model.emission.T, dtype=kind), packed.symbols, axis=1)
    into, ones, scale = np.ascontiguousarray(model.transition.T, dtype=kind), np.ones(model.states, dtype=kind), np.empty(alpha.shape[1], dtype=kind)
    last = None
    for at, n in zip(packed.begin.tolist(), packed.running.tolist()):
        now = alpha[:, at : at + n]
        now *= model.initial.astype(kind)[:, None] if last is None else into @ last[:, :n]
        now /= np.matmul(ones, now, out=scale[at : at + n])
        last = now
    return alpha, scale


def expected_counts(model: Model, packed: Packed, kind=np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(initial, transition, emission) counts and log likelihood of some lines."""
    alpha, scale = forward(model, packed, kind)
    ahead = np.take(np.ascontiguousarray(model.emission.T, dtype=kind), packed.symbols, axis=1)
    ahead /= scale
    back, begin, running = model.transition.astype(kind), packed.begin.tolist(), packed.running.tolist()
    transition = np.zeros((model.states, model.states))
    beta = np.ones((model.states, 0), dtype=kind)  # of the lines that go on; it is 1 for those that end
    for t in range(len(running) - 1, -1, -1):
        at, n, on = begin[t], running[t], beta.shape[1]
        if on:
            alpha[:, at : at + on] *= beta
        if t:
            now = ahead[:, at : at + n]
            now[:, :on] *= beta
            transition += alpha[:, begin[t - 1] : begin[t - 1] + n] @ now.T
            beta = back @ now
    size, first = len(model.emission), running[0] if running else 0
    emission = np.stack([np.bincount(packed.symbols, weights=g, minlength=size) for g in alpha]).T
    return alpha[:, :first].sum(axis=1, dtype=np.float64), transition * model.transition, emission, float(np.log(scale, dtype=np.float64).sum())


def train(encoded: DataFrame, states: int = 8, symbols: int = 32_768, max_iterations: int = 100, tolerance: float = 1e-3, smoothing: float = 0.01, seed: int = 3) -> Model:
    """Baum-Welch over all rows of an encoded table of ``symbols`` classes."""
    model, history = start_model(states, symbols, seed), []
    columns = [f"v{k}" for k in range(states)]
    schema = "id int, " + ", ".join(f"{c} float" for c in columns)
    spark = encoded.sparkSession
    while model.iterations < max_iterations:
        shipped = spark.sparkContext.broadcast((model.initial, model.transition, model.emission))

        def counts(batches, shipped=shipped):
            now = Model(*shipped.value)
            now.emission = np.asfortranarray(now.emission)
            first, transition = np.zeros(now.states), np.zeros((now.states, now.states))
            emission, likelihood = np.zeros_like(now.emission), np.zeros(now.states)

            def add(held):
                for packed in by_length(*zip(*held, strict=True)):
                    f, a, e, value = expected_counts(now, packed, np.float32)
                    first[:] += f
                    transition[:] += a
                    emission[:] += e
                    likelihood[:2] += value, len(packed.symbols)
                held.clear()
                _run.give_back()

            held: list[tuple[bytes, bytes]] = []
            for batch in batches:
                for codes, lines in zip(batch.column("codes"), batch.column("lines"), strict=True):
                    held.append((codes.as_py(), lines.as_py()))
                    if sum(len(c) for c, _ in held) >= 2 * GROUP_WORDS:
                        add(held)
            if held:
                add(held)
            used = np.flatnonzero(emission.any(axis=1))
            ids = np.concatenate([used, [_INITIAL, _LIKELIHOOD], _TRANSITION - np.arange(now.states)]).astype(np.int32)
            values = np.concatenate([emission[used], first[None], likelihood[None], transition]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], names=["id", *columns])

        sums = encoded.select("lines", "codes").mapInArrow(counts, schema).groupBy("id").agg(*(F.sum(c).alias(c) for c in columns))
        table = sums.toArrow()  # classes x states numbers, whatever the size of the corpus
        shipped.unpersist()
        ids = table.column("id").to_numpy()
        values = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
        by_id = {int(i): v for i, v in zip(ids[ids < 0], values[ids < 0], strict=True)}
        if _LIKELIHOOD not in by_id or by_id[_LIKELIHOOD][1] == 0:
            return model
        emission = np.full((symbols, states), smoothing)
        emission[ids[ids >= 0]] += values[ids >= 0]
        first = by_id[_INITIAL] + smoothing
        transition = np.stack([by_id[_TRANSITION - k] for k in range(states)]) + smoothing
        history.append(float(by_id[_LIKELIHOOD][0] / by_id[_LIKELIHOOD][1]))
        model = Model(first / first.sum(), transition / transition.sum(axis=1, keepdims=True), emission / emission.sum(axis=0), model.iterations + 1, tuple(history))
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
    return model


def score(encoded: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """The documents of an encoded table, their kept columns under ``names``, with words, log_likelihood and bits_per_word."""
    spark = encoded.sparkSession
    kept = encoded.schema["rows"].dataType.elementType.fields
    results = ["words", "log_likelihood", "bits_per_word"]
    taken = {n.lower() for n in names}
    for k, name in enumerate(results):
        while results[k].lower() in taken:
            results[k] += "_"
        taken.add(results[k].lower())
    shipped = spark.sparkContext.broadcast((model.initial, model.transition, model.emission))

    def scored(batches):
        now = Model(*shipped.value)
        for batch in batches:
            for k in range(batch.num_rows):
                per_row, lines, codes, shares = (batch.column(c)[k].as_py() for c in ("per_row", "lines", "codes", "shares"))
                symbols, words, counts = _unpack(per_row, lines, codes)
                some = np.flatnonzero(words > 0)
                packed = Packed(symbols, words[some])
                _, scale = forward(now, packed)
                value = np.zeros(len(words))
                value[some[packed.order]] = np.bincount(packed.line, weights=np.log(scale), minlength=len(some))
                row = np.repeat(np.arange(len(counts)), counts)
                total = np.bincount(row, weights=value, minlength=len(counts)) + np.frombuffer(shares, dtype="<f8")
                n = np.bincount(row, weights=words, minlength=len(counts)).astype(np.int64)
                bits = -total / np.maximum(n, 1) / np.log(2)
                rows = batch.column("rows")[k].values
                _run.give_back()
                yield pa.RecordBatch.from_arrays([*(rows.field(f"f{j}") for j in range(len(kept))), pa.array(n), pa.array(total), pa.array(bits, mask=n == 0)], names=plain)

    plain = [*(f.name for f in kept), "_words", "_log_likelihood", "_bits_per_word"]
    types = [*(f.dataType for f in kept), T.LongType(), T.DoubleType(), T.DoubleType()]
    done = encoded.mapInArrow(scored, T.StructType([T.StructField(n, t) for n, t in zip(plain, types, strict=True)]))
    return done.toDF(*names, *results)


def train_and_score(docs: DataFrame, keep: list[str], own: int = 24_576, shared: int = 8_192, **training) -> DataFrame:
    """The rows' ``keep`` columns with their scores under a model of all rows.

    The words are encoded once into a table in the shared folder, a fraction of the
    text's size, and every pass of training and the scoring read that.
    """
    encoded = encode(docs, keep, own, shared)
    return score(encoded, train(encoded, symbols=own + shared, **training), keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return train_and_score(docs, ["doc_id"])
