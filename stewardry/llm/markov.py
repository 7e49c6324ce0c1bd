"""Language-model scoring by a hidden Markov model over words.

The states emit units: each of the most frequent words is one, and all other words fall into classes by the look of
the word. A word of a class follows by its count within the class, so every word has an exact probability.
Baum-Welch counts of the training texts are summed over partitions in every round; texts are scored by the scaled
forward recursion over the whole text. A unigram model with add-one counts is kept beside it as base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import _LOWER, bounded_batches, bytes_of, chunks, mix, prefix_hash, signed, span_hash, words
from stewardry.session import materialise

STATES = 4
ROUNDS = 3
#: Words with a unit of their own, and words whose counts go to the executors; classes of the other words.
UNIT_WORDS = 8192
KNOWN_WORDS = 262_144
CLASSES = 256
#: Training texts are cut into so many tokens for Baum-Welch (scoring never cuts).
SEGMENT = 512
#: Tokens that one task counts or walks together, about.
BLOCK_TOKENS = 1_000_000
SMOOTHING = 0.1

_END = np.uint64(0xE17D0E17D0E17D0E)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hash, class and row of each word and of the end of each row, in order."""
    starts, ends, rows = words(data, offsets)
    hashes = span_hash(prefix_hash(data, lower=True), starts, ends)
    docs = len(offsets) - 1
    if len(starts):
        # Lowered like the hash, so that a word has one class in whatever case it stands.
        tail, before = (_LOWER[data[at]].astype(np.uint64) for at in (ends - 1, np.maximum(ends - 2, starts)))
        size = np.minimum(ends - starts, 24).astype(np.uint64) // np.uint64(3)
        looks = (mix((size << np.uint64(16)) | (before << np.uint64(8)) | tail) % np.uint64(CLASSES)).astype(np.int64)
    else:
        looks = np.zeros(0, np.int64)
    at = np.cumsum(np.bincount(rows, minlength=docs))
    return np.insert(hashes, at, _END), np.insert(looks, at, 0), np.insert(rows, at, np.arange(docs))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            hashes, looks = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            found, first, times = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(looks[first].astype(np.int32)), pa.array(times)], names=["word", "look", "n"])

    for batch in batches:
        data, offsets = bytes_of(batch.column(0))
        for a, b in chunks(offsets):
            held.append(tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[:2])
        if sum(len(h) for h, _ in held) >= 4 * BLOCK_TOKENS:
            yield from flush()
    yield from flush()


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, look, n`` over all texts: hash, class and count of each word, the end of a text among them; one row a word."""
    rows = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(_count, "word long, look int, n long")
    return rows.groupBy("word").agg(F.min("look").alias("look"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """The frequent words (sorted hashes) with counts and units, the weight of each class, and the totals."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    weights: np.ndarray
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return int(min(len(self.hashes), UNIT_WORDS)) + CLASSES + 1


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Collect the ``KNOWN_WORDS`` most frequent words at most, and sums over all."""
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).toArrow()
    hashes, looks, n = (top.column(c).to_numpy() for c in ("word", "look", "n"))
    units = np.where(np.arange(len(hashes)) < UNIT_WORDS, np.arange(len(hashes)), -1)
    sums = counts.groupBy("look").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    total, distinct = sum(r["n"] for r in sums), sum(r["words"] for r in sums)
    weights = np.ones(CLASSES + 1)  # one for the words never seen
    for r in sums:
        weights[r["look"]] += r["n"] + r["words"]
    own = units >= 0
    np.subtract.at(weights, looks[own], n[own] + 1)
    units[~own] = own.sum() + looks[~own]
    by = np.argsort(hashes.view(np.uint64))
    return Vocabulary(hashes.view(np.uint64)[by], n[by], units[by], weights, int(total), int(distinct))


_SEQUENCES = "units binary, n_tokens long, base double, inside double, n_known long, words array<long>, times array<int>"


def _sequences(vocab):
    """Rows (..., text) to units, sums of what the frequent words give, and the other words with their counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        own = v.size - CLASSES - 1
        log_n = np.log10(v.counts + 1.0)
        log_w = np.log10(v.weights)
        for batch in batches:
            data, offsets = bytes_of(batch.column(batch.num_columns - 1))
            columns: list[list] = [[], [], [], [], [], [], []]
            for a, b in chunks(offsets):
                hashes, looks, rows = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                docs = b - a
                if len(v.hashes):
                    at = np.minimum(np.searchsorted(v.hashes, hashes), len(v.hashes) - 1)
                    known = v.hashes[at] == hashes
                else:
                    at, known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
                units, base = own + looks, np.zeros(len(hashes))
                units[known], base[known] = v.units[at[known]], log_n[at[known]]
                units[hashes == _END] = np.where(units[hashes == _END] >= own, v.size - 1, units[hashes == _END])
                in_class = (units >= own) & (units < v.size - 1)
                inside = np.where(in_class, base - log_w[np.clip(units - own, 0, CLASSES)], 0.0)
                n = np.bincount(rows, minlength=docs)
                ends = np.cumsum(n)
                columns[0] += [u.tobytes() for u in np.split(units.astype("<u2"), ends[:-1])]
                for k, values in ((2, base), (3, inside), (4, known)):
                    columns[k].append(np.bincount(rows, values, docs))
                columns[1].append(n)
                other = ~known & (hashes != _END)
                pairs = np.lexsort((hashes[other], rows[other]))
                h, r = hashes[other][pairs], rows[other][pairs]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(h)))
                lists = np.concatenate([[0], np.cumsum(np.bincount(r[new], minlength=docs))]).astype(np.int32)
                columns[5].append(pa.ListArray.from_arrays(lists, pa.array(signed(h[new]))))
                columns[6].append(pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32))))
            numbers = [np.concatenate(c) if c else np.zeros(0) for c in columns[1:5]]
            lists = [pa.concat_arrays(c) if c else pa.array([], pa.list_(t)) for c, t in zip(columns[5:], (pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(columns[0], pa.binary()),
                    pa.array(numbers[0].astype(np.int64)),
                    pa.array(numbers[1]),
                    pa.array(numbers[2]),
                    pa.array(numbers[3].astype(np.int64)),
                    *lists,
                ],
                names=[*batch.schema.names[:-1], "units", "n_tokens", "base", "inside", "n_known", "words", "times"],
            )

    return encode


@dataclass(frozen=True)
class HiddenMarkov:
    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray


def _packed(sequences: list[np.ndarray]):
    """Sequences by falling length, step after step: units of all steps, where each step begins, and the order."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
    begin = np.concatenate([[0], np.cumsum(live)])
    units = np.empty(begin[-1], np.int64)
    for row, k in enumerate(order):
        units[begin[: sizes[row]] + row] = sequences[k]
    return units, begin, order


def forward(model: HiddenMarkov, sequences: list[np.ndarray], keep: bool = False):
    """Natural log likelihood of each sequence; with ``keep`` also scaled states, scales and the packing."""
    units, begin, order = _packed(sequences)
    out = np.zeros(len(sequences))
    n = len(order)
    likely = model.emit[:, units].T
    states = np.empty_like(likely) if keep else None
    scales = np.empty(len(units)) if keep else None
    now = np.broadcast_to(model.start, (n, len(model.start)))
    for t in range(len(begin) - 1):
        a, b = begin[t], begin[t + 1]
        now = (now[: b - a] if t == 0 else now[: b - a] @ model.moves) * likely[a:b]
        scale = now.sum(axis=1)
        now = now / scale[:, None]
        out[: b - a] += np.log(scale)
        if keep:
            states[a:b], scales[a:b] = now, scale
    result = np.empty(n)
    result[order] = out
    return (result, states, scales, likely, units, begin) if keep else result


def expected_counts(model: HiddenMarkov, sequences: list[np.ndarray]):
    """Baum-Welch: expected starts, moves and emissions of these sequences."""
    fit, states, scales, likely, units, begin = forward(model, sequences, keep=True)
    k, vocab = model.emit.shape
    moves = np.zeros((k, k))
    ahead = np.zeros((0, k))
    steps = len(begin) - 1
    for t in range(steps - 1, -1, -1):
        a, b = begin[t], begin[t + 1]
        back = np.ones((b - a, k))
        if t + 1 < steps:
            c, d = begin[t + 1], begin[t + 2]
            weight = likely[c:d] * ahead / scales[c:d, None]
            moves += states[a : a + d - c].T @ weight
            back[: d - c] = weight @ model.moves.T
        ahead = back
        states[a:b] *= back
    moves *= model.moves
    emissions = np.stack([np.bincount(units, states[:, j], vocab) for j in range(k)])
    return states[: begin[1]].sum(axis=0) if steps else np.zeros(k), moves, emissions, float(fit.sum())


def _blocks(batches: Iterator[pa.RecordBatch], column: int, segment: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], int, int]]:
    """Sequences of a batch, about BLOCK_TOKENS tokens at a time, cut into segments if so asked."""
    for batch in batches:
        every = [np.frombuffer(x, "<u2") for x in batch.column(column).to_pylist()]
        start, size = 0, 0
        for k, s in enumerate(every):
            size += len(s)
            if size >= BLOCK_TOKENS or k == len(every) - 1:
                block = every[start : k + 1]
                if segment:
                    block = [s[i : i + segment] for s in block for i in range(0, len(s), segment)]
                yield batch, block, start, k + 1
                start, size = k + 1, 0


def _expect(model):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: HiddenMarkov = model.value
        k, vocab = m.emit.shape
        total = np.zeros(k + k * k + k * vocab)
        for _, block, _, _ in _blocks(batches, 0, SEGMENT):
            start, moves, emissions, _ = expected_counts(m, block)
            total += np.concatenate([start, moves.ravel(), emissions.ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    return expect


def fit(sequences: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS, seed: int = 11) -> HiddenMarkov:
    """Train by Baum-Welch on the column ``units``: each round sums the partitions' expected counts.

    States x units numbers come to the driver each round. The first round starts from equal moves and unit
    frequencies with seeded noise.
    """
    spark = sequences.sparkSession
    size = vocab.size
    rng = np.random.default_rng(seed)
    frequency = np.full(size, SMOOTHING)
    own = vocab.units < size - CLASSES - 1
    frequency[vocab.units[own]] += vocab.counts[own]
    frequency[size - CLASSES - 1 : size - 1] += np.maximum(0, vocab.weights[:CLASSES] - 1)
    emit = frequency * np.exp(rng.normal(0, 0.5, (states, size)))
    model = HiddenMarkov(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=1, keepdims=True))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        rows = sequences.select("units").mapInArrow(_expect(shared), "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(states + states * states + states * size)
        total[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
        start, moves, emissions = np.split(total, [states, states + states * states])
        norm = lambda x: x / x.sum(axis=-1, keepdims=True)
        model = HiddenMarkov(norm(start + SMOOTHING), norm(moves.reshape(states, states) + SMOOTHING), norm(emissions.reshape(states, size) + SMOOTHING))
    return model


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block, a, b in _blocks(batches, 0):
            fit = forward(model.value, block) / np.log(10)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(fit)], names=[*part.schema.names[1:], "fit"])

    return score


def score_texts(
    df: DataFrame,
    held_out: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Train on the rows where ``held_out`` is false and score all.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log base 10 of the whole text,
    by the unigram counts and by the hidden Markov model). Words are what white space separates, with A-Z lowered; the end
    of a text is a token. A NULL text counts as empty and has its end only, a NULL id is kept, a NULL ``held_out``
    counts as false, repeated rows are counted and scored each, further columns are ignored, and an empty table
    gives no rows. Without training rows every token is unknown.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    counts = materialise(word_counts(docs.filter("NOT held_out"), "_text"), "word-counts")
    vocab = vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocab)  # KNOWN_WORDS words at most
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "_text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    sequences = materialise(rows.mapInArrow(_sequences(shared), f"{schema}, {_SEQUENCES}"), "sequences")
    model = spark.sparkContext.broadcast(fit(sequences.filter("NOT held_out"), vocab, states, rounds))  # states x units

    rare = sequences.select("row", F.explode(F.arrays_zip("words", "times")).alias("_w")).select("row", F.col("_w.words").alias("word"), F.col("_w.times").alias("times"))
    seen = rare.join(counts.select("word", "n"), "word")
    sums = seen.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_rare"), F.sum("times").alias("_known"))
    fits = sequences.select("units", "row", "doc_id", "held_out", "n_tokens", "base", "inside", "n_known")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fits.drop("units").schema)
    scored = fits.mapInArrow(_score(model), f"{kept}, fit double").join(sums, "row", "left")
    more = F.coalesce("_rare", F.lit(0.0))
    per_token = float(np.log10(vocab.total + vocab.distinct + 1))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("fit") + F.col("inside") + more).alias("score"),
    )
