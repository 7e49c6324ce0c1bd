"""Packing along a space-filling curve: neighbouring documents share a sequence, and no sequence is padded.

A document's tokens are hashed into a vector, the vector is projected to a few dimensions, and the Hilbert key of that
point is what a range sort goes by. Each task lays its stretch of the curve out as one run of tokens and cuts it at
every ``capacity``; what is left at its end is cut into powers of two.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import bounded_batches, bytes_of, chunks
from stewardry.session import materialise

CAPACITY = 4096
END_ID = 2
#: Dimensions of the curve and bits of each; together 63 bits at most.
DIMENSIONS = 8
BITS = 7
#: Stretches of the curve to a shuffle partition. Ranges are even in rows, and long documents lie close together, so
#: some stretches hold several times the tokens of others.
STRETCHES = 4
#: Hash buckets of a document's vector.
WIDTH = 1024
#: Bytes of text that are encoded at once; distinct words are looked up once in each.
CHUNK_BYTES = 8 << 20
#: Words whose ids a worker keeps; beyond it starts anew.
KEPT_WORDS = 800_000

#: Small letters of ASCII and, after the byte C3, of Latin-1; a line end counts as a space.
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_SMALL[10] = 32
_SMALL_LATIN = np.arange(256, dtype=np.uint8)
_SMALL_LATIN[0x80:0x9F] += 32
_SMALL_LATIN[0x97] = 0x97
_WORD_END = np.zeros(256, bool)
_WORD_END[48:58] = _WORD_END[97:123] = True

#: Words of which the tokenizer makes one piece that only byte symbols change: lower-case Latin letters.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of ``ids`` one after the other."""
    ends = np.cumsum(sizes)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def _dtype_of(coder) -> np.dtype:
    return np.dtype("<u2" if coder.get_vocab_size() <= 1 << 16 else "<u4")


@cache
def id_dtype(path: str) -> np.dtype:
    """The kept form of a tokenizer's ids."""
    from tokenizers import Tokenizer

    return _dtype_of(Tokenizer.from_file(path))


class WordIds:
    """Ids of whole texts, one space-separated word at a time.

    For a lower-casing tokenizer whose pieces never cross white space, a text's ids are those of its words one after the
    other, so each word of a batch is encoded once and remembered. Plain words go straight to the tokenizer's model;
    others are encoded together, parted by ``|``, which such a tokenizer keeps apart and gives one id; words that hold
    it are encoded alone.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.model = Tokenizer(self.coder.model)
        self.dtype = _dtype_of(self.coder)
        (self.bar,) = self.coder.encode("|", add_special_tokens=False).ids
        letters = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
        symbols = {x: "".join(piece for piece, _ in self.coder.pre_tokenizer.pre_tokenize_str(x)) for x in letters}
        self.symbols = str.maketrans(symbols)
        self._forget()

    def _forget(self) -> None:
        #: Number of each kept word, and the spans of their ids.
        self.kept: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _forms(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct non-empty words, and how many each has, in order."""
        plain, parted, alone = [], [], []
        for k, form in enumerate(forms):
            (plain if _PLAIN.fullmatch(form) else alone if "|" in form else parted).append(k)
        sizes = np.zeros(len(forms), np.int64)
        found: list[np.ndarray] = []
        if plain:
            coded = self.model.encode([f if f.isascii() else f.translate(self.symbols) for f in map(forms.__getitem__, plain)], is_pretokenized=True, add_special_tokens=False)
            found.append(np.array(coded.ids, self.dtype))
            sizes[plain] = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(plain))
        if parted:
            ids = self._encode(" | ".join(forms[k] for k in parted))
            bars = np.flatnonzero(ids == self.bar)
            sizes[parted] = np.diff(np.concatenate([[-1], bars, [len(ids)]])) - 1
            found.append(np.delete(ids, bars))
        for k in alone:
            found.append(self._encode(forms[k]))
            sizes[k] = len(found[-1])
        order = np.array([*plain, *parted, *alone], np.int64)
        starts = np.zeros(len(forms), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return _gather(np.concatenate(found), starts, sizes) if found else self.ids[:0], sizes

    def _learn(self, words: list[str]) -> None:
        """Keep new words, '' among them."""
        used = np.array([k for k, w in enumerate(words) if w], np.int64)
        ids, filled = self._forms([words[k] for k in used])
        sizes = np.zeros(len(words), np.int64)
        sizes[used] = filled
        self.kept |= zip(words, range(len(self.kept), len(self.kept) + len(words)), strict=True)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def _spaced(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts in small letters, last stops and commas apart, and which rows this might change: those are empty.

        The tokenizer lowers all letters itself, but composes accents first and knows its special tokens as written, so
        rows with combining accents (UTF-8 lead bytes CC, CD) or with ``<|`` are left to it as they are.
        """
        data, offsets = bytes_of(texts)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        risky = (data == 0xCC) | (data == 0xCD)
        risky[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(risky), "right") - 1)
        data = _SMALL[data]
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        data[after] = _SMALL_LATIN[data[after]]
        # A stop or comma is a piece of its own between a letter or digit and a space.
        marks = np.flatnonzero((data == ord(".")) | (data == ord(",")))
        marks = marks[(marks > 1) & (marks < len(data) - 1)]
        before = data[marks - 1]
        apart = _WORD_END[before] | ((data[marks - 2] == 0xC3) & (before != 0x97) & (before != 0xB7))
        marks = marks[apart & (data[marks + 1] == 32)]
        offsets = offsets + np.searchsorted(marks, offsets, "left")
        spaced = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.insert(data, marks, 32)))
        return spaced, rows

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's begin."""
        import pyarrow.compute as pc

        spaced, odd = self._spaced(texts)
        split = pc.split_pattern(spaced, " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.kept) + len(distinct) > KEPT_WORDS:
            self._forget()
        known = np.fromiter(map(self.kept.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = np.arange(len(self.kept), len(self.kept) + len(new))
            self._learn([distinct[k] for k in new.tolist()])
        at = known[words.indices.to_numpy()] if len(distinct) else known
        sizes = self.sizes[at]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        ids = _gather(self.ids, self.starts[at], sizes)
        if not len(odd):
            return ids, bounds
        own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for row in odd.tolist():
            own[row] = self._encode(texts[row].as_py())
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


_loaded: dict[str, WordIds] = {}


def projection(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((WIDTH, dimensions)).astype(np.float32)


def sketch(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The point of a document: its ids hashed into a vector of damped counts of length one, and projected."""
    counts = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22), minlength=WIDTH)
    hit = np.flatnonzero(counts)
    weights = np.log1p(counts[hit])
    return (weights / max(np.linalg.norm(weights), 1e-12)) @ matrix[hit]


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys of whole-numbered points, ``bits`` a dimension: successive keys are neighbouring points."""
    axes = [points[:, k].astype(np.uint64) for k in range(points.shape[1])]
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        low = np.uint64((1 << bit) - 1)
        for k, axis in enumerate(axes):
            upper = (axis >> np.uint64(bit)) & one == one
            swap = np.where(upper, np.uint64(0), (axes[0] ^ axis) & low)
            axes[0] = axes[0] ^ swap ^ np.where(upper, low, np.uint64(0))
            if k:
                axes[k] = axis ^ swap
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    turn = np.zeros(len(points), np.uint64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> np.uint64(bit)) & one == one, np.uint64((1 << bit) - 1), np.uint64(0))
    keys = np.zeros(len(points), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            keys = (keys << one) | (((axis ^ turn) >> np.uint64(bit)) & one)
    return keys.astype(np.int64)


def _curve_key(centre: np.ndarray, spread: np.ndarray, bits: int):
    @F.pandas_udf("long")
    def key(points: pd.Series) -> pd.Series:
        if not len(points):
            return pd.Series([], dtype="int64")
        scaled = (np.stack(points.to_list()) - centre) / spread
        cells = (1 / (1 + np.exp(-1.702 * np.clip(scaled, -20, 20))) * 2**bits).astype(np.uint64)  # even use of the cube
        return pd.Series(hilbert_keys(np.minimum(cells, 2**bits - 1), bits))

    return key


_TOKENS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("point", pa.list_(pa.float32())), ("ids", pa.binary())])


def tokens(df: DataFrame, *, tokenizer: str, id_col: str, text_col: str, end_id: int, dimensions: int, seed: int) -> DataFrame:
    """``doc_id, tie`` (a number of the row), ``point`` and ``ids`` (little-endian, with the end id) of each text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordIds(tokenizer)
        coder, matrix = _loaded[tokenizer], projection(dimensions, seed)
        end = np.array([end_id], coder.dtype)
        for batch in batches:
            for first, stop in chunks(bytes_of(batch.column(1))[1], CHUNK_BYTES):
                part = batch.slice(first, stop - first)
                ids, bounds = coder(part.column(1))
                own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                points = pa.array([sketch(x, matrix) for x in own], pa.list_(pa.float32()))
                whole = pa.array([np.concatenate([x, end]).tobytes() for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), points, whole], schema=_TOKENS)

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.monotonically_increasing_id())
    return rows.mapInArrow(encode, "doc_id long, tie long, point array<float>, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES_ARROW = pa.schema([(field.split()[0], pa.int64()) for field in PIECES.split(", ")])


class Layout:
    """A run of tokens that grows document by document, cut at every ``capacity``."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.sequence, self.used = capacity, first_sequence, 0
        #: Pieces of the open sequence: [document, start, length, offset].
        self.open: list[list] = []

    def add(self, document: object, size: int) -> Iterator[tuple]:
        """Lay a document's tokens out; yields the pieces (document, start, length, sequence, offset) of full sequences."""
        start = 0
        while start < size:
            length = min(size - start, self.capacity - self.used)
            self.open.append([document, start, length, self.used])
            start, self.used = start + length, self.used + length
            if self.used == self.capacity:
                yield from ((d, s, n, self.sequence, o) for d, s, n, o in self.open)
                self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def close(self) -> Iterator[tuple]:
        """Cut the open sequence into powers of two, the largest first."""
        bounds = np.cumsum([0, *(1 << bit for bit in range(self.used.bit_length() - 1, -1, -1) if self.used >> bit & 1)]).tolist()
        for number, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            for document, start, length, offset in self.open:
                a, b = max(low, offset), min(high, offset + length)
                if a < b:
                    yield document, start + a - offset, b - a, self.sequence + number, a - low


def pack_along_curve(
    df: DataFrame,
    *,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    dimensions: int = DIMENSIONS,
    bits: int = BITS,
    seed: int = 29,
) -> DataFrame:
    """Pack all texts into sequences of ``capacity`` tokens, documents that are alike beside each other.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. All sequences are
    full but those at the end of a task's stretch, whose lengths are powers of two, so nothing is padded.

    Stretches are ranges of (key, id, row number), so copies of one text in any number are spread over tasks. A NULL text
    counts as empty and gives its end token; a NULL id is kept and precedes others on one key; repeated rows are packed
    each; a text of any length is one row; further columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = materialise(tokens(df, tokenizer=tokenizer, id_col=id_col, text_col=text_col, end_id=end_id, dimensions=dimensions, seed=seed), "tokens")
    axes: list[Column] = [F.col("point")[k].cast("double") for k in range(dimensions)]
    moments = rows.agg(*(F.avg(a) for a in axes), *(F.stddev_pop(a) for a in axes)).first()  # two numbers a dimension
    centre = np.array([m or 0.0 for m in moments[:dimensions]])
    spread = np.array([m or 1.0 for m in moments[dimensions:]])
    order = [F.asc("key"), F.asc_nulls_first("doc_id"), F.asc("tie")]
    keyed = rows.select("doc_id", "tie", "ids", _curve_key(centre, spread, bits)("point").alias("key"))
    stretches = STRETCHES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = keyed.repartitionByRange(stretches, *order).sortWithinPartitions(*order).select("doc_id", "ids", F.spark_partition_id().alias("part"))

    dtype = id_dtype(tokenizer)  # tasks that only cut need no tokenizer

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = None

        def batch_of(pieces: Iterator[tuple]) -> pa.RecordBatch:
            out = []
            for (doc, ids), start, length, sequence, offset in pieces:
                piece = ids[start : start + length].astype("<u4").tobytes()
                out.append((doc, start, length, zlib.crc32(piece), len(ids), sequence, offset))
            columns = zip(*out, strict=True) if out else ([] for _ in _PIECES_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_PIECES_ARROW)

        for batch in batches:
            if layout is None and len(batch):
                layout = Layout(capacity, batch.column(2)[0].as_py() << 33)
            documents = [(doc, np.frombuffer(ids, dtype)) for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch_of(chain.from_iterable(layout.add(d, len(d[1])) for d in documents))
        if layout:
            yield batch_of(layout.close())

    return laid.mapInArrow(cut, PIECES)
