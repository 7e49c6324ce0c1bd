"""Removal of every long string that occurred earlier, by prefix-free parsing.

A rolling hash over each text picks trigger places: in every window of WINDOW bytes the KMER bytes with the
smallest hash. A window belongs to its trigger, so a text falls into phrases, each the windows of one trigger and
all bytes they cover. Equal windows have equal triggers at equal offsets. The dictionary holds each phrase once,
with the first place where the parse uses it; on repetitive text it is far smaller than the text.

* A later use of a phrase is removed whole: all its windows also start earlier.
* The first use of a phrase is new unless another phrase has the same trigger. Only then can some of its windows
  occur elsewhere. The windows are sorted into CONTEXTS classes by how far ahead of the trigger they begin; all of a
  class hold the same bytes around the trigger, so a class whose bytes no other phrase has is new too.
* The suffixes of the phrases that are left are put in order, cut at WINDOW bytes, by doubling ranks. Windows of
  equal rank, over all blocks of phrases, are one run of the corpus order, and all but the earliest of a run are
  removed.

Each step first works within a block of rows in a task, so a key that many rows share reaches the shuffle once
per block, and what follows the shuffle streams through sorted rows and holds one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm.common import CHUNK_BYTES, bounded_batches, bytes_of, chunks, id_of, keyed, mix, prefix_hash, signed, span_hash
from stewardry.session import materialise

WINDOW = 100
KMER = 32

#: Phrases of a block, at most about; blocks of one task are handled one after another.
BLOCK_PHRASES = 1_000_000
#: Bytes of phrases whose suffixes are put in order together, about.
BLOCK_BYTES = 8 << 20

#: Classes of a phrase's windows.
CONTEXTS = 4

#: State of windows known to start earlier; else it is how far behind a phrase's start its trigger stands.
_GONE = -1
_USES = "key long, other long, row_order long, row_tag long, start int, windows int, state int"
_NAMES = ["key", "other", "row_order", "row_tag", "start", "windows", "state"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, kmer: int = KMER):
    """Trigger hash, phrase hash, row, start within the row, windows and trigger's place behind the start of each
    phrase. ``offsets`` start at 0."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    prefix = prefix_hash(data)
    at = np.arange(len(data) - kmer + 1)
    hashes = span_hash(prefix, at, at + kmer)
    low = np.uint64((1 << 24) - 1)
    ranked = (hashes & ~low) | (low - at.astype(np.uint64))  # of equal hashes the last
    trigger = (low - (_sliding_min(ranked, window - kmer + 1) & low)).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(trigger)]
    whole = np.arange(len(trigger)) + window <= offsets[rows + 1]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (trigger[1:] != trigger[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(first)
    ends = np.concatenate([starts[1:], [len(whole)]])
    # A phrase also ends where windows stop being whole.
    counted = np.concatenate([[0], np.cumsum(whole)])
    windows = counted[ends] - counted[starts]
    return hashes[trigger[starts]], span_hash(prefix, starts, starts + windows + window - 1), rows[starts], starts - offsets[rows[starts]], windows, trigger[starts] - starts


def _segments(offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of text to parse: (first row, last row, first byte, last byte); a long row comes in overlapping pieces."""
    for a, b in chunks(offsets):
        begin, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - begin <= 4 * CHUNK_BYTES:
            yield a, b, begin, end
            continue
        for start in range(begin, max(begin + 1, end - window + 1), CHUNK_BYTES):
            yield a, b, start, min(end, start + CHUNK_BYTES + window - 1)


def _distinct(block: list[np.ndarray], before: tuple[int, ...] | None = None) -> list[np.ndarray]:
    """Sorted rows without those that repeat the one before: a repeated document is not its own earlier copy."""
    if not len(block[0]):
        return block
    same = np.ones(len(block[0]), bool)
    for k in range(5):
        same[1:] &= block[k][1:] == block[k][:-1]
    same[0] = before == tuple(int(block[k][0]) for k in range(5))
    return [x[~same] for x in block]


def _last(block: list[np.ndarray], before: tuple[int, ...] | None) -> tuple[int, ...] | None:
    return tuple(int(block[k][-1]) for k in range(5)) if len(block[0]) else before


def _first_uses(block: list[np.ndarray]) -> list[np.ndarray]:
    """Leave the first row of each (key, other) as it is and mark the others gone."""
    order = np.lexsort((block[4], block[3], block[2], block[1], block[0]))
    block = _distinct([x[order] for x in block])
    again = np.zeros(len(block[0]), bool)
    again[1:] = (block[0][1:] == block[0][:-1]) & (block[1][1:] == block[1][:-1])
    return [*block[:6], np.where(again, _GONE, block[6]).astype(np.int32)]


def _joined(block: list[np.ndarray]) -> list[np.ndarray]:
    """Join gone windows that follow each other, and deal them out by document instead of by key."""
    gone = block[6] == _GONE
    kept = [x[~gone] for x in block]
    late = [x[gone] for x in block]
    order = np.lexsort((late[4], late[3], late[2]))
    late = [x[order] for x in late]
    start, stop = late[4].astype(np.int64), late[4].astype(np.int64) + late[5]
    head = np.ones(len(order), bool)
    head[1:] = (late[2][1:] != late[2][:-1]) | (late[3][1:] != late[3][:-1]) | (start[1:] != stop[:-1])
    at = np.flatnonzero(head)
    if len(at):
        tail = np.concatenate([at[1:] - 1, [len(order) - 1]])
        late = [x[at] for x in late]
        late[5] = (stop[tail] - start[at]).astype(np.int32)
        late[0] = signed(mix((late[2] + late[4]).astype(np.uint64)))
        late[1] = np.zeros(len(at), np.int64)
    return [np.concatenate(x) for x in zip(kept, late, strict=True)]


def _record(block: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(block, _TYPES, strict=True)], names=_NAMES)


def _parse(window: int, kmer: int):
    """Rows (order, tag, text) to first uses and gone windows, block by block."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                block = [np.concatenate(x) for x in zip(*held, strict=True)]
                held.clear()
                yield _record(_joined(_first_uses(block)))

        for batch in batches:
            orders, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = bytes_of(batch.column(2))
            for a, b, begin, end in _segments(offsets, window):
                offs = np.clip(offsets[a : b + 1], begin, end) - begin
                key, phrase, rows, starts, windows, behind = phrases(data[begin:end], offs, window, kmer)
                shift = begin - offsets[a] if b - a == 1 else 0
                held.append([signed(key), signed(phrase), orders[a + rows], tags[a + rows], (starts + shift).astype(np.int32), windows.astype(np.int32), behind.astype(np.int32)])
            if sum(len(x[0]) for x in held) >= BLOCK_PHRASES:
                yield from flush()
        yield from flush()

    return parse


def _shared_triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key, phrase and place: pass on gone windows, call further uses of a phrase gone, and pass
    on first uses where the key has another phrase too. The first phrase of a key waits until another comes."""
    last: tuple[int, ...] | None = None
    waiting: list[np.ndarray] | None = None
    for batch in batches:
        block = [batch.column(k).to_numpy() for k in range(7)]
        passed = block[6] == _GONE
        out = [[x[passed] for x in block]]
        block = _distinct([x[~passed] for x in block], last)
        n = len(block[0])
        if n:
            key, phrase = block[0], block[1]
            new_key, new_phrase = np.ones(n, bool), np.ones(n, bool)
            new_key[1:] = key[1:] != key[:-1]
            new_phrase[1:] = new_key[1:] | (phrase[1:] != phrase[:-1])
            new_key[0] = last is None or last[0] != key[0]
            new_phrase[0] = new_key[0] or last[1] != phrase[0]
            if new_key[0]:
                waiting = None
            group = np.cumsum(new_key)  # 0: goes on from the batch before
            fresh = np.bincount(group, new_phrase & ~new_key, group[-1] + 1) > 0  # another phrase of this key comes here
            opened = np.bincount(group, new_key, group[-1] + 1) > 0
            lone_first = new_key & ~fresh[group]
            if not opened[0] and fresh[0] and waiting is not None:
                out.append(waiting)
                waiting = None
            again = [x[~new_phrase] for x in block]
            again[6] = np.full(len(again[0]), _GONE, np.int32)
            out.append(again)
            send = new_phrase & ~lone_first
            out.append([x[send] for x in block])
            tail = np.flatnonzero(lone_first & (group == group[-1]))
            if len(tail):
                waiting = [x[tail] for x in block]
            elif group[-1] > 0:
                waiting = None
            last = _last(block, last)
        yield _record([np.concatenate(x) for x in zip(*out, strict=True)])


def _pair_ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return np.unique((high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64), return_inverse=True)[1]


def suffix_ranks(data: np.ndarray, places: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ranks of the suffixes at ``places``, cut at ``window`` bytes: equal exactly for equal strings.

    Ranks of 8 bytes are doubled to the largest power of two within the window; two of those that overlap make the
    whole. Every place must have ``window`` bytes.
    """
    padded = np.concatenate([data, np.zeros(2 * window, np.uint8)])
    words = np.zeros(len(data) + window, np.uint64)
    for k in range(min(8, window)):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    ranks, width = np.unique(words, return_inverse=True)[1], min(8, window)
    while width * 2 <= window:
        ranks = np.concatenate([ranks, np.zeros(width, ranks.dtype)])
        ranks = _pair_ranks(ranks[:-width], ranks[width:])
        width *= 2
    return _pair_ranks(ranks[places], ranks[places + window - width])


_PIECES = "row_order long, row_tag long, start int, windows int, behind int, bytes binary"


def _pieces(window: int):
    """Rows (order, tag, text, phrases) to the bytes of those phrases."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = bytes_of(batch.column(2))
            out: list[list] = [[], [], [], [], [], []]
            for k, uses in enumerate(batch.column(3).to_pylist()):
                for u in uses:
                    at = int(offsets[k]) + u["start"]
                    for column, value in zip(out, (orders[k], tags[k], u["start"], u["windows"], u["state"], data[at : at + u["windows"] + window - 1].tobytes()), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["row_order", "row_tag", "start", "windows", "behind", "bytes"])

    return pieces


def _contexts(window: int, kmer: int):
    """Pieces to one row per class of their windows: the hash of the bytes that all windows of the class hold.

    What a batch shows to be shared is known; one of its rows goes on under the hash alone, so that other batches
    see it, and the others are spread.
    """
    step = -(-(window - kmer + 1) // CONTEXTS)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, tag, start, windows, behind = (batch.column(k).to_numpy() for k in range(5))
            data, place = bytes_of(batch.column(5))
            prefix = prefix_hash(data)
            rows: list[list[np.ndarray]] = []
            for c in range(CONTEXTS):
                low, high = c * step, c * step + step - 1
                first, last = np.maximum(0, behind - high), np.minimum(windows - 1, behind - low)
                at = np.flatnonzero(first <= last)
                trigger = place[at] + behind[at]
                ends = np.minimum(trigger + window - high, len(data))
                key = mix(span_hash(prefix, trigger - low, np.maximum(ends, trigger - low)) + np.uint64(c))
                rows.append([signed(key), order[at], tag[at], start[at], first[at], (last - first + 1)[at]])
            key, order, tag, start, first, count = (np.concatenate(x) for x in zip(*rows, strict=True))
            by = np.lexsort((start, tag, order, key))
            key, order, tag, start, first, count = (x[by] for x in (key, order, tag, start, first, count))
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()  # not a repeated document's
            new[1:] |= (order[1:] != order[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1])
            group = np.cumsum(new_key) - 1
            known = (np.bincount(group[new], minlength=group[-1] + 1 if len(group) else 0) > 1)[group]
            salt = np.where(new_key, 0, 1 + np.arange(len(key)) % 1024)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (key[new], salt[new].astype(np.int32), known[new], order[new], tag[new], start[new], first[new].astype(np.int32), count[new].astype(np.int32))],
                names=["key", "salt", "known", "row_order", "row_tag", "start", "first", "count"],
            )

    return contexts


def _shared_contexts(pieces: DataFrame, window: int, kmer: int) -> DataFrame:
    """Classes whose bytes another phrase has: ``row_order, row_tag, start, classes``."""
    rows = pieces.mapInArrow(_contexts(window, kmer), "key long, salt int, known boolean, row_order long, row_tag long, start int, first int, count int")
    place, key = F.struct("row_order", "row_tag", "start"), Window.partitionBy("key", "salt")
    shared = F.col("known") | (F.min(place).over(key) != F.max(place).over(key)) | F.max("known").over(key)
    found = rows.withColumn("_shared", shared).filter("_shared")
    return found.groupBy("row_order", "row_tag", "start").agg(F.collect_set(F.struct("first", "count")).alias("classes"))  # CONTEXTS at most


def _suffix_runs(window: int):
    """Rows (order, tag, start, bytes, classes) to the earliest window of each run of a block, and gone ones."""

    def order_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if not held:
                return
            data = np.frombuffer(b"".join(texts), np.uint8)
            place, order, tag, start = (np.concatenate(x) for x in zip(*held, strict=True))
            texts.clear(), held.clear()
            size = 0
            rank = suffix_ranks(data, place, window)
            by = np.lexsort((start, tag, order, rank))
            rank, order, tag, start, _, place = _distinct([x[by] for x in (rank, order, tag, start, start, place)])
            again = np.zeros(len(rank), bool)
            again[1:] = rank[1:] == rank[:-1]
            ahead, behind = prefix_hash(data), prefix_hash(data[::-1])
            key = span_hash(ahead, place, place + window)
            other = span_hash(behind, len(data) - place - window, len(data) - place)  # read backwards: a second hash
            block = [signed(key), signed(other), order, tag, start, np.ones(len(rank), np.int32), np.where(again, _GONE, 0).astype(np.int32)]
            yield _record(_joined(block))

        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(5))
            for order, tag, start, text, classes in zip(*columns, strict=True):
                texts.append(text)
                at = np.concatenate([np.arange(c["first"], c["first"] + c["count"]) for c in classes])
                held.append([size + at, np.full(len(at), order), np.full(len(at), tag), (start + at).astype(np.int32)])
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from flush()
        yield from flush()

    return order_suffixes


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over windows sorted by hashes and place: only those that are not the first of their run, and gone ones."""
    last: tuple[int, ...] | None = None
    for batch in batches:
        block = [batch.column(k).to_numpy() for k in range(7)]
        gone = block[6] == _GONE
        out = [x[gone] for x in block]
        block = _distinct([x[~gone] for x in block], last)
        if len(block[0]):
            key, other = block[0], block[1]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (other[1:] == other[:-1])
            again[0] = last is not None and last[:2] == (int(key[0]), int(other[0]))
            last = _last(block, last)
            block[6] = np.full(len(key), _GONE, np.int32)
            out = [np.concatenate([x, y[again]]) for x, y in zip(out, block, strict=True)]
        yield _record(_joined(out))


def _cut(window: int):
    """Rows (id, text, gone windows) to the text without them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            uses = batch.column(2).to_pylist()
            n_bytes, n_removed, n_spans, hashes, kept_texts = [], [], [], [], []
            for k in range(len(uses)):
                text = data[offsets[k] : offsets[k + 1]]
                removed = count = 0
                kept: list[bytes] = []
                at = 0
                runs = sorted((u["start"], u["start"] + u["windows"] + window - 1) for u in uses[k] or ())
                merged: list[list[int]] = []
                for s, e in runs:
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                for s, e in merged:
                    kept.append(text[at:s].tobytes())
                    removed, count, at = removed + e - s, count + 1, e
                kept.append(text[at:].tobytes())
                rest = b"".join(kept)
                n_bytes.append(len(text)), n_removed.append(removed), n_spans.append(count)
                hashes.append(hashlib.sha256(rest).hexdigest()), kept_texts.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(hashes, pa.string()), pa.array(kept_texts, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return cut


def _sorted_pass(df: DataFrame, step) -> DataFrame:
    """Bring the rows of a key together, sort them and stream through them."""
    return df.repartition(F.col("key")).sortWithinPartitions("key", "other", "row_order", "row_tag", "start").mapInArrow(step, _USES)


def _by_row(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("row_order", "row_tag").agg(F.collect_list(F.struct("start", "windows")).alias(name))  # bounded by the text


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Remove each byte that lies in a ``window``-byte string which also starts earlier.

    Earlier: in a document with a smaller id, or further ahead in the same one. Texts are UTF-8 bytes, strings
    never cross documents, and all are judged on the input. Returns ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept`` (the bytes left, as binary). A NULL text counts as empty, a NULL id comes before all others,
    texts under one id are ordered by a tag of the text, equal rows (same id and text) count as one document and
    get the same answer each, further columns are ignored, and an empty table gives no rows.
    """
    if not 0 < kmer <= window:
        raise ValueError("kmer must be within window")
    bounded_batches(df.sparkSession)
    docs = keyed(df, id_col, text_col)
    uses = docs.filter(F.octet_length("text") >= window).mapInArrow(_parse(window, kmer), _USES)
    phrase_rows = materialise(_sorted_pass(uses, _shared_triggers), "phrases")
    opened = phrase_rows.filter(F.col("state") != _GONE).select("row_order", "row_tag", F.struct("start", "windows", "state").alias("use"))
    opened = opened.groupBy("row_order", "row_tag").agg(F.collect_set("use").alias("uses"))  # bounded by the text
    pieces = docs.join(opened, ["row_order", "row_tag"]).select("row_order", "row_tag", "text", "uses").mapInArrow(_pieces(window), _PIECES)
    pieces = materialise(pieces, "pieces")
    compared = pieces.join(_shared_contexts(pieces, window, kmer), ["row_order", "row_tag", "start"])
    windows = compared.select("row_order", "row_tag", "start", "bytes", "classes").mapInArrow(_suffix_runs(window), _USES)
    later = materialise(_sorted_pass(windows, _later_windows), "windows")
    gone = phrase_rows.filter(F.col("state") == _GONE).unionByName(later)
    rows = docs.join(_by_row(gone, "gone"), ["row_order", "row_tag"], "left")
    return rows.select(id_of(F.col("row_order")), "text", "gone").mapInArrow(_cut(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
