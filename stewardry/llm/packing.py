"""Best-fit packing of token pieces after Martello and Toth's dominance reduction.

Only the number of pieces of each length reaches the driver. The reduction and the best-fit step work on those
counts and give a plan of bin shapes; pieces then take their places by their rank among the pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm.common import bounded_batches, grain_bits
from stewardry.session import materialise

CAPACITY = 1024
END_ID = 2
GRAIN = 10_000

#: A bin shape: (length, how many) runs in order; a plan: shapes and how many bins have each.
Shape = tuple[tuple[int, int], ...]


def _fits(counts: np.ndarray, room: int, held: dict[int, int]) -> tuple[int, list[int]]:
    """Longest remaining length within ``room``, and the up to three smallest lengths, without the items ``held``."""
    longest, small = 0, []
    for size in np.flatnonzero(counts[: room + 1])[::-1]:
        if counts[size] - held.get(int(size), 0) > 0:
            longest = int(size)
            break
    for size in np.flatnonzero(counts[: room + 1]):
        small += [int(size)] * min(3 - len(small), int(counts[size]) - held.get(int(size), 0))
        if len(small) >= 3:
            break
    return longest, small


def _best_pair(counts: np.ndarray, room: int, held: dict[int, int]) -> int:
    """The largest sum of two remaining items within ``room``; 0 if no two fit."""
    left = counts[: room + 1].copy()
    for size, n in held.items():
        if size <= room:
            left[size] -= n
    sizes, best = np.flatnonzero(left > 0), 0
    for size in sizes:
        mates = sizes[sizes <= room - size]
        if left[size] < 2:
            mates = mates[mates != size]
        if len(mates):
            best = max(best, int(size + mates[-1]))
    return best


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[Shape, int]]:
    """Fix item sets that dominate every other set with the same largest item, and take them out of ``counts``.

    For an item and the room it leaves: alone, if nothing else fits; with the longest item that fits, if that
    fills the bin, if no two items fit, or if at most two fit and no pair is longer than that item. In each case
    any other filling could be exchanged for it without more bins. Equal items are fixed together as long as the
    reason holds; passes repeat until nothing changes.
    """
    fixed: list[tuple[Shape, int]] = []
    changed = True
    while changed:
        changed = False
        for size in range(capacity, 0, -1):
            while counts[size] > 0:
                held = {size: 1}
                room = capacity - size
                mate, small = _fits(counts, room, held)
                if not mate:
                    n, shape = (int(counts[size]) if 2 * size > capacity or counts[size] == 1 else 1), ((size, 1),)
                    counts[size] -= n
                else:
                    lone = mate == room or len(small) < 2 or small[0] + small[1] > room
                    pair = not lone and (len(small) < 3 or sum(small) > room) and _best_pair(counts, room, held) <= mate
                    if not (lone or pair):
                        break
                    # Items leave two lengths only, so the reason can only grow stronger until one runs out.
                    n = int(counts[size]) // 2 if mate == size else int(min(counts[size], counts[mate]))
                    shape = ((size, 2),) if mate == size else ((size, 1), (mate, 1))
                    for length, times in shape:
                        counts[length] -= n * times
                fixed.append((shape, n))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Shape, int]]:
    """Best-fit decreasing, many equal items at a time: each goes to the fullest open bin that takes it."""
    bins: dict[int, list[tuple[Shape, int]]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            room = min((r for r in bins if r >= size and bins[r]), default=capacity)
            shape, n = bins[room].pop() if bins.get(room) else ((), left)
            times = min(room // size, left)  # a bin stays the fullest that fits until the item no longer fits
            used = min(n, left // times)
            if used < n and shape:
                bins[room].append((shape, n - used))
            bins.setdefault(room - times * size, []).append(((*shape, (size, times)), used))
            left -= used * times
        counts[size] = 0
    return [entry for group in bins.values() for entry in group]


def plan_bins(counts: np.ndarray, capacity: int) -> tuple[list[tuple[Shape, int]], int]:
    """Bin shapes for ``counts[length]`` pieces of each length, and how many of those bins the reduction fixed."""
    counts = counts.astype(np.int64).copy()
    fixed = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(counts, capacity), sum(n for _, n in fixed)


def _plan_table(plan: list[tuple[Shape, int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces to a bin, first bin, offset in the bin)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for shape, n in plan:
        offset = 0
        for length, times in shape:
            rows.setdefault(length, []).append((seen.get(length, 0), times, base, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += length * times
        base += n
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _encoder(tokenizer: str):
    """The ids of byte-level BPE ranks; an end-of-text string in a text is that one token, as in the JSON form."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    coder = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if "<|endoftext|>" in text:
            return coder.encode(text, allowed_special="all")
        return coder.encode_ordinary(text)

    return encode


_loaded: dict[str, object] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(df: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokens of each text and an end id, cut into pieces of ``capacity``; only the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = _encoder(tokenizer)
        encode = _loaded[tokenizer]
        for batch in batches:
            out: list[list[int | None]] = [[], [], [], [], []]
            done: dict[str, np.ndarray] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                ids = done.get(text)
                if ids is None:
                    ids = done[text] = np.array([*encode(text), end_id], "<u4")
                start, piece = 0, 0
                stop = (len(ids) - 1) % capacity + 1
                while start < len(ids):
                    for column, value in zip(out, (doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())), strict=True):
                        column.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


def pack(df: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, grain: int = GRAIN) -> DataFrame:
    """Pack all texts into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A NULL text counts
    as empty and gives its end token; a NULL id is kept; repeated rows are packed each; further columns are
    ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    pieces = materialise(token_pieces(df, tokenizer=tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    plan, _ = plan_bins(counts, capacity)
    table = spark.sparkContext.broadcast(_plan_table(plan))  # bounded by the capacity, not by the documents

    buckets = 1 << grain_bits(int(counts.sum()), grain)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(within) - 1)
        .join(shifts, ["length", "_bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_shift") + F.col("_rank")).alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                at, rows = lengths == length, table.value[int(length)]
                use = rows[np.searchsorted(rows[:, 0], ranks[at], "right") - 1]
                within_run = ranks[at] - use[:, 0]
                bins[at] = use[:, 2] + within_run // use[:, 1]
                offsets[at] = use[:, 3] + within_run % use[:, 1] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(bins), pa.array(offsets)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
