"""Line dedup by a segment-partition edit join.

A line is a repeat if a line within ``edits`` single-byte edits of it stands earlier. Equal lines are brought
together by their hash first. For the distinct ones, a line of length L is cut into ``edits + 1`` segments: of two
lines within reach, the one has at least one segment of the other whole, close to its place. Each line offers its
own segments under (length, segment number, bytes), and looks up, for every length from its own down to ``edits``
less, the substrings that can match a segment there. Two lines that meet are compared by sketches first: each byte
trigram of a line flips one of 256 bits, and an edit touches three trigrams at most, so lines within reach differ in
``6 * edits`` bits at most. What is left is verified by banded bit-parallel edit distance.

Only whether some earlier line is within reach matters, so each line first meets one earlier line of its buckets,
the one it meets most often; those that are repeats already are not compared further, the others meet the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm.common import NULL_ORDER, bounded_batches, bytes_of, chunks, keyed, mix, prefix_hash, signed, span_hash, text_tag
from stewardry.session import materialise

EDITS = 2
#: Shorter lines (bytes without white space at the ends) are left alone.
LEAST_BYTES = 40
BLOCK_LINES = 200_000

_LINE, _GONE, _SEGMENT, _PROBE = 0, 1, 2, 3
_SKETCH = ["s0", "s1", "s2", "s3"]
_ROWS = "key long, id long, kind int, row_order long, row_tag long, line int, s0 long, s1 long, s2 long, s3 long"
_ROWS_ARROW = pa.schema(
    [("key", pa.int64()), ("id", pa.int64()), ("kind", pa.int32()), ("row_order", pa.int64()), ("row_tag", pa.int64()), ("line", pa.int32()), *((s, pa.int64()) for s in _SKETCH)]
)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def trimmed_lines(data: np.ndarray, offsets: np.ndarray):
    """Start and end of each line without white space at its ends, its row and its number in the row."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    starts = starts[starts < len(data)]
    rows = np.searchsorted(offsets, starts, "right") - 1
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    ink = np.flatnonzero(~_SPACE[data])
    first = np.searchsorted(ink, starts)
    last = np.searchsorted(ink, ends) - 1
    full = last >= first
    begin, stop = starts.copy(), starts.copy()
    begin[full], stop[full] = ink[first[full]], ink[last[full]] + 1
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[rows])
    return begin, stop, rows, line


def sketches(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each line, 256 bits of which each byte trigram flips one, as four numbers."""
    count = np.maximum(stop - begin - 2, 0)
    of = np.repeat(np.arange(len(begin)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + begin[of]
    gram = (data[at].astype(np.uint64) << np.uint64(16)) | (data[at + 1].astype(np.uint64) << np.uint64(8)) | data[at + 2]
    with np.errstate(over="ignore"):
        bit = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
    flips = np.bincount(of * 256 + bit, minlength=len(begin) * 256).reshape(-1, 256) & 1
    return np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view("<i8")


def _segment(length: np.ndarray, edits: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of a segment: as even as can be, longer ones last."""
    size, longer = length // (edits + 1), length % (edits + 1)
    before = np.maximum(0, number - (edits + 1 - longer))
    return number * size + before, size + (number >= edits + 1 - longer)


def segment_keys(prefix: np.ndarray, begin: np.ndarray, stop: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Keys, which lines they are of, and the kind: segments offered, and substrings looked up."""
    length = stop - begin

    def key(at: np.ndarray, place: np.ndarray, size: np.ndarray, of: np.ndarray, number: int) -> np.ndarray:
        start = begin[at] + place
        with np.errstate(over="ignore"):
            tail = of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(number)
            return signed(mix(span_hash(prefix, start, start + size) + tail))

    for number in range(edits + 1):
        every = np.arange(len(begin))
        place, size = _segment(length, edits, number)
        yield key(every, place, size, length, number), every, _SEGMENT
        for less in range(edits + 1):
            of = length - less
            place, size = _segment(of, edits, number)
            low = max(-number, less - (edits - number))
            high = min(number, less + (edits - number))
            for shift in range(low, high + 1):
                if not less and not shift:
                    continue  # the line's own segment
                at = np.flatnonzero((of > edits) & (place + shift >= 0) & (place + shift + size <= length))
                yield key(at, place[at] + shift, size[at], of[at], number), at, _PROBE


def _offer(edits: int, least: int):
    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            orders, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = bytes_of(batch.column(2))
            for a, b in chunks(offsets):
                part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                begin, stop, rows, line = trimmed_lines(part, offs)
                use = stop - begin >= least
                begin, stop, rows, line = begin[use], stop[use], rows[use], line[use]
                if not len(begin):
                    continue
                prefix = prefix_hash(part)
                ids = signed(span_hash(prefix, begin, stop))
                places = list(zip(orders[a + rows].tolist(), tags[a + rows].tolist(), line.tolist(), strict=True))
                # Of the occurrences of a line that a block knows, only those that may be the first go under its key.
                fresh, maybe, later = [], [], []
                for k, (i, place) in enumerate(zip(ids.tolist(), places, strict=True)):
                    known = seen.get(i)
                    if known is None:
                        fresh.append(k)  # a block offers the segments of a line once
                    if known is None or place < known:
                        seen[i] = place
                        maybe.append(k)
                    elif place > known:
                        later.append(k)
                if len(seen) > BLOCK_LINES:
                    seen.clear()
                for kind, at in ((_LINE, np.array(maybe, np.int64)), (_GONE, np.array(later, np.int64))):
                    order, tag, number = orders[a + rows[at]], tags[a + rows[at]], line[at]
                    if kind == _LINE:
                        key, marks = ids[at], [pa.array(x) for x in np.ascontiguousarray(sketches(part, begin[at], stop[at]).T)]
                    else:
                        key = signed(mix(mix(order.astype(np.uint64)) ^ tag.astype(np.uint64) ^ number.astype(np.uint64)))
                        marks = [pa.nulls(len(at), pa.int64())] * 4
                    columns = (key, ids[at], np.full(len(at), kind), order, tag, number)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(columns, _ROWS_ARROW, strict=False)), *marks], schema=_ROWS_ARROW)
                fresh = np.array(fresh, np.int64)
                for keys, at, kind in segment_keys(prefix, begin[fresh], stop[fresh], edits):
                    none = pa.nulls(len(at), pa.int64())
                    place = [none, none, none.cast(pa.int32()), none, none, none, none]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[fresh[at]]), pa.array(np.full(len(at), kind, np.int32)), *place], schema=_ROWS_ARROW)

    return offer


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether the edit distance is at most ``edits`` (31 at most): bit-parallel, over the band of that width.

    Bit 63 stands for the lowest row of the band, so a column is one 64-bit step; the value at that row is followed
    down the diagonal and then along the last row.
    """
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    rows, columns = b[head : len(b) - tail], a[head : len(a) - tail]
    if not columns or not rows:
        return max(len(rows), len(columns)) <= edits
    ones = (1 << 64) - 1
    up, down, value = ones << (63 - edits) & ones, 0, edits
    turn = len(rows) - edits  # from this column on the last row is in the band
    for j in range(len(columns)):
        match = 0
        for back in range(2 * edits + 1):
            r = j + edits - back
            if 0 <= r < len(rows) and rows[r] == columns[j]:
                match |= 1 << (63 - back)
        zero = ((((match & up) + up) & ones) ^ up) | match | down
        plus = down | ~(zero | up) & ones
        minus = zero & up
        if j < turn:
            value += not zero >> 63 & 1
        else:
            bit = 62 - (j - turn)
            value += (plus >> bit & 1) - (minus >> bit & 1)
        if value > 2 * edits + 1:
            return False
        up = minus | ~((zero >> 1) | plus) & ones
        down = (zero >> 1) & plus
    return value <= edits


def _verify(edits: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            ok = [within(x, y, edits) for x, y in zip(mine, other, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], names=["id"])

    return verify


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, [(id, line)]) to the bytes of those lines."""
    for batch in batches:
        data, offsets = bytes_of(batch.column(0))
        ids, texts = [], []
        for k, wanted in enumerate(batch.column(1).to_pylist()):
            lines = data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n")
            for w in wanted:
                ids.append(w["id"])
                texts.append(lines[w["line"]].strip(b" \t\n\x0b\x0c\r"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["id", "bytes"])


def _repeats(met: DataFrame, first: DataFrame, docs: DataFrame, edits: int) -> DataFrame | None:
    """Ids of distinct lines with an earlier line within reach; None if no two lines meet."""
    place = F.struct("row_order", "row_tag", "line").alias("first")
    members = met.join(first.select("id", place, F.struct(*_SKETCH).alias("sketch")), "id")
    members = materialise(members.select("key", "id", (F.col("kind") == _SEGMENT).alias("own"), "first", "sketch"), "members")
    if members.isEmpty():
        return None
    wanted = members.select("id", "first").distinct().groupBy("first.row_order", "first.row_tag").agg(F.collect_list(F.struct("id", F.col("first.line").alias("line"))).alias("wanted"))
    texts = docs.join(wanted, ["row_order", "row_tag"]).select("text", "wanted").mapInArrow(_line_texts, "id long, bytes binary")
    texts = materialise(texts.groupBy("id").agg(F.first("bytes").alias("bytes")), "line-texts")
    others = members.select("key", *(F.col(c).alias(f"{c}2") for c in ("id", "own", "first", "sketch")))
    differ = sum((F.bit_count(F.col(f"sketch.{s}").bitwiseXOR(F.col(f"sketch2.{s}"))) for s in _SKETCH), F.lit(0))
    in_reach = F.expr("id != id2 AND first2 < first AND (own OR own2)") & (differ <= 6 * edits)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.select("id", "id2").join(texts, "id").join(texts.toDF("id2", "bytes2"), "id2").select("id", "bytes", "bytes2")
        return materialise(both.mapInArrow(_verify(edits), "id long").distinct(), "repeats")

    # The earliest line of each bucket, and the earliest that offers a segment there.
    pick = lambda rows: rows.groupBy("key").agg(F.min(F.struct("first", "id", "own", "sketch")).alias("_p"))
    earliest = pick(members).unionByName(pick(members.filter("own"))).distinct().select("key", *(F.col(f"_p.{c}").alias(f"{c}2") for c in ("id", "own", "first", "sketch")))
    met_first = members.join(earliest, "key").filter(in_reach).groupBy("id", "id2").agg(F.count("*").alias("_met"))
    found = verified(met_first.groupBy("id").agg(F.max(F.struct("_met", "id2")).alias("_best")).select("id", F.col("_best.id2").alias("id2")))
    rest = members.join(found, "id", "left_anti").join(others, "key").filter(in_reach).select("id", "id2").distinct()
    return found.unionByName(verified(rest)).distinct()


def gone_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``row_order, row_tag, line`` of every line that repeats an earlier one."""
    if not 0 <= edits <= 31 or least_bytes <= edits:
        raise ValueError("edits must be from 0 to 31 and less than least_bytes")
    bounded_batches(df.sparkSession)
    docs = keyed(df, id_col, text_col)
    rows = docs.mapInArrow(_offer(edits, least_bytes), _ROWS)
    key = Window.partitionBy("key")
    ordered = key.orderBy("id", "row_order", "row_tag", "line")
    before = F.lag(F.struct("id", "kind", "row_order", "row_tag", "line")).over(ordered)
    rows = (
        rows.withColumn("_before", before)
        .withColumn("_low", F.min("id").over(key))
        .withColumn("_high", F.max("id").over(key))
        .withColumn("_own", F.max(F.col("kind") == _SEGMENT).over(key))
    )
    again = F.col("_before").isNotNull() & (F.col("kind") == _LINE)
    same = F.col("_before") == F.struct("id", "kind", "row_order", "row_tag", "line")
    whole = F.when(F.col("kind") == _GONE, F.lit(True)).when(F.col("kind") == _LINE, ~F.coalesce(same, F.lit(False)))
    rows = rows.filter(whole.otherwise((F.col("_low") != F.col("_high")) & F.col("_own")))
    rows = rows.withColumn("kind", F.when(again, F.lit(_GONE)).otherwise(F.col("kind"))).drop("_before", "_low", "_high", "_own")
    rows = materialise(rows, "lines")
    met = rows.filter(F.col("kind").isin(_SEGMENT, _PROBE)).select("key", "id", "kind").distinct()
    first = rows.filter(F.col("kind") == _LINE)
    gone = rows.filter(F.col("kind") == _GONE).select("row_order", "row_tag", "line")
    near = _repeats(met, first, docs, edits)
    if near is not None:
        gone = gone.unionByName(first.join(near, "id").select("row_order", "row_tag", "line"))
    return gone


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text_at = batch.num_columns - 2
        kept, total, removed = [], [], []
        for text, gone in zip(batch.column(text_at).to_pylist(), batch.column(text_at + 1).to_pylist(), strict=True):
            lines = text.split("\n") if text else []
            drop = set(gone or ())
            kept.append(text if not drop else "\n".join(x for k, x in enumerate(lines) if k not in drop))
            total.append(len(lines))
            removed.append(len(drop))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:text_at], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
            names=[*batch.schema.names[:text_at], "kept", "n_lines", "n_gone"],
        )


def drop_repeated_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), edits: int = EDITS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Remove every line within ``edits`` single-byte edits of an earlier line (smaller id, or further up).

    Lines end at line feeds; white space at their ends does not count, and lines of fewer than ``least_bytes`` bytes
    without it are left alone. All lines are judged on the input. Adds to the columns ``keep`` and the id:
    ``kept`` (the text that is left), ``n_lines`` and ``n_gone``. A NULL text stays NULL with 0 lines, a NULL id comes
    before all others, texts under one id are ordered by a tag of the text, equal rows count as one document and
    get the same answer each, further columns are ignored, and an empty table gives no rows.
    """
    gone = gone_lines(df, id_col=id_col, text_col=text_col, edits=edits, least_bytes=least_bytes)
    lines = gone.groupBy("row_order", "row_tag").agg(F.collect_set("line").alias("_gone"))  # bounded by the text
    columns = [F.col(id_col).alias("_id"), *(F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)), F.col(text_col).cast("string").alias("_text")]
    docs = df.select(*columns)
    docs = docs.withColumn("row_order", F.coalesce(F.col("_id").cast("long"), F.lit(NULL_ORDER))).withColumn("row_tag", text_tag(F.col("_text")))
    kept = docs.join(lines, ["row_order", "row_tag"], "left").select("_id", *(f"_keep{k}" for k in range(len(keep))), "_text", "_gone")
    schema = kept.drop("_text", "_gone").schema.add("kept", "string").add("n_lines", "long").add("n_gone", "long")
    return kept.mapInArrow(_without, schema).toDF(id_col, *keep, "kept", "n_lines", "n_gone")
