"""What the operators of this folder share: rows in order, bounded Arrow batches, and word hashes of byte arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stewardry.session import materialise

#: Order of a row whose id is NULL: before all others.
NULL_ORDER = -(2**63)

#: Most bytes and rows of one Arrow batch; texts of a batch are handled in pieces of about CHUNK_BYTES.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 50_000
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python by bytes, not rows: few long texts or many narrow rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_tag(text: Column) -> Column:
    """The whole hash of a text, with NULL as ''; fewer bits would take different texts of a frequent id for one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row_order`` (the id, NULL first), ``row_tag`` (64 bits that tell texts of one id apart) and ``text`` ('' for NULL)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ORDER)).alias("row_order"),
        text_tag(F.col(text_col)).alias("row_tag"),
        text.alias("text"),
    )


def id_of(order: Column) -> Column:
    return F.when(order != F.lit(NULL_ORDER), order)


def grain_bits(rows: int, grain: int) -> int:
    """Bits of a bucket number that leave about ``grain`` rows to a bucket; from some 10**10 rows on, more."""
    return min(22, max(0, math.ceil(math.log2(max(1, rows) / grain))))


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``place``, its rows' number from 0 in ``order``, which must tell all rows apart.

    Rows are dealt by ranges of ``order`` and numbered within their task; what lies before a task's rows is added from
    one count a task. ``df`` is read twice, so it should be a written table of narrow rows.
    """
    sort = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(sort.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    rows = rows.withColumn("_part", part).join(F.broadcast(shifts), "_part")  # one row a task
    return rows.withColumn("place", F.col("_shift") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_shift")


#: Bitmaps of 32,768 bits each that a tag filter has: 4 MB in all.
FILTER_BITMAPS = 1024


def tag_filter(tags: DataFrame, column: str = "row_tag") -> DataFrame:
    """Bitmaps that tell which 64-bit hashes may be in ``column``. Their size is fixed; more hashes make them less selective."""
    cut = tags.select(_bitmap_of(F.col(column)), _bit_of(F.col(column)))
    return materialise(cut.groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "filter")


def _bitmap_of(tag: Column) -> Column:
    return F.pmod(F.shiftright(tag, 20), F.lit(FILTER_BITMAPS)).alias("_bitmap")


def _bit_of(tag: Column) -> Column:
    return F.pmod(tag, F.lit(32_768)).alias("_bit")


def may_be_in(rows: DataFrame, bitmaps: DataFrame, column: str = "row_tag") -> DataFrame:
    """The rows whose hash may be among those of :func:`tag_filter`; all that are, and few others.

    Ahead of a join it keeps the other rows and their texts out of the shuffle.
    """
    byte = F.expr("conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10)").cast("int")
    asked = rows.withColumns({"_bitmap": _bitmap_of(F.col(column)), "_bit": _bit_of(F.col(column))})
    found = asked.join(F.broadcast(bitmaps), "_bitmap")  # FILTER_BITMAPS rows of 4 KB at most
    return found.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0).select(*rows.columns)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and the offsets of its rows; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offs


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together; a longer row comes alone."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop
        start = stop


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < size:
        with np.errstate(over="ignore"):
            for which, base in enumerate((_BASE, _BASE_INVERSE)):
                steps = np.full(size * 5 // 4, base, np.uint64)
                steps[0] = 1
                _powers[which] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: A random number per byte value, and the same after lowering A-Z.
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_CODES = _BYTE_CODES[_LOWER]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` takes the hash of any span from it."""
    up, _ = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum((_LOWER_CODES if lower else _BYTE_CODES)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that cross no row: starts, ends (exclusive) and row numbers. ``offsets`` start at 0."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space, as ``spans``."""
    return spans(~_SPACE[data], offsets)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z lowered, and its row."""
    starts, ends, rows = words(data, offsets)
    return span_hash(prefix_hash(data, lower=True), starts, ends), rows


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words within a row, in order; a shorter row gives its whole run. ``rows`` ascend."""
    m = len(hashes)
    if not m:
        return hashes, rows
    whole = np.zeros(m, bool)
    if m >= n:
        whole[: m - n + 1] = rows[: m - n + 1] == rows[n - 1 :]
    first = np.ones(m, bool)
    first[1:] = rows[1:] != rows[:-1]
    at = np.flatnonzero(whole | first)
    length = np.ones(len(at), np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[at].copy()
        for k in range(1, n):
            nxt = np.minimum(at + k, m - 1)
            ok = (at + k < m) & (rows[nxt] == rows[at])
            out[ok] = out[ok] * _BASE + hashes[nxt[ok]]
            length += ok
        return mix(out + length), rows[at]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
