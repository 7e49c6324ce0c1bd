"""Importance resampling towards a target distribution, by hashed word n-grams.

A table of 256 bytes lower-cases A-Z and blanks every separator of a text's UTF-8 bytes, ``bytes.split`` gives its words,
and chained ``zlib.crc32`` seeds extend a run's checksum by one word at a time. Tasks add up the hashed features in
Counters, so what leaves a task is bounded by the number of buckets, however many words the corpus has.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import bounded_batches, placed
from stewardry.session import materialise

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = "2024"

#: Digits, a-z and all bytes of non-ASCII letters stay, A-Z are lowered, everything else separates.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def run_checksums(words: list[bytes], ngram: int) -> Iterator[list[int]]:
    """CRC-32 of all runs of 1, 2, ... ``ngram`` words joined by a space: each length extends the one before."""
    runs = list(map(zlib.crc32, words))
    yield runs
    for n in range(1, ngram):
        runs = [zlib.crc32(word, zlib.crc32(b" ", run)) for run, word in zip(runs, words[n:])]  # noqa: B905
        yield runs


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def bucket_counts(df: DataFrame, *, text_col: str = "text", ngram: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket. A task gives ``buckets`` rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            seen: Counter[int] = Counter()
            for text in _texts(batch.column(0)):
                for runs in run_checksums(split_words(text), ngram):
                    seen.update(runs)
            if seen:
                at = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
                np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["bucket", "n"])

    bounded_batches(df.sparkSession)
    counted = df.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket in the target and in the source."""
    size = len(source)
    up, down = int(source.sum()) + size, int(target.sum()) + size
    ratios = ((float((int(t) + 1) * up), float((int(s) + 1) * down)) for s, t in zip(source, target, strict=True))
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in ratios], np.int64)


def gumbel(doc_id: int | None, seed: str = SEED) -> int:
    """A document's seeded draw in thousandths; NULL draws like an empty id."""
    drawn = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("tie", pa.int64())])


def scores(df: DataFrame, gains: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", ngram: int = 1, seed: str = SEED) -> DataFrame:
    """Per document ``doc_id, n_features, n_words, weight, score, tie`` (a number of the row)."""
    shared = df.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, buckets = shared.value.tolist(), len(shared.value)
        for batch in batches:
            out: list[list[int | None]] = [[], [], [], []]
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, _texts(batch.column(1)), strict=True):
                words = split_words(text)
                weight = features = 0
                for runs in run_checksums(words, ngram):
                    features += len(runs)
                    weight += sum(gain[run % buckets] * n for run, n in Counter(runs).items())
                for column, value in zip(out, (features, len(words), weight, weight + gumbel(doc, seed)), strict=True):
                    column.append(value)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in out), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCORED)

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.monotonically_increasing_id())
    return rows.mapInArrow(score, "doc_id long, n_features long, n_words long, weight long, score long, tie long")


def resample(
    df: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    ngram: int = 1,
    buckets: int = BUCKETS,
    share: tuple[int, int] = (10, 100),
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """Draw documents so that they look like ``target``: Gumbel top-k over hashed n-gram importance weights.

    Returns ``doc_id, n_features, weight, score, rank`` for every row; ``rank`` counts the drawn ones from 1 and is NULL
    for the rest. The share is taken of the documents with ``least_words`` words at least, rounded down.

    Both sides are counted in full. Ranks come from one range sort of narrow rows, so equal scores, ids or texts in any
    number are spread over tasks. NULL texts have no words, a NULL id draws like an empty one and precedes others in
    ties, repeated rows are ranked each (in the order of the input's files), further columns are ignored; an empty
    table gives no rows, and an empty target only smooths.
    """
    source = _array(bucket_counts(df, text_col=text_col, ngram=ngram, buckets=buckets), buckets)
    wanted = _array(bucket_counts(target, text_col=target_col, ngram=ngram, buckets=buckets), buckets)
    scored = materialise(scores(df, bucket_gains(source, wanted), id_col=id_col, text_col=text_col, ngram=ngram, seed=seed), "scored")
    fit = F.col("n_words") >= least_words
    ordered = placed(scored.filter(fit), [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("tie")])
    drawn = ordered.count() * share[0] // share[1]
    columns = ("doc_id", "n_features", "weight", "score")
    ranked = ordered.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(scored.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
