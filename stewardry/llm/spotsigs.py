"""Document fingerprints from spots: chains of content words that follow common words.

Wherever an anchor (a common word) stands, the content words after it, every ``distance``-th of them, make a chain; the
anchor and its chain are one signature. Boilerplate has few anchors, prose many, so the set of signatures is a
fingerprint of the prose. Two sets are compared by Jaccard similarity, pruned by their sizes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import bounded_batches, bytes_of, chunks, id_of, keyed, mix, prefix_hash, span_hash, spans

#: The anchors, common words of four languages.
ANCHORS = (
    "a an the is was are be of to in that and it for with on as "
    "der die das ein eine ist und in den von zu mit für "
    "le la les un une est et de du des que dans pour "
    "el la los las un una es y de que en por para"
).split()
CHAIN = 2
DISTANCE = 1
#: Bytes of a signature of a text that has no words.
BARE_RUN = 4
LIKENESS = 0.8

#: Rows of one stretch of ids, about, and stretches at most.
STRETCH = 4096
STRETCHES = 10_000

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    sizes = np.array([len(w.encode()) for w in words])
    ends = np.cumsum(sizes)
    return np.unique(span_hash(prefix_hash(data, lower=True), ends - sizes, ends))


_ANCHOR_HASHES = _hash_words(sorted(set(ANCHORS)))


def signatures(data: np.ndarray, offsets: np.ndarray, chain: int = CHAIN, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit signatures of each row, sorted, and where each row's begin.

    A row with words but no chain has its words as signatures; a row without words has its runs of ``BARE_RUN`` bytes, or
    all its bytes if it has fewer; an empty row has none.
    """
    docs = len(offsets) - 1
    prefix = prefix_hash(data, lower=True)
    starts, ends, rows = spans(_WORD[data], offsets)
    words = span_hash(prefix, starts, ends)
    at = np.minimum(np.searchsorted(_ANCHOR_HASHES, words), len(_ANCHOR_HASHES) - 1)
    anchor = _ANCHOR_HASHES[at] == words
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    follow = np.searchsorted(content, spots)
    last = follow + chain * distance - 1
    whole = last < len(content)
    spots, follow, last = spots[whole], follow[whole], last[whole]
    whole = rows[content[last]] == rows[spots] if len(spots) else np.zeros(0, bool)
    spots, follow = spots[whole], follow[whole]
    with np.errstate(over="ignore"):
        out = words[spots]
        for k in range(chain):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[content[follow + (k + 1) * distance - 1]])
    of = rows[spots]
    chained = np.bincount(of, minlength=docs) > 0
    own = np.flatnonzero(~chained[rows]) if len(rows) else np.zeros(0, np.int64)
    worded = np.bincount(rows, minlength=docs) > 0
    sizes = np.diff(offsets)
    bare = np.flatnonzero(~worded & (sizes > 0))
    runs = np.maximum(1, sizes[bare] - BARE_RUN + 1)
    begins = np.repeat(offsets[bare] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
    stops = np.minimum(begins + BARE_RUN, np.repeat(offsets[bare + 1], runs))
    out = np.concatenate([out, mix(words[own]), span_hash(prefix, begins, stops)])
    of = np.concatenate([of, rows[own], np.repeat(bare, runs)])
    keys = np.unique((of.astype(np.uint64) << np.uint64(32)) | (out >> np.uint64(32)))
    of = (keys >> np.uint64(32)).astype(np.int64)
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=docs))])


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    data, offsets = bytes_of(pa.array(texts, pa.binary()))
    out: list[np.ndarray] = []
    for a, b in chunks(offsets):
        values, starts = signatures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out += [values[starts[k] : starts[k + 1]] for k in range(b - a)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _written(signature_set: np.ndarray) -> str:
    return signature_set.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spots``: the set of signatures of each text, sorted.

    A NULL or empty text has none, a NULL id is kept, repeated rows are fingerprinted each, further columns are ignored, and
    an empty table gives no rows.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "spots"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(take, "doc_id long, spots array<long>")


def search(queries: DataFrame, docs: DataFrame, threshold: float = LIKENESS) -> DataFrame:
    """Fingerprints of ``docs`` at least ``threshold`` like one of ``queries`` (both as ``fingerprints`` gives them).

    Set sizes fall into partitions that grow by ``1 / threshold``; sets in reach stand in the same or the next one.
    Within a partition two sets in reach share one of their first ``n - ceil(threshold * n) + 1`` signatures in any
    common order, here that of the hashes; only those are joined, sizes prune the pairs, and the rest is counted.
    Returns ``query_id, doc_id, likeness``, the query itself included; empty sets match nothing. Rows of one id on either
    side count as one pair, with the likeness of one of them, so ids should tell rows apart; NULL ids are kept.
    """
    step = math.log(1 / threshold) if threshold < 1 else 1e9

    def parted(df: DataFrame, name: str, reach: tuple[int, ...]) -> DataFrame:
        n = F.size("spots")
        first = n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1
        part = F.floor(F.log(n.cast("double")) / step + 1e-9)
        rows = df.filter(n > 0).select(F.col("doc_id").alias(name), F.col("spots").alias(f"{name}_spots"), F.array(*(part + r for r in reach)).alias("_parts"), F.slice("spots", 1, first).alias("_first"))
        return rows.select("*", F.explode("_parts").alias("_part")).select("*", F.explode("_first").alias("_spot")).drop("_parts", "_first")

    met = parted(queries, "query_id", (-1, 0, 1)).join(parted(docs, "doc_id", (0,)), ["_part", "_spot"])
    a, b = F.size("query_id_spots"), F.size("doc_id_spots")
    met = met.filter(F.least(a, b) >= F.greatest(a, b) * F.lit(threshold) - 1e-9).dropDuplicates(["query_id", "doc_id"])
    both = F.size(F.array_intersect("query_id_spots", "doc_id_spots"))
    return met.select("query_id", "doc_id", (both / (a + b - both)).alias("likeness")).filter(F.col("likeness") >= threshold - 1e-9)


_EDITED = "row_order long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots int"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stretch, ahead, order, text) in order to each text's comparison with its edit and the text after it."""
    waiting: tuple[int, int, str] | None = None
    for batch in batches:
        rows = []
        for stretch, ahead, order, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if waiting is not None and waiting[0] == stretch:
                rows.append((waiting[1], waiting[2], text))
                waiting = None
            if not ahead:
                waiting = (stretch, order, text)
        edits = []
        for _, text, after in rows:
            k = len(text) // 4
            edits.append((text[: len(text) - k] + after[:k]).encode())
        # A text is mostly the next of the one before, so its set is taken once.
        own = _sets([text.encode() for _, text, _ in rows])
        edited = _sets(edits)
        apart = [k for k in range(len(rows)) if k + 1 == len(rows) or rows[k][2] is not rows[k + 1][1]]
        after = dict(zip(apart, _sets([rows[k][2].encode() for k in apart]), strict=True))
        nexts = [after[k] if k in after else own[k + 1] for k in range(len(rows))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([order for order, _, _ in rows], pa.int64()),
                pa.array([len(text) for _, text, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
                pa.array([_written(s) for s in own], pa.string()),
                pa.array([_written(s) for s in edited], pa.string()),
                pa.array([likeness(s, e) for s, e in zip(own, edited, strict=True)], pa.float64()),
                pa.array([likeness(s, x) for s, x in zip(own, nexts, strict=True)], pa.float64()),
                pa.array([len(s) for s in own], pa.int32()),
            ],
            names=["row_order", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots"],
        )


def compare_with_edits(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """Fingerprint each text, its edit, and how like both and the next text's are.

    The edit replaces the last quarter of a text (code points, rounded down) by the beginning of the next text by
    ascending id, which after the last is the first. Ids are cut into stretches at their quantiles; each stretch is
    sorted in one task and also gets the first text of the stretch after it.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_spots``; a
    fingerprint is written as its sorted 32-bit signatures in hexadecimal. A NULL text counts as empty, a NULL id comes
    before all others, equal ids are ordered by a tag of the text, repeated rows follow each other, further columns
    are ignored, and an empty table gives no rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = keyed(df, id_col, text_col)
    orders = docs.select("row_order")
    parts = min(STRETCHES, max(1, orders.count() // stretch))
    cuts = np.array(sorted(set(orders.agg(F.percentile_approx("row_order", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or ())) if parts > 1 else [], np.int64)
    to_stretch = F.pandas_udf(lambda order: pd.Series(np.searchsorted(cuts, order.to_numpy(), "right").astype("int32")), "int")
    heads = docs.select(to_stretch("row_order").alias("_stretch"), "row_order", "row_tag").groupBy("_stretch").agg(F.min(F.struct("row_order", "row_tag")).alias("_head")).orderBy("_stretch").collect()  # one row to a stretch
    filled = np.array([r["_stretch"] for r in heads], np.int64)
    first = {r["_stretch"]: (r["_head"]["row_order"], r["_head"]["row_tag"]) for r in heads}
    before = {int(s): int(filled[k - 1]) for k, s in enumerate(filled)}

    def place(order: pd.Series, tag: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(cuts, order.to_numpy(), "right")
        back = [before[s] if first.get(s) == (o, t) else -1 for s, o, t in zip(at.tolist(), order.tolist(), tag.tolist(), strict=True)]
        return pd.DataFrame({"at": at.astype("int32"), "back": np.array(back, "int32")})

    placed = docs.withColumn("_p", F.pandas_udf(place, "at int, back int")("row_order", "row_tag"))
    copies = F.array(F.struct(F.col("_p.at").alias("stretch"), F.lit(0).alias("ahead")), F.struct(F.col("_p.back").alias("stretch"), F.lit(1).alias("ahead")))
    rows = placed.select(F.explode(copies).alias("_c"), "row_order", "row_tag", "text").filter("_c.stretch >= 0")
    rows = rows.select("_c.stretch", "_c.ahead", "row_order", "row_tag", "text").repartition("stretch").sortWithinPartitions("stretch", "ahead", "row_order", "row_tag")
    out = rows.select("stretch", "ahead", "row_order", "text").mapInArrow(_edit, _EDITED)
    return out.select(id_of(F.col("row_order")).alias("doc_id"), *out.columns[1:])
