"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two sets whose Jaccard similarity reaches t share at least ``ceil(t * n)`` items, n the larger size. In any common
order of all items, their first ``c`` shared items therefore stand among the first ``n - ceil(t * n) + c`` of each.
The order here is rare first: items that blocks of documents show to be frequent come last, the most frequent at the
very end. Only those prefixes are joined. Documents with equal sets are one class from the start.

What is asked for is the classes that links connect, so two classes that are already connected are not compared.
In each bucket (classes that share a prefix item) all others first meet one pivot, chosen by hash, in as many rounds as
pay. Of what is then still apart, only classes go on that may link with another group; each leans on a hub among those
around it, if near to it. Those it links with directly join it. Classes of one hub are then compared by the items that only one of them
and the hub has, rare ones first, as copies of one text that are too far apart to link have few of these in common though
they share most prefix items. Classes of different hubs meet in their buckets. No pair is verified twice. Each pair passes the length filter (sizes), the
positional filter (places of the shared item) and the suffix filter before its sets are fetched. The suffix filter
bounds what the whole sets can share: within the join by 256 bits (and 1,024 for large sets) of which each item flips
one, then by item counts in equal parts of the hash range, then by bitmaps of about two bits an item. Bits that differ
are at most as many as items that do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm.common import bounded_batches, bytes_of, chunks, hashed_words, id_of, keyed, may_be_in, mix, ngrams, signed, tag_filter
from stewardry.llm.graph import components
from stewardry.session import materialise

#: Items that come last in the order, at most; and documents of a block that must share an item for it to count.
FREQUENT_ITEMS = 100_000
BLOCK_REPEATS = 8
#: Items held for the counts of one block, about.
BLOCK_ITEMS = 4_000_000
#: Parts of the hash range that the suffix filter counts.
PARTS = 16
#: Rows of a frequent item are spread over so many keys until they are known to be shared.
SPREAD = 256

_ROWS = "item long, salt int, cls long, n int, place int, row_order long, row_tag long, parts array<int>, marks binary, flips array<long>"
_ROWS_ARROW = pa.schema(
    [("item", pa.int64()), ("salt", pa.int32()), ("cls", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("row_order", pa.int64()), ("row_tag", pa.int64()), ("parts", pa.list_(pa.int32())), ("marks", pa.binary()), ("flips", pa.list_(pa.int64()))]
)


def _least_overlap(n, num: int, den: int):
    return (n * num + den - 1) // den


def _shared_needed(n, num: int, den: int):
    """How many shared items the longer prefix must show: a quarter of what may differ, one at least."""
    return np.maximum(1, (n - _least_overlap(n, num, den) + 3) // 4)


def item_sets(data: np.ndarray, offsets: np.ndarray, n: int, frequent: np.ndarray | None = None):
    """Distinct items (hashes of ``n`` words) in rare-first order, their rows and ranks. ``offsets`` start at 0.

    ``frequent`` holds the frequent items, sorted, in its first column and their ranks from 1 in the second.
    """
    items, rows = ngrams(*hashed_words(data, offsets), n)
    rank = np.zeros(len(items), np.int64)
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent[:, 0], items), len(frequent) - 1)
        rank = np.where(frequent[at, 0] == items, frequent[at, 1], 0).astype(np.int64)
    order = np.lexsort((items, rank, rows))
    items, rows, rank = items[order], rows[order], rank[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (rows[1:] != rows[:-1])
    return items[new], rows[new], rank[new]


def bitmap(items: np.ndarray) -> bytes:
    """One bit per hashed item, in a power of two of at least two bits an item and 64 in all."""
    size = max(64, 1 << int(2 * len(items) - 1).bit_length()) if len(items) else 64
    bits = np.zeros(size, np.uint8)
    bits[(items & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the shorter one's length: at most the number of items
    that only one of the sets has."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


#: Sets of more items carry 1,024 sketch bits besides their 256: few bits can't tell large sets apart.
LARGE_SET = 1000


def _flips(items: np.ndarray, rows: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Each set's sketch: 4 words of 256 bits of which each item flips one, and 16 words of 1,024 bits if it is large."""

    def words(of: np.ndarray, count: int, bits: int) -> np.ndarray:
        number = np.cumsum(of) - 1
        use = of[rows]
        at = number[rows[use]] * bits + ((items[use] >> np.uint64(48)) & np.uint64(bits - 1)).astype(np.int64)
        odd = (np.bincount(at, minlength=count * bits).reshape(count, bits) & 1).astype(np.uint8)
        return np.packbits(odd, axis=1, bitorder="little").view("<i8")

    large = n > LARGE_SET
    small, wide = words(np.ones(len(n), bool), len(n), 256), words(large, int(large.sum()), 1024)
    ends = np.concatenate([[0], np.cumsum(np.where(large, 20, 4))]).astype(np.int32)
    out = np.zeros(ends[-1], np.int64)
    out[ends[:-1, None] + np.arange(4)] = small
    out[ends[:-1][large][:, None] + 4 + np.arange(16)] = wide
    return pa.ListArray.from_arrays(ends, pa.array(out))


def _count_frequent(ngram: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                items, times = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                many = times >= BLOCK_REPEATS
                yield pa.RecordBatch.from_arrays([pa.array(signed(items[many])), pa.array(times[many])], names=["item", "times"])

        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            for a, b in chunks(offsets):
                held.append(item_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ngram)[0])
            if sum(map(len, held)) >= BLOCK_ITEMS:
                yield from flush()
        yield from flush()

    return count


def frequent_items(docs: DataFrame, ngram: int, most: int = FREQUENT_ITEMS) -> np.ndarray:
    """The ``most`` most frequent items and their ranks. They shape the order only, so no link depends on them."""
    counts = docs.select("text").mapInArrow(_count_frequent(ngram), "item long, times long")
    top = counts.groupBy("item").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "item").limit(most).toArrow()
    items = top.column("item").to_numpy().view(np.uint64)
    table = np.stack([items, np.arange(len(items), 0, -1).astype(np.uint64)], axis=1)  # the most frequent ranks last
    return table[np.argsort(table[:, 0])]


def _prefixes(ngram: int, num: int, den: int, frequent):
    """Rows (order, tag, text) to one row per document and one per prefix item of each class of a batch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            orders, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = bytes_of(batch.column(2))
            for a, b in chunks(offsets):
                items, rows, rank = item_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ngram, frequent.value)
                docs = b - a
                n = np.bincount(rows, minlength=docs)
                starts = np.concatenate([[0], np.cumsum(n)])
                with np.errstate(over="ignore"):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
                    cls = signed(mix(sums[starts[1:]] - sums[starts[:-1]] + n.astype(np.uint64)))
                parts = np.bincount(rows * PARTS + (items >> np.uint64(60)).astype(np.int64), minlength=docs * PARTS)
                lists = pa.ListArray.from_arrays(np.arange(0, docs * PARTS + 1, PARTS, dtype=np.int32), pa.array(parts, pa.int32()))
                flips = _flips(items, rows, n)
                marks = [bitmap(items[starts[k] : starts[k + 1]]) for k in range(docs)]
                spread = signed(mix(mix(orders[a:b].astype(np.uint64)) ^ tags[a:b].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip((spread, np.zeros(docs, np.int32), cls, n, np.full(docs, -1), orders[a:b], tags[a:b]), _ROWS_ARROW, strict=False)] + [lists, pa.array(marks, pa.binary()), flips],
                    schema=_ROWS_ARROW,
                )
                fresh = np.zeros(docs, bool)
                for k in np.flatnonzero(n):
                    if (c := int(cls[k])) not in seen:
                        seen.add(c)
                        fresh[k] = True
                if len(seen) > 200_000:
                    seen.clear()
                place = np.arange(len(items)) - starts[rows]
                length = n - _least_overlap(n, num, den) + _shared_needed(n, num, den)
                use = np.flatnonzero(fresh[rows] & (place < length[rows]))
                row = rows[use]
                salt = np.where(rank[use] > 0, 1 + (cls[row].astype(np.uint64) % np.uint64(SPREAD)).astype(np.int64), 0)
                empty = pa.nulls(len(use), pa.list_(pa.int32()))
                zero = np.zeros(len(use), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip((signed(items[use]), salt, cls[row], n[row], place[use], zero, zero), _ROWS_ARROW, strict=False)] + [empty, pa.nulls(len(use), pa.binary()), pa.nulls(len(use), pa.list_(pa.int64()))],
                    schema=_ROWS_ARROW,
                )

    return emit


def _shared_rows(rows: DataFrame) -> DataFrame:
    """Documents' rows, and one row per class of prefix items that two classes have (as frequent items surely do)."""
    key = Window.partitionBy("item", "salt")
    return (
        rows.withColumn("_before", F.lag("cls").over(key.orderBy("cls")))
        .withColumn("_low", F.min("cls").over(key))
        .withColumn("_high", F.max("cls").over(key))
        .filter("place < 0 OR ((_before IS NULL OR _before != cls) AND (salt > 0 OR _low != _high))")
        .drop("_before", "_low", "_high", "salt")
    )


def _second(name: str) -> Column:
    return F.col(f"{name}2")


def _may_link(num: int, den: int, one: Callable[[str], Column] = F.col, two: Callable[[str], Column] = _second) -> Column:
    """Length, positional and first suffix filter for two classes that meet at one item (columns n, place and flips of
    each, n2, place2 and flips2 being those of the second)."""
    n, n2, place, place2 = one("n"), two("n"), one("place"), two("place")
    most = F.least(place, place2) + F.least(n - place, n2 - place2)
    least = F.least(n, n2)
    # 'most' counts the shared item too; J >= num/den means den * overlap >= num * (n + n2 - overlap).
    def differ(words: range) -> Column:
        return sum((F.bit_count(F.get(one("flips"), F.lit(k)).bitwiseXOR(F.get(two("flips"), F.lit(k)))) for k in words), F.lit(0))

    total = n + n2
    in_reach = lambda bits: (den + num) * bits <= (den - num) * total
    # Where one of the sets has no wide sketch, its words are NULL and nothing is told.
    wide = F.coalesce(in_reach(differ(range(4, 20))), F.lit(True))
    return (den * least >= num * F.greatest(n, n2)) & ((den + num) * most >= num * total) & in_reach(differ(range(4))) & wide


def _needed(n: Column, num: int, den: int) -> Column:
    overlap = F.floor((n * num + (den - 1)) / den)
    return F.greatest(F.lit(1), F.floor((n - overlap + 3) / 4)).cast("int")


def _sets(ngram: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            for a, b in chunks(offsets):
                items, rows, _ = item_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ngram)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(signed(items)))], names=["cls", "items"])

    return sets


def _bits_allow(num: int, den: int):
    """Pairs whose bitmaps leave the similarity possible: at most ``n + n2 - 2 * overlap`` items may differ."""

    def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, n2 = (batch.column(k).to_numpy() for k in range(4))
            differ = np.array([differing_bits(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            total = n.astype(np.int64) + n2
            ok = pa.array((den + num) * (total - differ) >= 2 * num * total)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in range(4)], names=["a", "b", "n", "n2"])

    return allow


def _filtered(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, n, n2) that the suffix filter leaves, in a written table."""
    narrow = classes.select("cls", "n", "parts")
    pairs = pairs.join(narrow.toDF("a", "n", "parts"), "a").join(narrow.toDF("b", "n2", "parts2"), "b")
    most = F.aggregate(F.zip_with("parts", "parts2", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    pairs = pairs.filter((den + num) * most >= num * (F.col("n") + F.col("n2"))).select("a", "b", "n", "n2")
    marks = classes.select("cls", "marks")
    met = pairs.join(marks.toDF("a", "marks"), "a").join(marks.toDF("b", "marks2"), "b").select("a", "b", "n", "n2", "marks", "marks2")
    return materialise(met.mapInArrow(_bits_allow(num, den), "a long, b long, n int, n2 int"), "pairs")


def _verified(met: DataFrame, classes: DataFrame, docs: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes that reach the similarity, by their sets."""
    sets = _sets_of(met.select(F.col("a").alias("cls")).union(met.select("b")).distinct(), classes, docs, ngram)
    met = met.join(sets.toDF("a", "items"), "a").join(sets.toDF("b", "items2"), "b")
    overlap = F.size(F.array_intersect("items", "items2"))
    return met.filter((den + num) * overlap >= num * (F.col("n") + F.col("n2"))).select("a", "b").distinct()


def _sets_of(needed: DataFrame, classes: DataFrame, docs: DataFrame, ngram: int) -> DataFrame:
    """``cls, items`` of the classes in ``needed``, in a written table."""
    chosen = materialise(needed.join(classes.select("cls", "row_order", "row_tag"), "cls"), "chosen")
    row = F.xxhash64("row_order", "row_tag").alias("_row")
    texts = may_be_in(docs.withColumn("_row", row), tag_filter(chosen.select(row), "_row"), "_row")
    texts = texts.join(chosen, ["row_order", "row_tag"]).select("cls", "text")
    return materialise(texts.mapInArrow(_sets(ngram), "cls long, items array<long>"), "sets")


def _open_buckets(rows: DataFrame, apart: bool) -> DataFrame:
    """``item, _pairs``: items that more than one group has, and how many pairs of classes of different groups meet there.

    ``apart`` says that each class is a group of its own.
    """
    if apart:
        counted = rows.groupBy("item").agg(F.count("*").alias("_m"), F.count("*").alias("_mm"))
    else:
        own = rows.groupBy("item", "group").agg(F.count("*").alias("_g"))
        counted = own.groupBy("item").agg(F.sum("_g").alias("_m"), F.sum(F.col("_g") * F.col("_g")).alias("_mm"))
    return counted.select("item", ((F.col("_m") * F.col("_m") - F.col("_mm")) / 2).alias("_pairs")).filter("_pairs > 0")


#: Pivots that a class tries in a round.
PIVOT_TRIES = 3
_PIVOT = ("cls", "n", "place", "flips", "group")


def _bucket_pivots(rows: DataFrame, turn: int) -> DataFrame:
    """One class per item, another one each ``turn``. They are found ahead of the shuffle, so no bucket has to fit a task."""
    pivot = F.struct(F.xxhash64(F.lit(turn), "cls").alias("_turn"), *_PIVOT)
    best = rows.groupBy("item").agg(F.min(pivot).alias("_p"))
    return best.select("item", *(F.col(f"_p.{c}").alias(f"{c}2") for c in _PIVOT))


def _grouped(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` of classes with the ``group`` that the links found so far give each."""
    rows = rows.drop("group").join(named.toDF("cls", "component"), "cls", "left")
    return rows.withColumn("group", F.coalesce("component", "cls")).drop("component")


def _linked_classes(shared: DataFrame, classes: DataFrame, docs: DataFrame, ngram: int, num: int, den: int) -> DataFrame | None:
    """``node, component`` of linked classes; None if no two are linked.

    Rounds with pivots go on until the pairs left are a quarter of the rows, or a round leaves most of them.
    """
    links: DataFrame | None = None
    named: DataFrame | None = None
    tried: DataFrame | None = None
    members, left, turn = int(shared.count()), 0, 0
    while members:
        rows = shared.withColumn("group", F.col("cls"))
        if named is not None:
            rows = materialise(_grouped(shared, named), "rows")
        buckets = materialise(_open_buckets(rows, named is None), "buckets")
        before, left = left, buckets.agg(F.sum("_pairs")).first()[0] or 0
        if not left:
            break
        if turn and (4 * left <= members or 4 * left > 3 * before):
            rows = materialise(rows.join(buckets.select("item"), "item", "left_semi"), "rows")
            near = _clustered(_partnered(rows, num, den))
            apart = _differences(near, _sets_of(near.select("cls").distinct(), classes, docs, ngram), num, den)
            near = near.drop("hub").join(apart.select("cls", "hub"), "cls", "left").withColumn("hub", F.coalesce("hub", "cls"))
            found = materialise(_hub_links(apart, num, den), "linked")
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                named = components(links)
                near, apart = _grouped(near, named), materialise(_grouped(apart, named), "grouped")
            pairs = _meeting_pairs(materialise(near, "near"), num, den).unionByName(_differing_pairs(apart, num, den)).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            return _connected(_filtered(pairs, classes, num, den), links, named, classes, docs, ngram, num, den)
        met = rows.join(_bucket_pivots(rows, turn), "item").filter((F.col("group") != F.col("group2")) & _may_link(num, den))
        met = met.groupBy("cls", "cls2").agg(F.count("*").alias("_met"))
        met = met.withColumns({"a": F.least("cls", "cls2"), "b": F.greatest("cls", "cls2")})
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        # Each tries the pivots that it meets most often; it has no more of them than prefix items.
        best = met.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(F.struct("_met", "a", "b")), False), 1, PIVOT_TRIES).alias("_best"))
        pairs = materialise(best.select(F.explode("_best").alias("_best")).select("_best.a", "_best.b").distinct(), "tries")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = materialise(_verified(_filtered(pairs, classes, num, den), classes, docs, ngram, num, den), "linked")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            named = components(links)
        turn += 1
    return named


def _partnered(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The rows that meet, at their item, a class of another group with which theirs may link; in a written table."""
    # Both sides are the same table read the same way, so it is shuffled once.
    one, two = rows.alias("one"), rows.alias("two")
    meet = (F.col("one.item") == F.col("two.item")) & (F.col("one.group") != F.col("two.group"))
    link = _may_link(num, den, lambda c: F.col(f"one.{c}"), lambda c: F.col(f"two.{c}"))
    return materialise(one.join(two, meet & link, "left_semi"), "partnered")


def _clustered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``hub``, a class near the middle of those around it, in a written table.

    A class that shares its prefix items with most others stands nearest the middle. In each bucket it is the one that
    the others lean on; each class leans on the one it meets most often, and what hangs together has one hub. Any choice
    of hubs leaves the links what they are.
    """
    sizes = rows.groupBy("item").agg(F.count("*").alias("_m"))
    scores = materialise(rows.join(sizes, "item").groupBy("cls").agg(F.sum("_m").alias("_score")), "scores")
    best = rows.join(scores, "cls").groupBy("item").agg(F.max(F.struct("_score", "cls")).alias("_hub"))
    leans = rows.join(best, "item").select("cls", "_hub").filter("cls != _hub.cls").groupBy("cls", "_hub").agg(F.count("*").alias("_met"))
    leans = leans.groupBy("cls").agg(F.max(F.struct("_met", "_hub._score", "_hub.cls")).alias("_best"))
    cluster = components(leans.select(F.col("cls").alias("a"), F.col("_best.cls").alias("b"))).withColumnRenamed("node", "cls")
    hubs = cluster.join(scores, "cls").groupBy("component").agg(F.max_by("cls", F.struct("_score", "cls")).alias("hub"))
    hubs = materialise(cluster.join(materialise(hubs, "hubs"), "component").select("cls", "hub"), "hubs")
    return materialise(rows.join(hubs, "cls", "left").withColumn("hub", F.coalesce("hub", "cls")), "clustered")


def _meeting_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes of different groups and hubs that share as many prefix items as a link needs."""
    # Both sides are the same table read the same way, so it is shuffled once.
    one, two = rows.alias("one"), rows.alias("two")
    met = one.join(two, F.col("one.item") == F.col("two.item"))
    met = met.select(*(F.col(f"one.{c}") for c in (*_PIVOT, "hub")), *(F.col(f"two.{c}").alias(f"{c}2") for c in (*_PIVOT, "hub")))
    met = met.filter((F.col("cls") < F.col("cls2")) & (F.col("group") != F.col("group2")) & (F.col("hub") != F.col("hub2")) & _may_link(num, den))
    pairs = met.groupBy(F.col("cls").alias("a"), F.col("cls2").alias("b")).agg(F.count("*").alias("_met"), F.min(F.least("n", "n2")).alias("_n"))
    return pairs.filter(F.col("_met") >= _needed(F.col("_n"), num, den)).select("a", "b")


#: Times what a link allows that a class may differ from its hub; one that differs more has no hub but itself.
FAR = 4


def _differences(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """One row per class near its hub: ``differ``, the items that only one of the two sets has, and their number ``d``."""
    members = rows.select("cls", "n", "group", "hub").distinct()
    sets = sets.dropDuplicates(["cls"])  # repeated rows give their class's set again
    heads = members.filter("cls = hub").select("hub", F.col("n").alias("hub_n")).join(sets.toDF("hub", "hub_items"), "hub")
    apart = members.filter("cls != hub").join(sets, "cls").join(materialise(heads, "hubs"), "hub")
    apart = apart.withColumn("differ", F.concat(F.array_except("items", "hub_items"), F.array_except("hub_items", "items")))
    apart = apart.withColumn("d", F.size("differ").cast("long")).drop("items", "hub_items")
    return materialise(apart.filter((den + num) * F.col("d") <= FAR * (den - num) * (F.col("n") + F.col("hub_n"))), "differ")


def _hub_links(apart: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a class and its hub that reach the similarity."""
    linked = apart.filter((den + num) * F.col("d") <= (den - num) * (F.col("n") + F.col("hub_n")))
    return linked.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"))


def _differing_pairs(apart: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes of one hub and different groups that may link, by what tells them from their hub.

    Copies of one text share most items, but not those that set each apart from it. Two sets of one hub differ in d + d2
    less twice what their ``differ`` share, and a link allows r = (den - num) / (den + num) of their sizes' sum. If d + d2 is
    no more than that, both link with the hub and are of one group. Otherwise their ``differ`` share an item, and the first
    one they share, rare ones first, has at least the needed rest behind it in both. As d and d2 are no further apart than
    r allows, it is among the first n * (den - num) / num + 1 of each.
    """
    split = apart.groupBy("hub").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).filter("_low != _high")
    apart = apart.join(materialise(split.select("hub"), "split"), "hub", "left_semi")
    items = apart.select("hub", "cls", "n", "group", "d", F.explode("differ").alias("item"))
    often = items.groupBy("hub", "item").agg(F.count("*").alias("_often")).filter("_often > 1")
    rare = F.row_number().over(Window.partitionBy("cls").orderBy(F.coalesce("_often", F.lit(1)), "item")) - 1
    items = items.join(often, ["hub", "item"], "left").withColumn("place", rare)
    items = materialise(items.filter(f"_often > 1 AND place * {num} <= n * {den - num}").drop("_often"), "differing")
    one, two = items.alias("one"), items.alias("two")
    met = one.join(two, (F.col("one.hub") == F.col("two.hub")) & (F.col("one.item") == F.col("two.item")))
    columns = ("cls", "n", "group", "d", "place")
    met = met.select(*(F.col(f"one.{c}") for c in columns), *(F.col(f"two.{c}").alias(f"{c}2") for c in columns))
    shared = F.least(F.col("d") - F.col("place"), F.col("d2") - F.col("place2"))
    allowed = (den + num) * (F.col("d") + F.col("d2") - 2 * shared) <= (den - num) * (F.col("n") + F.col("n2"))
    sizes = den * F.least("n", "n2") >= num * F.greatest("n", "n2")
    met = met.filter((F.col("cls") < F.col("cls2")) & (F.col("group") != F.col("group2")) & sizes & allowed)
    return met.select(F.col("cls").alias("a"), F.col("cls2").alias("b")).distinct()


#: Pairs a class that a verifying round takes at first; each round takes twice as many.
TRIES = 4


def _connected(pairs: DataFrame, links: DataFrame | None, named: DataFrame | None, classes: DataFrame, docs: DataFrame, ngram: int, num: int, den: int) -> DataFrame | None:
    """``node, component`` after all ``pairs`` that still matter are verified.

    A round takes pairs by their hash, about ``TRIES`` a class; those connect most of a dense group, and pairs within what
    is connected need no more verifying. Each round takes twice as many, so few rounds take all.
    """
    tries = TRIES
    while True:
        total = pairs.count()
        if not total:
            return named
        nodes = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().count()
        share = min(1.0, tries * nodes / total)
        taken = F.pmod(F.xxhash64(F.lit(tries), "a", "b"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
        found = materialise(_verified(pairs.filter(taken), classes, docs, ngram, num, den), "linked")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            named = components(links)
        if share == 1.0:
            return named
        pairs = pairs.filter(~taken)
        if named is not None:
            left, right = named.toDF("a", "_a"), named.toDF("b", "_b")
            pairs = pairs.join(left, "a", "left").join(right, "b", "left").filter("NOT (_a <=> _b) OR _a IS NULL").select(*pairs.columns)
        pairs, tries = materialise(pairs, "pairs"), tries * 2


def near_duplicates(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = 5,
    similarity: tuple[int, int] = (80, 100),
    frequent: int = FREQUENT_ITEMS,
) -> DataFrame:
    """Connect documents whose sets of word n-grams have a Jaccard similarity of at least ``similarity`` (a ratio).

    Words are what white space separates, with A-Z lowered; a document of fewer words has its whole sequence as
    its one item, and one without words or text has an empty set, is linked with nothing and names itself. Returns
    per row ``doc_id, row_tag, n_shingles, component_id, component_tag`` (the smallest id that links reach, and of the
    texts under it the smallest tag). A NULL id comes before all others, repeated rows are linked like any equal ones, further columns are ignored, and an empty table
    gives no rows.
    """
    num, den = similarity
    if not 0 < num <= den or ngram < 1:
        raise ValueError("similarity must be in (0, 1] and ngram positive")
    spark = df.sparkSession
    bounded_batches(spark)
    docs = keyed(df, id_col, text_col)
    ranks = spark.sparkContext.broadcast(frequent_items(docs, ngram, frequent))  # ``frequent`` items at most
    rows = materialise(_shared_rows(docs.mapInArrow(_prefixes(ngram, num, den, ranks), _ROWS)), "prefixes")
    documents = rows.filter("place < 0").select("row_order", "row_tag", "cls", "n")
    shared = rows.filter("place >= 0").select("item", "cls", "n", "place")

    enough = shared.groupBy("cls").agg(F.count("*").alias("_met"), F.first("n").alias("_n")).filter(F.col("_met") >= _needed(F.col("_n"), num, den)).select("cls")
    enough = materialise(enough, "candidates")
    one = F.min(F.struct("row_order", "row_tag", "n", "parts", "marks", "flips")).alias("_r")
    bits = tag_filter(enough, "cls")
    classes = may_be_in(rows.filter("place < 0 AND n > 0"), bits, "cls").join(enough, "cls").groupBy("cls").agg(one)
    classes = materialise(classes.select("cls", "_r.*"), "classes")
    named = _linked_classes(materialise(shared.join(classes.select("cls", "flips"), "cls"), "shared"), classes, docs, ngram, num, den)

    # Every class's name is worked out on classes and written, so the join of the documents is with a plain table, and
    # Spark splits a class that very many of them share.
    least = documents.filter("n > 0").groupBy("cls").agg(F.min(F.struct("row_order", "row_tag")).alias("least"))
    if named is not None:
        own = materialise(least.join(named.toDF("cls", "component"), "cls", "left"), "names")
        whole = own.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("first"))
        least = own.join(whole, "component", "left").select("cls", F.coalesce("first", "least").alias("least"))
    least = materialise(least.select(F.col("cls").alias("group"), "least"), "names")
    out = documents.withColumn("group", F.when(F.col("n") > 0, F.col("cls"))).join(least, "group", "left")
    return out.select(
        id_of(F.col("row_order")).alias("doc_id"),
        "row_tag",
        F.col("n").cast("long").alias("n_shingles"),
        id_of(F.coalesce("least.row_order", "row_order")).alias("component_id"),
        F.coalesce("least.row_tag", "row_tag").alias("component_tag"),
    )
