"""A Merkle manifest of a table by time-forward processing: one tree per group, and a tree over their roots.

A node's label is (level, place). Digests are messages to the parent's label and proof suffixes messages to a child's;
an external priority queue delivers them in label order. Here Spark's sorting shuffle is that queue between blocks of
``fanout ** LEVELS`` nodes of one tree, and a heap is it inside a block. One round lifts all trees by ``LEVELS`` levels,
so a tree of n rows takes log(n) / log(fanout ** LEVELS) rounds; the reversed sweep goes the same rounds downwards. No task
holds more than a block, and only the root digest and the size of the largest tree reach the driver.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import placed
from stewardry.session import materialise

FANOUT = 8
#: Levels that one round lifts: blocks of 8 ** 3 = 512 nodes.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Label = tuple[int, int]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_text(values: list[Column]) -> Column:
    """The values one after the other: '-' for NULL, else the number of UTF-8 bytes, ':' and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def height(nodes: int, fanout: int) -> int:
    """Levels above ``nodes`` nodes until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def sweep_up(digests: list[str], levels: int, fanout: int) -> dict[Label, str]:
    """Digests of a block's nodes by label. Messages leave the queue by label of the receiver, then by sender."""
    known: dict[Label, str] = {}
    queue: list[tuple[Label, int, str]] = [((0, place), 0, d) for place, d in enumerate(digests)]
    heapq.heapify(queue)
    while queue:
        label, _, first = heapq.heappop(queue)
        parts = [first]
        while queue and queue[0][0] == label:
            parts.append(heapq.heappop(queue)[2])
        level, place = label
        known[label] = digest("".join(parts)) if level else first
        if level < levels:
            heapq.heappush(queue, ((level + 1, place // fanout), place, known[label]))
    return known


def sweep_down(known: dict[Label, str], levels: int, fanout: int, suffix: str) -> Iterator[tuple[int, str]]:
    """From the block's root down: each node hands its children the digests beside them and its own suffix.

    A suffix is ``left,right;`` a level: the joined digests of the siblings before and after the node on the path.
    Yields the suffix of every node of the lowest level.
    """
    queue: list[tuple[int, int, str]] = [(-levels, 0, suffix)]
    while queue:
        level, place, suffix = heapq.heappop(queue)
        if not level:
            yield place, suffix
            continue
        below = -level - 1
        children = [known[below, p] for p in range(place * fanout, (place + 1) * fanout) if (below, p) in known]
        for k in range(len(children)):
            heapq.heappush(queue, (-below, place * fanout + k, f"{''.join(children[:k])},{''.join(children[k + 1 :])};{suffix}"))


def fold(start: str, suffix: str) -> str:
    """The root that a digest and the siblings on its path give."""
    for step in suffix.split(";")[:-1]:
        left, _, right = step.partition(",")
        start = digest(left + start + right)
    return start


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of one block at a time; rows of a block follow each other and agree in the first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _delivered(df: DataFrame, order: list[str], work: Callable[[list[tuple]], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Deal rows by (tree, block), sort each task's rows in label order, and run ``work`` on one block after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ([] for _ in schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for block in _blocks(batches, 2):
            out.extend(work(block))
            if len(out) >= 4096:
                yield batch()
                out = []
        yield batch()

    return df.repartition("tree", "block").sortWithinPartitions("tree", "block", *order).mapInArrow(run, ddl)


_NODES = pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("digest", pa.string()), ("nodes", pa.int64())])


def _climb(nodes: DataFrame, largest: int, fanout: int) -> list[DataFrame]:
    """``tree, at, digest, nodes`` (nodes of the tree at this level) of each round, the given one first, roots last."""
    span = fanout**LEVELS

    def lift(block: list[tuple]) -> Iterator[tuple]:
        tree, number, _, _, size = block[0]
        levels = min(LEVELS, height(size, fanout))
        known = sweep_up([row[3] for row in block], levels, fanout)
        yield tree, number, known[levels, 0], -(-size // fanout**levels)

    rounds = [nodes]
    while largest > 1:
        blocks = rounds[-1].select("tree", F.expr(f"at div {span}").alias("block"), "at", "digest", "nodes")
        rounds.append(materialise(_delivered(blocks, ["at"], lift, _NODES, "tree long, at long, digest string, nodes long"), "nodes"))
        largest = -(-largest // span)
    return rounds


_SUFFIXES = pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("digest", pa.string()), ("suffix", pa.string()), ("tree_root", pa.string())])
_MESSAGES = ["tree", "block", "at", "digest", "nodes", "suffix", "tree_root"]


def _with_suffixes(nodes: DataFrame, suffixes: DataFrame, span: int) -> DataFrame:
    """Nodes of a round and, ahead of each block, the suffix of its root as a row of place -1."""
    below = nodes.withColumns({"block": F.expr(f"at div {span}"), "suffix": F.lit(None).cast("string"), "tree_root": F.lit(None).cast("string")})
    above = suffixes.select(
        "tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast("long").alias("nodes"), "suffix", "tree_root",
    )
    return below.unionByName(above, allowMissingColumns=True)


def _suffixes_of(block: list[tuple], fanout: int) -> Iterator[tuple[tuple, str, str]]:
    """The rows of a block's lowest level, each with its suffix and the root of its tree."""
    head, rows = block[0], block[1:]
    levels = min(LEVELS, height(rows[0][4], fanout))
    known = sweep_up([row[3] for row in rows], levels, fanout)
    for place, suffix in sweep_down(known, levels, fanout, head[5]):
        yield rows[place], suffix, head[6]


def _descend(rounds: list[DataFrame], suffixes: DataFrame, fanout: int, down_to: int) -> DataFrame:
    """Suffixes of the nodes of round ``down_to``, from those of the roots."""

    def hand_down(block: list[tuple]) -> Iterator[tuple]:
        for row, suffix, root in _suffixes_of(block, fanout):
            yield row[0], row[2], row[3], suffix, root

    ddl = "tree long, at long, digest string, suffix string, tree_root string"
    for nodes in reversed(rounds[down_to:-1]):
        rows = _with_suffixes(nodes, suffixes, fanout**LEVELS).select(*_MESSAGES)
        suffixes = materialise(_delivered(rows, ["at"], hand_down, _SUFFIXES, ddl), "suffixes")
    return suffixes


_PROVED = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())]
)


def manifest(
    df: DataFrame,
    *,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    tree_col: str = "lang",
    text_col: str = "text",
    tampered: Column | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """A leaf per row, a tree per value of ``tree_col``, a tree over their roots, and a checked proof per row.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``. Where ``tampered`` holds, the proof is folded from the leaf of the same row with A-Z of its text lowered;
    such a row is verified only if its text has none.

    Leaves of a tree ascend by id; NULL ids come first, rows of one id follow by leaf, so the digests don't depend on
    the order of the input. Trees are ordered by name, NULL first. Repeated rows are leaves each, NULL and empty texts
    differ, texts of any length are hashed whole in the JVM, further columns are ignored; an empty table gives no rows.
    """
    values = [F.col(c) for c in fields]
    leaf = F.sha2(leaf_text(values), 256)
    changed = F.sha2(leaf_text([lower_ascii(v) if c == text_col else v for c, v in zip(fields, values, strict=True)]), 256)
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(tree_col).cast("string").alias("name"),
        leaf.alias("digest"),
        F.when(tampered, changed).alias("shown"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.asc_nulls_first("name"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("tie")]
    leaves = materialise(placed(materialise(leaves, "leaves"), order), "leaves")
    names = leaves.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("nodes"))
    names = placed(materialise(names, "trees"), [F.asc_nulls_first("name")])
    trees = materialise(names.select(F.col("name").alias("_name"), "first", "nodes", F.col("place").alias("tree")), "trees")
    size = trees.agg(F.max("nodes").alias("largest"), F.count("*").alias("trees")).first()

    own = leaves.join(trees, F.col("name").eqNullSafe(F.col("_name")))
    own = own.select("tree", (F.col("place") - F.col("first")).alias("at"), "digest", "nodes", "doc_id", "shown")
    own = materialise(own, "leaves")
    rounds = _climb(own.select("tree", "at", "digest", "nodes"), size["largest"] or 0, fanout)
    tops = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(size["trees"]).cast("long").alias("nodes"))
    upper = _climb(tops, size["trees"], fanout)

    nothing = F.lit("")
    root = upper[-1].select("tree", "at", "digest", nothing.alias("suffix"), F.col("digest").alias("tree_root"))
    over = _descend(upper, root, fanout, 0)
    # What the upper tree handed to a subroot is what the subroot hands on in its own tree.
    handed = over.select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("digest"), "suffix", F.concat_ws(";", "digest", "tree_root").alias("tree_root"))
    above = _descend(rounds, handed, fanout, 1) if len(rounds) > 1 else handed

    def prove(block: list[tuple]) -> Iterator[tuple]:
        for row, suffix, roots in _suffixes_of(block, fanout):
            subroot, root = roots.split(";")
            folded = fold(row[8] or row[3], suffix)
            siblings = suffix.replace(",", "").replace(";", "")
            yield row[7], row[3], subroot, root, digest(siblings), folded, folded == root

    messages = _with_suffixes(own, above, fanout**LEVELS).select(*_MESSAGES, "doc_id", "shown")
    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _delivered(messages, ["at"], prove, _PROVED, ddl)
