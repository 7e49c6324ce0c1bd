"""Importance resampling, the Merkle manifest and packing along the curve, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stewardry.llm import curve_packing, importance, merkle, queries
from tests.compare import compare, connect
from tests.llm import brute

SF = "/root/testdata/sf0.001"
WORD_TOKENS = queries.tokenizer_path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture
def tasks_kept_apart(spark):
    """Small partitions are not joined, as large ones would not be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("name", queries.CHECKS)
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.CHECKS[name], SF) is None


def plain_draw(rows, target, ngram, buckets, share, least):
    """Rows are (id, text) in input order."""

    def features(text):
        words = WORDS.findall((text or "").translate(brute.LOWER))
        runs = [" ".join(words[k : k + n]) for n in range(1, ngram + 1) for k in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    have, want = Counter(), Counter()
    for _, text in rows:
        have += features(text)[1]
    for text in target:
        want += features(text)[1]
    up, down = have.total() + buckets, want.total() + buckets
    out, order = [], []
    for k, (i, text) in enumerate(rows):
        words, found = features(text)
        weight = sum(n * math.floor(1000 * math.log((want[b] + 1) * up / ((have[b] + 1) * down))) for b, n in found.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, found.total(), weight, score, None])
        if words >= least:
            order.append((-score, i is not None, i or 0, k))
    for rank, (*_, k) in enumerate(sorted(order)[: len(order) * share[0] // share[1]], 1):
        out[k][4] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize("ngram, buckets", [(1, 10_000), (3, 64)])
def test_draw_of_odd_rows(spark, odd, nothing, ngram, buckets):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = [None, "", "bca dd fe bca dd fe", rows[0][1], "É é ß 12"]
    wanted = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = importance.resample(odd, wanted, ngram=ngram, buckets=buckets, share=(40, 100))
    want = plain_draw(rows, target, ngram, buckets, (40, 100), importance.LEAST_WORDS)
    assert Counter(map(tuple, got.collect())) == want
    assert importance.resample(nothing, wanted).count() == 0
    assert importance.resample(odd, wanted.limit(0)).count() == len(rows)


def test_draw_prefers_the_target(spark):
    words = {"a": "apple pear plum fig date".split(), "b": "iron zinc lead gold tin".split()}
    rng = np.random.default_rng(3)
    rows = [(k, kind, " ".join(rng.choice(words[kind], 30))) for k, kind in enumerate("ab" * 200)]
    drawn = importance.resample(
        spark.createDataFrame(rows, "doc_id long, kind string, text string"), spark.createDataFrame([("fig date plum " * 20,)], "text string")
    ).filter("rank is not null")
    assert sorted(r["rank"] for r in drawn.collect()) == list(range(1, 41))
    assert {rows[r["doc_id"]][1] for r in drawn.collect()} == {"a"}


def test_ties_are_ranked_over_many_tasks(spark, tasks_kept_apart):
    """One id and text in every row: all scores are equal, and no task may get all rows."""
    same = spark.range(0, 4000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit("w " * 25).alias("text"))
    got = importance.resample(same, same.limit(1), share=(50, 100))
    assert [r["rank"] for r in got.filter("rank is not null").orderBy("rank").collect()] == list(range(1, 2001))
    tasks = got.filter("score is not null").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert max(t["count"] for t in tasks) < 1500


def plain_manifest(rows, fanout=8):
    """Rows are dicts; the tampered ones are those whose id's CRC-32 is divisible by 3."""

    def h(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(r, lowered=False):
        text = r["text"] if not lowered or r["text"] is None else r["text"].translate(brute.LOWER)
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(nodes):
        """The root, and per node the steps (left, right) to it."""
        steps, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(where):
                low = at // fanout * fanout
                steps[k].append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + fanout])))
            nodes = [h("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
            where = [at // fanout for at in where]
        return nodes[0], steps

    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        low[name] = climb([x[2] for x in trees[name]])
    root, high = climb([low[name][0] for name in names])
    out = Counter()
    for name, above in zip(names, high, strict=True):
        subroot, steps = low[name]
        for (known, i, own, r), path in zip(trees[name], steps, strict=True):
            folded = leaf(r, lowered=True) if known and zlib.crc32(str(i).encode()) % 3 == 0 else own
            for left, right in path + above:
                folded = h(left + folded + right)
            proof = h("".join(left + right for left, right in path + above))
            out[r["doc_id"], own, subroot, root, proof, folded, folded == root] += 1
    return out


def third():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def test_manifest_of_odd_rows(odd, nothing):
    rows = [r.asDict() for r in odd.collect()]
    got = merkle.manifest(odd, tampered=third())
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)
    assert merkle.manifest(nothing).count() == 0


@pytest.mark.parametrize("count, names", [(1, 1), (2, 1), (9, 1), (513, 1), (1100, 1), (40, 40), (1300, 600)])
def test_manifest_of_any_size(spark, count, names):
    """Sizes around one block, many trees of one leaf, and more trees than a block holds."""
    df = spark.range(count).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("T"), F.col("id") % 5).alias("text"),
        F.concat(F.lit("l"), F.col("id") % names).alias("lang"),
        F.lit("s").alias("source"),
        F.lit(2).cast("long").alias("n_chars"),
    )
    got = Counter(map(tuple, merkle.manifest(df, tampered=third()).collect()))
    assert got == plain_manifest([r.asDict() for r in df.collect()])


def test_equal_rows_are_leaves_each(spark):
    one = {"doc_id": 3, "text": "Same", "lang": "en", "source": None, "n_chars": 4}
    df = spark.range(0, 700, 1, 8).select(*(F.lit(v).cast("long" if k in ("doc_id", "n_chars") else "string").alias(k) for k, v in one.items()))
    assert Counter(map(tuple, merkle.manifest(df).collect())).total() == 700
    assert {r["root"] for r in merkle.manifest(df).collect()} == {next(iter(plain_manifest([one] * 700)))[3]}


def check_packing(rows, packed, tokenizer, capacity):
    """Every id lies in one piece, sequences are gapless, and only powers of two are shorter than the capacity."""
    coder = Tokenizer.from_file(tokenizer)
    ids = [np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    want = Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end == capacity or end < capacity and end & (end - 1) == 0
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
    known = defaultdict(list)
    for (i, _), x in zip(rows, ids, strict=True):
        known[i].append(x)
    for i, pieces in by_doc.items():
        pool = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces)
        assert sum(r["length"] for r in pieces) == sum(map(len, known[i]))
        if len(known[i]) == 1:
            (x,), end = known[i], 0
            for start, length, crc, size in sorted(pool):
                assert start == end and size == len(x) and crc == zlib.crc32(x[start : start + length].tobytes())
                end += length
            assert end == len(x)
    assert want.total() == len(rows) and set(by_doc) == {i for i, _ in rows}


def test_curve_packing_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, SF).collect()]
    check_packing(rows, queries.op13_hilbert_packing(spark, SF).collect(), WORD_TOKENS, 4096)


def test_curve_packing_of_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for capacity in (64, 4096):
        check_packing(rows, curve_packing.pack_along_curve(odd, tokenizer=WORD_TOKENS, capacity=capacity).collect(), WORD_TOKENS, capacity)
    assert curve_packing.pack_along_curve(nothing, tokenizer=WORD_TOKENS).count() == 0


def test_word_ids_are_the_tokenizers():
    texts = [
        "", None, " ", "a|b | c||", "Don't stop., 'S x'. 3.14. e.g., A.", "É é J̌ ́start ß İI ΑΣ ΑΣ.", "tab\tand nbsp em\nnew\r\nline",
        "<|endoftext|>x <|ENDOFTEXT|>", "日本語。テスト 한국어 " * 3, "x" * 5000, "end. End, END. end.. (end)", "Plain words, plain words. " * 40, "\x00 \x1f ., . ,", "À Ö×÷ Þß ÿ. é, É. Ÿ. 5. 7, ”. x”, (a). a.", ".", ",", "a.", "é. ", "A\u030a. A", "Ｔ． x",
    ]
    coder, plain = curve_packing.WordIds(WORD_TOKENS), Tokenizer.from_file(WORD_TOKENS)
    for _ in range(2):  # new words, then kept ones
        ids, bounds = coder(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids
    ids, bounds = coder(pa.array(texts).slice(3, 4))
    assert ids[bounds[1] : bounds[2]].tolist() == plain.encode(texts[4], add_special_tokens=False).ids


def test_each_distinct_word_is_looked_up_once():
    """op13_hilbert_packing: kept words and new ones come from one pass, and the form of ids needs no word table."""
    class Kept(dict):
        asked = 0

        def get(self, word, default=None):
            Kept.asked += 1
            return super().get(word, default)

        def __contains__(self, word):
            raise AssertionError("asked twice")

    coder = curve_packing.WordIds(WORD_TOKENS)
    assert curve_packing.id_dtype(WORD_TOKENS) == coder.dtype
    coder.kept = Kept()
    plain, texts = Tokenizer.from_file(WORD_TOKENS), ["one two one", "two three", "three one four"]
    for _ in range(2):
        ids, bounds = coder(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert Kept.asked == 8 and set(coder.kept) == {"one", "two", "three", "four"}


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours(dimensions, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = curve_packing.hilbert_keys(points, bits)
    assert sorted(keys) == list(range(len(points)))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_curve_brings_like_documents_together(spark):
    """Documents of one of six topics share sequences far more often than by chance."""
    rng = np.random.default_rng(5)
    topics = [["".join(rng.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(40)] for _ in range(6)]
    rows = [(k, " ".join(rng.choice(topics[k % 6], 40))) for k in range(600)]
    packed = curve_packing.pack_along_curve(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=WORD_TOKENS, capacity=1024).collect()
    groups = defaultdict(list)
    for r in packed:
        groups[r["sequence_id"]].append(r["doc_id"] % 6)
    pairs = [(a, b) for g in groups.values() for k, a in enumerate(g) for b in g[:k]]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.35  # 0.17 by chance


def test_copies_lie_in_many_stretches(spark, tasks_kept_apart):
    same = spark.range(0, 4000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text " * 9).alias("text"))
    packed = curve_packing.pack_along_curve(same, tokenizer=WORD_TOKENS, capacity=256)
    stretches = packed.groupBy(F.shiftright("sequence_id", 33).alias("s")).agg(F.sum("length").alias("n")).collect()
    assert sum(s["n"] for s in stretches) == 4000 * 19 and max(s["n"] for s in stretches) < 0.5 * 4000 * 19
