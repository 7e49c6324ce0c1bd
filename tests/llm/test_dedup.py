"""Operators that look for repeats: suffix dedup, n-gram join, line dedup, spot signatures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stewardry.llm import common, line_dedup, ngram_join, queries, spotsigs, suffix_dedup
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_suffix_dedup_query(spark):
    docs = pairs(queries.documents(spark, SF))
    want = {i: v for (i, _), v in brute.repeats(docs).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op1_suffix_dedup(spark, SF).collect()}
    assert got == want


def test_suffix_dedup_odd_rows(spark, odd, nothing):
    docs = [(i, t) for i, t in pairs(odd) if i != 12 and i != 11]
    want = brute.repeats(docs)
    rows = suffix_dedup.remove_repeats(odd.filter("doc_id IS NULL OR doc_id NOT IN (11, 12)")).collect()
    assert len(rows) == len(docs)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == Counter((i, *want[i, t or ""]) for i, t in docs)
    everything = {(r["doc_id"], r["n_bytes"]): r for r in suffix_dedup.remove_repeats(odd).collect()}
    run = everything[11, 1200]  # one letter: only the first window stays
    assert (run["n_removed"], run["n_spans"]) == (1199, 1)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_other_windows_and_small_blocks(spark, odd, monkeypatch):
    docs = [(i, t) for i, t in pairs(odd) if i != 12 and i != 11]
    want = brute.repeats(docs, 20)
    monkeypatch.setattr(suffix_dedup, "BLOCK_PHRASES", 50)
    rows = suffix_dedup.remove_repeats(odd.filter("doc_id IS NULL OR doc_id NOT IN (11, 12)"), window=20, kmer=8).collect()
    assert Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in rows) == Counter((i, want[i, t or ""][1], want[i, t or ""][3]) for i, t in docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4))
def test_phrases_cover_each_window_once(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, _, rows, starts, windows, _ = suffix_dedup.phrases(data, offsets, 12, 4)
    covered = sorted((r, p) for r, s, n in zip(rows.tolist(), starts.tolist(), windows.tolist(), strict=True) for p in range(s, s + n))
    assert covered == [(r, p) for r, t in enumerate(texts) for p in range(len(t) - 11)]


def test_suffix_ranks_order_like_strings():
    data = np.frombuffer(b"abracadabraabracadabra", np.uint8)
    for window in (1, 3, 8, 11):
        places = np.arange(len(data) - window + 1)
        cut = [bytes(data[p : p + window]) for p in places]
        order = {s: k for k, s in enumerate(sorted(set(cut)))}
        assert suffix_dedup.suffix_ranks(data, places, window).tolist() == [order[s] for s in cut]


def test_ngram_join_query(spark):
    docs = pairs(queries.documents(spark, SF))
    want = Counter(brute.groups(docs, 3, 90, 100))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op4_ngram_join(spark, SF).collect())
    assert got == want


def test_ngram_join_odd_rows(spark, odd, nothing):
    docs = pairs(odd)
    for n, num in ((5, 80), (1, 50)):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(odd, ngram=n, similarity=(num, 100), frequent=10).collect())
        assert got == Counter(brute.groups(docs, n, num, 100))
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_ngram_join_large_group(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for k in range(120):  # each differs from the base in some words, so not all are linked directly
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = f"x{k}"
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, ngram=3, similarity=(90, 100), frequent=20).collect())
    assert got == Counter(brute.groups(rows, 3, 90, 100))


def test_ngram_join_of_large_and_small_sets(spark):
    """Sets on both sides of the size from which they carry wide sketches, with edits up to and beyond the limit."""
    rng = random.Random(6)
    rows = []
    for size in (960, 1004, 1500, 3000):
        base = [f"w{rng.randint(0, 900)}" for _ in range(size)]
        for share in (0, 0.005, 0.01, 0.017, 0.03):
            text = list(base)
            for _ in range(int(share * size)):
                text[rng.randrange(size)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(text)))
        rows.append((len(rows), " ".join(base[: int(size * 0.95)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, ngram=3, similarity=(90, 100)).collect())
    assert got == Counter(brute.groups(rows, 3, 90, 100)) and len({c for _, _, c in got}) < len(rows)


def test_ngram_join_copies_too_far_apart_to_link(spark, monkeypatch):
    """Copies of one text of which no two link are not compared in pairs: they share prefix items, but little else of their own."""
    rng = random.Random(8)
    base = " ".join(f"w{rng.randint(0, 900)}" for _ in range(300))
    rows = [(k, " ".join([base, *(f"x{k}-{word}" for word in range(18))])) for k in range(120)]
    compared, filtered = [], ngram_join._filtered
    monkeypatch.setattr(ngram_join, "_filtered", lambda pairs, *rest: (compared.append(pairs.count()), filtered(pairs, *rest))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, ngram=3, similarity=(90, 100)).collect())
    assert got == Counter(brute.groups(rows, 3, 90, 100))
    assert 0 < sum(compared) < 5 * len(rows)


def test_ngram_join_around_hubs(spark):
    """Words replaced, dropped and added on both sides of the limit, in chains and stars, with rows that come twice."""
    rng = random.Random(9)
    rows = []
    for size in (40, 90, 200):
        base = [f"w{size}-{rng.randint(0, 300)}" for _ in range(size)]
        made = [base]
        for k in range(40):
            text = list(rng.choice(made) if k % 4 == 0 else base)
            for _ in range(rng.randint(1, max(2, size // 25))):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[], [f"x{rng.randint(0, 40)}"], [text[at], f"x{k}"]])
            made.append(text)
        rows += [(len(rows) + k, " ".join(text)) for k, text in enumerate(made[1:])]
    rows += rows[::10]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (90, 75):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, ngram=3, similarity=(num, 100), frequent=20).collect())
        assert got == Counter(brute.groups(rows, 3, num, 100))


def test_line_dedup_query(spark):
    docs = pairs(queries.documents(spark, SF))
    want = {i: v for (i, _), v in brute.kept_lines(docs[:60], line_dedup.EDITS, line_dedup.LEAST_BYTES).items()}
    df = queries.documents(spark, SF).filter(f"doc_id <= {max(want)}")
    got = {r["doc_id"]: (r["kept"], r["n_gone"]) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == want
    whole = queries.op5_line_dedup(spark, SF).collect()
    assert len(whole) == len(docs) and sum(r["n_gone"] for r in whole) > 0


def test_line_dedup_odd_rows(spark, odd, nothing):
    some = odd.filter("doc_id IS NULL OR doc_id NOT IN (11, 12)")
    docs = pairs(some)
    want = brute.kept_lines(docs, 2, 20)
    rows = line_dedup.drop_repeated_lines(some, keep=("source", "row_order"), least_bytes=20).collect()
    assert Counter((r["doc_id"], r["kept"], r["n_gone"]) for r in rows) == Counter((i, t if t is None else want[i, t][0], want[i, t or ""][1]) for i, t in docs)
    assert line_dedup.drop_repeated_lines(odd).count() == odd.count()
    assert line_dedup.drop_repeated_lines(nothing).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=16), st.binary(max_size=16), st.integers(0, 4))
def test_banded_distance(a, b, edits):
    assert line_dedup.within(a, b, edits) == (brute.edit_distance(a, b) <= edits)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=8, max_size=24), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 23)), max_size=2))
def test_segments_meet_within_reach(a, changes):
    b = list(a)
    for kind, at in changes:
        at = min(at, len(b) - 1)
        if kind == 0:
            b.insert(at, "c")
        elif kind == 1 and len(b) > 6:
            del b[at]
        else:
            b[at] = "c"
    texts = [a.encode(), "".join(b).encode()]
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begin = np.array([0, len(texts[0]) + 1])
    stop = np.array([len(texts[0]), len(data)])
    ours = line_dedup.sketches(data, begin, stop).view(np.uint64)
    assert int(np.bitwise_count(ours[0] ^ ours[1]).sum()) <= 12  # two edits at most
    offered, asked = set(), set()
    for keys, at, kind in line_dedup.segment_keys(line_dedup.prefix_hash(data), begin, stop, 2):
        for k, i in zip(keys.tolist(), at.tolist(), strict=True):
            asked.add((i, k))
            if kind == line_dedup._SEGMENT:
                offered.add((i, k))
    assert any((1 - i, k) in asked for i, k in offered)


def _spot_set(written):
    return {written[k : k + 8] for k in range(0, len(written), 8)}


def test_spot_signatures_query(spark):
    docs = sorted((i, t or "") for i, t in pairs(queries.documents(spark, SF)))
    rows = {r["doc_id"]: r for r in queries.op8_spot_signatures(spark, SF).collect()}
    for k, (i, text) in enumerate(docs):
        j, n, r = len(text) // 4, docs[(k + 1) % len(docs)], rows[i]
        edited = text[: len(text) - j] + n[1][:j]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, after = _spot_set(r["fingerprint"]), _spot_set(rows[n[0]]["fingerprint"])
        assert r["near_next"] == len(own & after) / max(1, len(own | after)) or own == after
        if edited == text:
            assert r["near_edited"] == 1.0 and r["fingerprint"] == r["edited_fingerprint"]


def test_spot_signatures_odd_rows(spark, odd, nothing):
    for stretch in (4096, 3):
        rows = spotsigs.compare_with_edits(odd, stretch=stretch).collect()
        assert len(rows) == odd.count()
        by_text = {}
        for r in rows:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
        assert len(by_text[3]) == 1 and by_text[1] == by_text[3]
        repeated = [r for r in rows if r["doc_id"] == 3]
        assert max(r["near_next"] for r in repeated) == 1.0  # the same text follows
        one = {r["doc_id"]: r for r in rows if r["doc_id"] == 116 or r["doc_id"] is None}
        assert one
    assert spotsigs.compare_with_edits(nothing).count() == 0


def test_spot_search_finds_all(spark):
    prints = spotsigs.fingerprints(queries.documents(spark, SF)).cache()
    asked = prints.filter("doc_id % 100 = 0")
    sets = {r["doc_id"]: set(r["spots"]) for r in prints.collect()}
    for threshold in (0.8, 0.05):
        got = {(r["query_id"], r["doc_id"]) for r in spotsigs.search(asked, prints, threshold).collect()}
        want = {(q, d) for q in sets if q % 100 == 0 for d, s in sets.items() if sets[q] and len(sets[q] & s) >= threshold * len(sets[q] | s)}
        assert got == want


def test_texts_of_one_id_with_equal_low_hash_bits_stay_apart(spark):
    """Two texts under a NULL id whose hashes agree in 24 bits are two documents for every operator."""
    made = spark.range(20_000).select("id", F.xxhash64(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" here"))).bitwiseAND(0xFFFFFF).alias("low"))
    a, b = made.groupBy("low").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter("size(ids) > 1").orderBy("low").first()["ids"][:2]
    one, two = (f"word {k} here" for k in (a, b))
    df = spark.createDataFrame([(None, one), (None, two)], "doc_id long, text string")
    assert common.keyed(df, "doc_id", "text").select("row_order", "row_tag").distinct().count() == 2
    rows = line_dedup.drop_repeated_lines(df.union(spark.createDataFrame([(1, two)], df.schema)), edits=0, least_bytes=4).collect()
    assert Counter((r["doc_id"], r["n_gone"]) for r in rows) == Counter({(None, 0): 2, (1, 1): 1})
    rows = suffix_dedup.remove_repeats(df, window=5, kmer=3).collect()
    seen = brute.repeats([(0, one), (1, two)], 5), brute.repeats([(0, two), (1, one)], 5)
    got = Counter(r["kept_sha256"] for r in rows)
    assert got in [Counter(v[3] for v in want.values()) for want in seen]


def test_texts_without_chains_are_compared_by_words():
    """A letter changed in a text that has no anchors, or no words at all, leaves most of its likeness."""
    sentence = "быстрая лиса прыгает через ленивую собаку около старого дома "
    for text in (sentence * 20, "!? " * 3 + "".join(chr(33 + k % 14) for k in range(60))):
        changed = text[:-5] + "#" + text[-4:]
        own, edited, other = spotsigs._sets([text.encode(), changed.encode(), b"completely other words here"])
        assert 0.6 < spotsigs.likeness(own, edited) < 1 and spotsigs.likeness(own, other) == 0
    whole, empty, short = spotsigs._sets([b"word", b"", b"!!"])
    assert len(whole) == 1 and len(empty) == 0 and len(short) == 1


def plain_signatures(text):
    """What the signatures stand for: chains of an anchor and the content words after it, or words, or runs of bytes."""
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text.translate(brute.LOWER))
    anchors = set(spotsigs.ANCHORS)
    chains = set()
    for k, w in enumerate(words):
        rest = [x for x in words[k + 1 :] if x not in anchors][: spotsigs.CHAIN]
        if w in anchors and len(rest) == spotsigs.CHAIN:
            chains.add((w, *rest))
    data = text.encode()
    return chains or set(words) or {data[k : k + 4] for k in range(max(1, len(data) - 3))} if data else set()


def test_spot_signatures_are_the_plain_ones(spark):
    docs = [t or "" for _, t in pairs(queries.documents(spark, SF))]
    plain = [plain_signatures(t) for t in docs]
    for k, (text, spots) in enumerate(zip(docs, spotsigs._sets([t.encode() for t in docs]), strict=True)):
        assert len(spots) == len(plain[k])
        if k:
            both = len(plain[k] & plain[k - 1]) / max(1, len(plain[k] | plain[k - 1]))
            assert abs(spotsigs.likeness(spots, spotsigs._sets([docs[k - 1].encode()])[0]) - both) < 1e-9 or not (plain[k] or plain[k - 1])


def test_a_frequent_line_puts_few_rows_under_its_key(spark):
    """A line in every document is offered once a task under its key, not once an occurrence."""
    line = "this licence line stands in every single document of the table"
    df = spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\nown line of document number "), F.col("id").cast("string"), F.lit(" and nothing else at all\n" + line)).alias("text"))
    rows = common.keyed(df, "doc_id", "text").mapInArrow(line_dedup._offer(0, 40), line_dedup._ROWS)
    assert rows.filter(f"kind = {line_dedup._LINE}").groupBy("key").count().agg(F.max("count")).first()[0] <= 8
    gone = {r["doc_id"]: r["n_gone"] for r in line_dedup.drop_repeated_lines(df, edits=0).collect()}
    assert gone == {k: 1 if k == 0 else 2 for k in range(3000)}
