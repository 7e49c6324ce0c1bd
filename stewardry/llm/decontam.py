"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words. An item of L words is in a document if some stretch of it is within
``floor(edit_share * L)`` word edits. Such a stretch shares ``least_run`` unedited words in a row with the item, so
windows of the item's size are laid only where a document has such a run, at the place that the run has in the item.

Each window and item goes through random walks of 3 * L steps (Chakraborty, Goldenberg, Koucky): a step writes the
word at the walk's place and goes on to the next word if a random bit of (step, word) says so. Walks over similar
sequences fall into step, so edit distance becomes Hamming distance. A hash samples a few steps of one walk; a window
is a candidate for every item with the same hash in any of the repetitions, and candidates are verified exactly.

Items of fewer than ``least_words`` words go another way, which misses nothing: an item that may have e edits is cut
into e + 1 pieces, of which a stretch within reach holds one whole. Documents' runs of words are looked up among the
pieces, and what the words around a run do not rule out is verified exactly.

Words are runs of letters and digits; in scripts that set no spaces between words each code point is a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import bounded_batches, bytes_of, chunks, mix, ngrams, prefix_hash, span_hash, spans, text_tag

EDIT_SHARE = 0.2
LEAST_RUN = 3
LEAST_WORDS = 8
REPETITIONS = 12
SAMPLED = 3
#: Items that go to the executors together; more items take more passes over the documents.
BLOCK_ITEMS = 20_000
#: Walk steps held together, about.
BLOCK_STEPS = 4_000_000

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_PAD = np.uint64(0x5851F42D4C957F2D)
#: Code points (first, last) of scripts without spaces: South-East Asian ones, Tibetan, Han, kana, bopomofo, Yi.
_SPACELESS = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x9FFF),
    (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)
#: Punctuation of those scripts, which parts words as ASCII punctuation does.
_MARKS = ((0x3000, 0x3004), (0x3008, 0x3020), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
_SAMPLES = np.random.default_rng(4242).random((REPETITIONS, SAMPLED))


def edits_allowed(words: int, share: float = EDIT_SHARE) -> int:
    return int(words * share + 1e-9)


def _within(points: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    edges = np.array(sorted(x for a, b in ranges for x in (a, b + 1)))
    return np.searchsorted(edges, points, "right") % 2 == 1


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Hashes of words (letters and digits, A-Z lowered; single code points of scripts without spaces), their starts
    and ends in bytes, and rows. ``offsets`` start at 0."""
    inside, edges = _WORD[data], offsets
    lead = np.flatnonzero(data >= 0xE0)  # of three or four bytes, as all those scripts are
    if len(lead):
        size = np.where(data[lead] >= 0xF0, 4, 3)
        byte = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) for k in range(4)]
        three = (byte[0] & 15) << 12 | (byte[1] & 63) << 6 | byte[2] & 63
        points = np.where(size == 3, three, (byte[0] & 7) << 18 | (byte[1] & 63) << 12 | (byte[2] & 63) << 6 | byte[3] & 63)
        mark, single = _within(points, _MARKS), _within(points, _SPACELESS)
        for k in range(3):
            inside[lead[mark] + k] = False
        if single.any():
            edges = np.unique(np.concatenate([offsets, lead[single], lead[single] + size[single]]))
    starts, ends, rows = spans(inside, edges)
    if edges is not offsets:
        rows = np.searchsorted(offsets, starts, "right") - 1
    return span_hash(prefix_hash(data, lower=True), starts, ends), starts, ends, rows


def embed(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes (windows x repetitions) of sampled steps of the walks over ``words[start : start + length]``."""
    n, steps = len(starts), 3 * int(lengths.max(initial=0))
    place = np.zeros((n, REPETITIONS), np.int64)
    seen = np.empty((steps, n, REPETITIONS), np.uint64)
    last = len(words) - 1
    walks = np.arange(REPETITIONS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for step in range(steps):
            word = np.where(place < lengths[:, None], words[np.minimum(starts[:, None] + place, last)], _PAD)
            seen[step] = word
            bit = mix(np.uint64(step * REPETITIONS + 1) + walks) | np.uint64(1)
            place += ((word * bit) >> np.uint64(63)).astype(np.int64)
        picked = (_SAMPLES[None] * (3 * lengths)[:, None, None]).astype(np.int64)
        at = np.arange(n)[:, None], np.arange(REPETITIONS)[None, :]
        out = mix(lengths.astype(np.uint64))[:, None] + walks[None, :]
        for k in range(SAMPLED):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + seen[picked[:, :, k], *at])
    return out


def best_match(item: tuple[int, ...], words: list[int]) -> tuple[int, int]:
    """Fewest edits of ``item`` against any stretch of ``words``, and the end of the first such stretch: bit-parallel."""
    m = len(item)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for k, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << k
    up, down, value = ones, 0, m
    best, end = m, 0
    for j, w in enumerate(words):
        match = where.get(w, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        plus = down | ~(diagonal | up) & ones
        minus = up & diagonal
        value += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & ones, minus << 1 & ones  # a stretch may begin anywhere
        up = minus | ~(diagonal | plus) & ones
        down = plus & diagonal
        if value < best:
            best, end = value, j + 1
    return best, end


@dataclass(frozen=True)
class ItemIndex:
    """A block of items: their words, the runs of words that open windows, and their hashes."""

    ids: np.ndarray
    words: list[tuple[int, ...]]
    runs: np.ndarray
    run_item: np.ndarray
    run_place: np.ndarray
    hashes: np.ndarray
    hash_item: np.ndarray
    share: float
    least_run: int
    #: Pieces of short items by their number of words: sorted hashes, items and places in the item.
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def _runs(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of ``n`` words within a row."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    with np.errstate(over="ignore"):
        out = words[at]
        for k in range(1, n):
            out = mix(out + np.uint64(k)) + words[at + k]
        return at, mix(out)


def index_items(ids: list[int], texts: list[str], share: float = EDIT_SHARE, least_run: int = LEAST_RUN, least_words: int = LEAST_WORDS) -> ItemIndex:
    words, kept, runs, run_item, run_place, hashes, hash_item = [], [], [], [], [], [], []
    cut: dict[int, list[tuple[int, int, int]]] = {}
    for i, text in zip(ids, texts, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        found = word_hashes(data, np.array([0, len(data)]))[0]
        if not len(found):
            continue
        k = len(words)
        words.append(tuple(found.tolist()))
        kept.append(i)
        if len(found) < max(least_words, least_run):
            parts = min(len(found), edits_allowed(len(found), share) + 1)
            ends = [len(found) * p // parts for p in range(parts + 1)]
            for a, b in zip(ends, ends[1:], strict=False):
                piece = _runs(found[a:b], np.zeros(b - a, np.int64), b - a)[1]
                cut.setdefault(b - a, []).append((int(piece[0]), k, a))
            continue
        grams = ngrams(found, np.zeros(len(found), np.int64), least_run)[0]
        runs.append(grams), run_item.append(np.full(len(grams), k)), run_place.append(np.arange(len(grams)))
        keys = embed(found, np.zeros(1, np.int64), np.array([len(found)]))[0]
        hashes.append(keys), hash_item.append(np.full(len(keys), k))
    pieces = {}
    for n, rows in sorted(cut.items()):
        rows.sort()
        pieces[n] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    if not runs:
        none = np.zeros(0, np.int64)
        return ItemIndex(np.array(kept, np.int64), words, none.astype(np.uint64), none, none, none.astype(np.uint64), none, share, least_run, pieces)
    runs, run_item, run_place = np.concatenate(runs), np.concatenate(run_item), np.concatenate(run_place)
    by = np.argsort(runs, kind="stable")
    hashes, hash_item = np.concatenate(hashes), np.concatenate(hash_item)
    by2 = np.argsort(hashes, kind="stable")
    return ItemIndex(np.array(kept), words, runs[by], run_item[by], run_place[by], hashes[by2], hash_item[by2], share, least_run, pieces)


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), and which range each is of."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of], of


def _search_short(words: np.ndarray, rows: np.ndarray, index: ItemIndex) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Matches of items below the bound: every stretch that holds a piece is tried."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not len(words):
        return out
    size = np.array([len(w) for w in index.words])
    spare = np.array([edits_allowed(len(w), index.share) for w in index.words])
    table = np.zeros((len(size), max((int(size[k]) for _, items, _ in index.pieces.values() for k in items), default=0)), np.uint64)
    for k, w in enumerate(index.words):
        if len(w) <= table.shape[1]:
            table[k, : len(w)] = w
    firsts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    ends = np.append(firsts[1:], len(words))
    tried: set[tuple[int, int, int]] = set()
    for n, (hashes, items, places) in index.pieces.items():
        at, found = _runs(words, rows, n)
        maybe = np.flatnonzero(np.isin(found, hashes))
        low, high = np.searchsorted(hashes, found[maybe], "left"), np.searchsorted(hashes, found[maybe], "right")
        for cut in range(0, len(maybe), 100_000):
            entry, of = _expand(low[cut : cut + 100_000], high[cut : cut + 100_000])
            item, begin = items[entry], at[maybe[cut + of]] - places[entry]
            row = np.searchsorted(firsts, begin + places[entry], "right") - 1
            # Each word that is not edited stands at most as many words off as edits are allowed.
            met = np.zeros(len(item), np.int64)
            for k in range(table.shape[1]):
                near = np.zeros(len(item), bool)
                for shift in range(-int(spare[item].max(initial=0)), int(spare[item].max(initial=0)) + 1):
                    place = begin + k + shift
                    ok = (abs(shift) <= spare[item]) & (place >= firsts[row]) & (place < ends[row])
                    near |= ok & (words[np.clip(place, 0, len(words) - 1)] == table[item, k])
                met += near & (k < size[item])
            hits = np.flatnonzero(met >= size[item] - spare[item])
            use = spare[item[hits]] > 0  # without edits the first of a row and item is the answer
            use[np.unique(row[hits] * len(size) + item[hits], return_index=True)[1]] = True
            for h in hits[use]:
                i, b, e = int(item[h]), int(begin[h]), int(spare[item[h]])
                r = int(rows[firsts[row[h]]])
                if (r, i) in out and out[r, i] <= (0, b - e, b - e) or (r, i, b) in tried:
                    continue
                tried.add((r, i, b))
                if not e:
                    match = 0, b, b + int(size[i])
                else:
                    a = max(int(firsts[row[h]]), b - e)
                    stretch = words[a : min(int(ends[row[h]]), b + int(size[i]) + e)].tolist()
                    edits, end = best_match(index.words[i], stretch)
                    if edits > e:
                        continue
                    back, length = best_match(index.words[i][::-1], stretch[:end][::-1])
                    match = edits, a + end - length if back == edits else a, a + end
                if (r, i) not in out or match < out[r, i]:
                    out[r, i] = match
    return out


def search(words: np.ndarray, rows: np.ndarray, index: ItemIndex) -> list[tuple[int, int, int, int, int]]:
    """Matches (row, item number, edits, first word, end word) in rows of words, the best of each row and item."""
    short = _search_short(words, rows, index) if index.pieces else {}
    return sorted([(r, i, *v) for (r, i), v in short.items()] + _search_long(words, rows, index))


def _search_long(words: np.ndarray, rows: np.ndarray, index: ItemIndex) -> list[tuple[int, int, int, int, int]]:
    if len(words) < index.least_run or not len(index.runs):
        return []
    whole = np.flatnonzero(rows[: len(rows) - index.least_run + 1] == rows[index.least_run - 1 :])
    grams = ngrams(words, rows, index.least_run)[0]
    _, first = np.unique(rows, return_index=True)
    short = np.bincount(rows)[rows[first]] < index.least_run  # a short row gives one gram, not a run
    is_whole = np.ones(len(grams), bool)
    if short.any():
        starts_at = np.sort(np.concatenate([whole, first[short]]))
        is_whole = ~np.isin(starts_at, first[short])
    grams = grams[is_whole]
    screen = np.zeros(1 << 20, bool)
    screen[(index.runs >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(screen[(grams >> np.uint64(44)).astype(np.int64)])
    low, high = np.searchsorted(index.runs, grams[maybe], "left"), np.searchsorted(index.runs, grams[maybe], "right")
    entry, of = _expand(low, high)
    if not len(entry):
        return []
    at = whole[maybe[of]]
    row = rows[at]
    ends = np.append(first[1:], len(words))
    row_first = first[np.searchsorted(rows[first], row)]
    row_end = ends[np.searchsorted(rows[first], row)]
    lengths = np.array([len(w) for w in index.words])[index.run_item[entry]]
    start = np.clip(at - index.run_place[entry], row_first, row_end)
    windows = np.unique(np.stack([lengths, start, row_end]), axis=1)  # by length
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    k = 0
    while k < windows.shape[1]:
        many = max(1, BLOCK_STEPS // (3 * REPETITIONS * int(windows[0, min(k + 4096, windows.shape[1] - 1)])))
        size, begin, limit = windows[:, k : k + min(many, 4096)]
        k += len(size)
        keys = embed(words, begin, size).ravel()
        low, high = np.searchsorted(index.hashes, keys, "left"), np.searchsorted(index.hashes, keys, "right")
        entry, of = _expand(low, high)
        for window, item in {(int(w), int(i)) for w, i in zip(of // REPETITIONS, index.hash_item[entry], strict=True)}:
            s, e = int(begin[window]), int(limit[window])
            r = int(rows[s]) if s < len(rows) else -1
            spare = edits_allowed(len(index.words[item]), index.share)
            if r < 0 or (r, item, s) in tried:
                continue
            tried.add((r, item, s))
            a = max(int(first[np.searchsorted(rows[first], r)]), s - spare)
            b = min(e, s + len(index.words[item]) + spare)
            stretch = words[a:b].tolist()
            edits, end = best_match(index.words[item], stretch)
            if edits <= spare:
                # The same from the end gives where the stretch begins.
                back, length = best_match(index.words[item][::-1], stretch[:end][::-1])
                found = (edits, a + end - length if back == edits else a, a + end)
                if (r, item) not in out or found < out[(r, item)]:
                    out[(r, item)] = found
    return [(r, i, *v) for (r, i), v in sorted(out.items())]


def _scan(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            ids, tags = batch.column(0), batch.column(2)
            out: list[list] = [[], [], [], [], [], [], []]
            held: list[tuple] = []
            for a, b in chunks(offsets):
                part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, starts, ends, rows = word_hashes(part, offs)
                held.append((hashes, starts + offsets[a], ends + offsets[a], rows + a))
            hashes, starts, ends, rows = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.zeros(0, np.int64)] * 4
            for r, item, edits, first, end in search(hashes, rows, index.value):
                before = data[offsets[r] : starts[first]].tobytes().decode()
                inside = data[starts[first] : ends[end - 1]].tobytes().decode() if end > first else ""
                values = ids[r].as_py(), int(index.value.ids[item]), edits, len(index.value.words[item]), len(before), len(before) + len(inside), tags[r].as_py()
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "item_id", "edits", "item_words", "start", "end", "row_tag"])

    return scan


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edit_share: float = EDIT_SHARE,
    least_run: int = LEAST_RUN,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Items that stand in documents: ``doc_id, item_id, edits, item_words, start, end`` (code points, end exclusive)
    and ``row_tag``, which tells texts of one id apart.

    One row per document row and item, with the fewest edits, and of those the first place. A NULL or empty text
    holds no item; a NULL id is kept; repeated rows of documents or items each give their rows; items that are NULL
    or have no word are not looked for, and those of fewer than ``least_words`` words are found without a miss; further columns are ignored; empty tables give no
    rows. Items go to the executors in blocks of ``BLOCK_ITEMS``, each with one pass over the documents.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("_item"), F.col(item_text_col).cast("string").alias("_words")).filter("_item IS NOT NULL AND _words IS NOT NULL")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    docs = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), text_tag(F.col(text_col)).alias("row_tag"))
    out: DataFrame | None = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("_item", "_words"), F.lit(blocks)) == block).orderBy("_item", "_words").toArrow()
        index = spark.sparkContext.broadcast(index_items(rows.column(0).to_pylist(), rows.column(1).to_pylist(), edit_share, least_run, least_words))
        found = docs.mapInArrow(_scan(index), "doc_id long, item_id long, edits int, item_words int, start long, end long, row_tag long")
        out = found if out is None else out.unionByName(found)
    return out
