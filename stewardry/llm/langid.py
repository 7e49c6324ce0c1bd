"""Language identification as a mixture: each document's language proportions by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import bounded_batches, bytes_of, chunks, spans

UNKNOWN = "und"
BUCKET_BITS = 15
SMOOTHING = 0.5
EM_STEPS = 12
SET_STEPS = 4

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.full(256, 32, np.uint64)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of hashed byte trigrams, one row per language."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes from each place on, after a space in front; everything but letters is a space."""
    folded = np.full(len(data) + 3, 32, np.uint64)
    folded[1:-2] = _FOLD[data]
    with np.errstate(over="ignore"):
        code = ((folded[:-2] << np.uint64(16)) | (folded[1:-1] << np.uint64(8)) | folded[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _letter_words(data: np.ndarray, offsets: np.ndarray):
    return spans(_LETTER[data], offsets)


def train(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count trigrams of all labelled rows by language; languages x buckets counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            langs = batch.column(1).to_pylist()
            for a, b in chunks(offsets):
                part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, rows = _letter_words(part, offs)
                grams = _trigrams(part)
                use = np.zeros(len(part) + 2, np.int64)
                np.add.at(use, starts, 1)
                np.add.at(use, ends, -1)
                inside = np.flatnonzero(np.cumsum(use)[: len(grams)] > 0)
                row = np.searchsorted(offs, inside, "right") - 1
                names = np.array(langs[a:b], object)
                for lang in set(langs[a:b]):
                    hits = np.bincount(grams[inside[(names == lang)[row]]], minlength=1 << BUCKET_BITS)
                    totals[lang] = totals.get(lang, 0) + hits
        for lang, hits in totals.items():
            at = np.flatnonzero(hits)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(hits[at])], names=["lang", "bucket", "n"])

    bounded_batches(df.sparkSession)
    labelled = df.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_numpy()
    languages = tuple(sorted(set(names)))
    table = np.full((len(languages), 1 << BUCKET_BITS), SMOOTHING)
    for k, lang in enumerate(languages):
        at = names == lang
        table[k, counts.column("bucket").to_numpy()[at]] += counts.column("n").to_numpy()[at]
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True, initial=0)).astype(np.float32))


def _em(odds: np.ndarray, rows: np.ndarray, share: np.ndarray, sizes: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) after ``steps``, and each row's log likelihood under them."""
    docs, languages = share.shape
    for _ in range(steps):
        weighted = odds * share[rows]
        weighted /= np.maximum(weighted.sum(axis=1, keepdims=True), 1e-300)
        share = np.stack([np.bincount(rows, weighted[:, k], docs) for k in range(languages)], axis=1) / sizes
    fit = np.log(np.maximum((odds * share[rows]).sum(axis=1), 1e-300))
    return share, np.bincount(rows, fit, docs)


def proportions(data: np.ndarray, offsets: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Language proportions of each row, over the set of languages chosen for it.

    A word's likelihood under a language is that of its trigrams. Expectation-maximisation over the words gives
    proportions over all languages; the sets of the first 1, 2, ... languages by proportion are fitted again, and
    the set with the best likelihood less half a ``log(words)`` for each language is kept.
    """
    docs, languages = len(offsets) - 1, len(log_p)
    starts, ends, rows = _letter_words(data, offsets)
    out = np.zeros((docs, languages))
    if not len(starts) or not languages:
        return out
    grams = _trigrams(data)
    fits = np.empty((len(starts), languages))
    for k in range(languages):
        run = np.zeros(len(grams) + 1)
        np.cumsum(log_p[k][grams], out=run[1:])
        fits[:, k] = run[ends] - run[starts]
    top = fits.max(axis=1)
    odds = np.exp(fits - top[:, None])
    sizes = np.maximum(np.bincount(rows, minlength=docs), 1)[:, None].astype(float)
    share, _ = _em(odds, rows, np.full((docs, languages), 1 / languages), sizes, EM_STEPS)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best = np.full(docs, -np.inf)
    for k in range(1, languages + 1):
        kept = np.where(rank < k, np.maximum(share, 1e-6), 0)
        fitted, fit = _em(odds, rows, kept / kept.sum(axis=1, keepdims=True), sizes, SET_STEPS if k > 1 else 1)
        gain = fit - 0.5 * k * np.log(sizes[:, 0] + 1)
        better = gain > best
        best[better], out[better] = gain[better], fitted[better]
    return out


def identify(df: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Add ``lang_pred``, ``score`` (its proportion) and ``lang_mix`` (``name:proportion``, largest first) to ``keep``.

    A text that is NULL or holds no letter is ``und`` with score 0, as is every text where no language was learned.
    Repeated rows get equal answers; an empty table gives no rows. Equal proportions go to the first name.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x buckets, whatever the number of documents
    kept = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = kept.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("lang_mix", "string")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_p = shared.value.languages, shared.value.log_p
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            data, offsets = bytes_of(texts)
            preds, scores, mixes = [], [], []
            for a, b in chunks(offsets):
                part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                shares = proportions(part, offs, log_p)
                ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[part] & (part < 128))])
                plain = ascii_letters[offs[1:]] > ascii_letters[offs[:-1]]
                for k, share in enumerate(shares):
                    known = languages and share.any() and (plain[k] or any(c.isalpha() for c in texts[a + k].as_py() or ""))
                    order = np.argsort(-share, kind="stable") if known else []
                    preds.append(languages[order[0]] if known else UNKNOWN)
                    scores.append(min(1.0, float(share[order[0]])) if known else 0.0)
                    mixes.append(",".join(f"{languages[i]}:{share[i]:.3f}" for i in order if share[i] > 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.string())],
                names=[f.name for f in schema],
            )

    bounded_batches(spark)
    return kept.mapInArrow(assign, schema)
