"""Weighted name similarity (0–100) for pairs that already passed the name predicate.

The score follows the published description of the weighted ratio of the fuzzy-matching
libraries: plain, token-sorted, token-set and partial similarities of longest common
subsequences, scaled by how much the lengths differ.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: weights of the score ------------------------------------------------------
TOKEN_WEIGHT = 0.95
PARTIAL_FROM = 1.5
PARTIAL_WEIGHT = 0.9
LONG_PARTIAL_OVER = 8.0
LONG_PARTIAL_WEIGHT = 0.6
# -------------------------------------------------------------------------------------------


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word step per character."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def _share(distance: int, total: int) -> float:
    return 100.0 * (1 - distance / total) if total else 100.0


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return _share(total - 2 * _common(a, b), total)


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with any stretch of the longer one that is no longer than it."""
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(*sorted((a, b), key=len))


def _windows(short: str, long: str) -> float:
    n = len(short)
    if not n:
        return 0.0
    spans = ((max(i, 0), min(i + n, len(long))) for i in range(1 - n, len(long)))
    return max(_ratio(short, long[i:j]) for i, j in spans)


def _token_set(a: set[str], b: set[str]) -> float:
    shared, only_a, only_b = (" ".join(sorted(s)) for s in (a & b, a - b, b - a))
    if shared and not (only_a and only_b):
        return 100.0
    gap = 1 if shared else 0
    with_a, with_b = (len(shared) + gap + len(only) for only in (only_a, only_b))
    best = _share(len(only_a) + len(only_b) - 2 * _common(only_a, only_b), with_a + with_b)
    if shared:
        best = max(best, *(_share(gap + len(o), 2 * len(shared) + gap + len(o)) for o in (only_a, only_b)))
    return best


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    sorted_a, sorted_b = (" ".join(sorted(s.split())) for s in (a, b))
    set_a, set_b = set(a.split()), set(b.split())
    stretch = max(len(a), len(b)) / min(len(a), len(b))
    if stretch < PARTIAL_FROM:
        tokens = max(_ratio(sorted_a, sorted_b), _token_set(set_a, set_b))
        return max(_ratio(a, b), TOKEN_WEIGHT * tokens)
    weight = PARTIAL_WEIGHT if stretch <= LONG_PARTIAL_OVER else LONG_PARTIAL_WEIGHT
    tokens = 100.0 if set_a & set_b else _partial(sorted_a, sorted_b)
    return max(_ratio(a, b), weight * _partial(a, b), TOKEN_WEIGHT * weight * tokens)


def _best(known: dict[tuple[str, str], float], name: str, texts: Iterable[str]) -> float:
    """Best score of a name against some texts, 0 if there are none; ``known`` holds the scores of a batch."""
    best = 0.0
    for text in texts:
        if (name, text) not in known:
            known[name, text] = weighted_ratio(name, text)
        best = max(best, known[name, text])
    return best


@F.pandas_udf(T.DoubleType())
def fuzzy_score(wanted: pd.Series, texts: pd.Series) -> pd.Series:
    """Best score of a wanted name against the slot texts of one row; 0 if no slot has text."""
    known: dict[tuple[str, str], float] = {}
    return pd.Series([_best(known, name, slots) for name, slots in zip(wanted, texts)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def weakest_score(wanted: pd.Series, texts: pd.Series) -> pd.Series:
    """The :func:`fuzzy_score` of that of several wanted names which scores least."""
    known: dict[tuple[str, str], float] = {}
    return pd.Series([min(_best(known, name, slots) for name in names) for names, slots in zip(wanted, texts)], dtype="float64")
