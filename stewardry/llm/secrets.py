"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds secrets beside them.

The field tags tokens as begin, inside or outside. It learns from the patterns' own matches in a bounded sample of
documents, by the shape of a token, its neighbours and what kind of file it stands in, and so also finds secrets
that no pattern names. Decoding is Viterbi's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stewardry.llm.common import bounded_batches

#: The base patterns and the least lengths of what they match.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KEY_PARTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# A match of at least that many characters is the whole run, so these find the same spans without the short runs.
_ACCESS_LONG = re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4))
_HEX_LONG = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)

#: Only tokens of at least LEAST_TOKEN characters may begin a secret, as the base patterns ask of a value; CONTEXT
#: characters around what may name or be one are tagged.
LEAST_TOKEN = 6
CONTEXT = 80
#: Characters of a stretch between windows.
GAP = 400
#: Answers on runs without white space of that many characters at most are kept.
LONG_RUN = 64
#: Documents that the field is fitted on, and pieces of their windows, at most; longer windows are cut into pieces.
SAMPLE_DOCS = 2000
SAMPLE_PIECES = 12_000
PIECE_TOKENS = 120
FEATURE_BITS = 14
STEPS = 150
OUT, BEGIN, IN = 0, 1, 2

_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
#: What opens a window: a run with a digit or with a capital after a small letter, and words that name secrets.
_TELLING_RUN = re.compile(r"(?:[0-9]|(?<=[a-z])[A-Z])[A-Za-z0-9+/_-]*")
_NAMING = re.compile(r"(?ai:pass(?:word|wd|phrase|code)|passwd|pwd|secret|token|credential|\bapi|\bkeys?\b|_key|\bauth|\blogin)")
#: Each match of ``_NAMING`` holds one of these.
_NAMING_PARTS = ("pass", "pwd", "secret", "token", "credential", "api", "key", "auth", "login")
_BEFORE_RUN = re.compile(r"[A-Za-z+/_-]*\Z")
_FEATURES = 14


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the base patterns in code points: start, end, kind, by start and then kind as listed."""
    found = [(m.start(), m.end(), "access") for m in _ACCESS_LONG.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX_LONG.finditer(text)]
    lowered = text.lower()
    if any(part in lowered for part in KEY_PARTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _secret_parts(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    return [(ASSIGN.match(text, a).start(2) if kind == "assign" else a, b) for a, b, kind in found]


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around what names or looks like a secret, which the field learns from; the rest is decoded as well."""
    opened = []
    for m in _TELLING_RUN.finditer(text):
        start = m.start()
        back = max(0, start - 256)
        while True:  # the run's part before what tells
            first = start - len(_BEFORE_RUN.search(text[back:start])[0])
            if first > back or back == 0:
                break
            back = max(0, back - 4096)
        if m.end() - first >= LEAST_TOKEN:
            opened.append((first, m.end()))
    lowered = text.lower()
    if any(part in lowered for part in _NAMING_PARTS):
        opened += [(m.start(), m.end()) for m in _NAMING.finditer(text)]
    out: list[tuple[int, int]] = []
    for first, last in sorted(opened):
        a, b = max(0, first - CONTEXT), min(len(text), last + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shape(token: str) -> str:
    kinds = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in token[:12]]
    return "".join(c for k, c in enumerate(kinds) if k == 0 or kinds[k - 1] != c)


@lru_cache(1 << 16)
def _hashed(name: str) -> int:
    value = 2166136261
    for c in name.encode():
        value = (value ^ c) * 16777619 & 0xFFFFFFFF
    return (value ^ value >> 15) & (1 << FEATURE_BITS) - 1


def _own_names(token: str) -> tuple[str, ...]:
    """The features of a token that do not depend on its neighbours."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(token, token[1:], strict=False))
    return (
        f"shape={_shape(token)}",
        f"length={min(len(token), 64) // 4}",
        f"digits={digits * 8 // len(token)}",
        f"changes={min(changes, 12) // 2}",
        f"case={token.isupper()}{token.islower()}{letters > 0}{digits > 0}",
        f"hex={all(c in '0123456789abcdefABCDEF' for c in token)}{len(token) >= LEAST_HEX}",
        f"start={token[:4]}",
    )


def sequence(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Tokens of a window: their spans, hashed features, and which of begin and inside each may be."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, a, b)]
    dense = sum(not c.isalpha() and not c.isspace() for c in text[a:b]) * 10 // max(1, b - a)
    code = "code" if any(c in "{}[];<>" for c in text[a:b]) else "prose"
    features = np.zeros((len(tokens), _FEATURES), np.int64)
    allowed = np.zeros((len(tokens), 3), bool)
    allowed[:, OUT] = True
    words = [t.lower() for *_, t in tokens]
    for k, (start, end, token) in enumerate(tokens):
        digits = sum(c.isdigit() for c in token)
        back = words[k - 1] if k else "^"
        back2 = words[k - 2] if k > 1 else "^"
        after = words[k + 1] if k + 1 < len(tokens) else "$"
        key = next((w for w in words[max(0, k - 4) : k][::-1] if len(w) > 1), "^")
        *early, start_name = _own_names(token)
        names = (
            "bias",
            *early,
            f"back={back if len(back) == 1 else '*'}",
            f"back2={back2 if len(back2) == 1 else '*'}{back if len(back) == 1 else '*'}",
            f"after={after if len(after) == 1 else '*'}",
            f"key={key}",
            start_name,
            f"file={code}{dense}{len(token) >= LEAST_TOKEN}",
            f"glued={k > 0 and tokens[k - 1][1] == start}{digits > 0 and len(token) >= LEAST_TOKEN}",
        )
        features[k] = [_hashed(f"{n}") for n in names]
        allowed[k, BEGIN] = len(token) >= LEAST_TOKEN
        allowed[k, IN] = k > 0 and tokens[k - 1][1] == start and (token in ".=~" or len(token) > 1) and bool(allowed[k - 1, 1:].any())
    return [(s, e) for s, e, _ in tokens], features, allowed


@dataclass(frozen=True)
class FieldModel:
    """Weights of hashed features by tag, and of a tag after a tag."""

    weights: np.ndarray
    moves: np.ndarray

    @cached_property
    def screen(self) -> Screen:
        return Screen(self)


_FORBIDDEN = -1e4
_RULES = np.zeros((3, 3))
_RULES[OUT, IN] = _FORBIDDEN  # inside follows begin or inside only


def _emissions(features: np.ndarray, allowed: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.where(allowed, weights[features].sum(axis=-2), _FORBIDDEN)


def viterbi(features: np.ndarray, allowed: np.ndarray, model: FieldModel) -> list[int]:
    """The best tags of one window; outside before and after it."""
    scores = _emissions(features, allowed, model.weights)
    moves = model.moves + _RULES
    best, back = scores[0] + moves[OUT], []
    for row in scores[1:]:
        steps = best[:, None] + moves
        back.append(steps.argmax(axis=0))
        best = steps.max(axis=0) + row
    tags = [int((best + moves[:, OUT]).argmax())]
    for pointers in reversed(back):
        tags.append(int(pointers[tags[-1]]))
    return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = STEPS, decay: float = 1e-3) -> FieldModel:
    """Maximise the conditional likelihood of tagged windows (features, allowed, tags) by adaptive gradient steps.

    Tokens lie place by place and, within a place, by falling length of their windows, so those with a token at a place are
    the first ones at the place before it, and no padding is computed. Tags are the first axis.
    """
    weights, moves = np.zeros((3, 1 << FEATURE_BITS)), np.zeros((3, 3))
    n, sequences = len(sequences), sorted((s for s in sequences if len(s[2])), key=lambda s: -len(s[2]))
    if not sequences:
        weights[BEGIN] = -1.0  # nothing to learn from: tag nothing
        return FieldModel(np.ascontiguousarray(weights.T), moves)
    lengths = np.array([len(s[2]) for s in sequences])
    own = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((own, place))
    own, place = own[order], place[order]
    features = np.ascontiguousarray(np.concatenate([s[0] for s in sequences])[order].T)
    allowed = np.concatenate([s[1] for s in sequences])[order].T
    tags = np.concatenate([s[2] for s in sequences])[order]
    held = np.bincount(place)
    ends = np.concatenate([[0], np.cumsum(held)])
    at = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]  # tokens of a place
    goes_on = [slice(a, a + m) for a, m in zip(ends, held[1:], strict=False)]  # those of them with a token at the next place
    last, later = ends[lengths - 1] + np.arange(len(lengths)), place > 0
    before = (ends[place - 1] + own)[later]
    gold = np.eye(3)[:, tags]
    was = np.zeros_like(tags)
    was[later] = tags[before]
    gold_moves = np.bincount(was * 3 + tags, minlength=9).reshape(3, 3).astype(float)
    seen_w, seen_m = np.full(weights.shape, 1e-8), np.full((3, 3), 1e-8)
    flat = features.ravel()
    ahead, behind, came = np.empty_like(gold), np.empty_like(gold), np.full(gold.shape, -np.inf)
    came[OUT, ~later] = 0.0
    for _ in range(steps):
        scores = np.where(allowed, [w[features].sum(axis=0) for w in weights], _FORBIDDEN)
        rules = moves + _RULES
        ahead[:, at[0]] = scores[:, at[0]] + rules[OUT][:, None]
        for here, then in zip(goes_on, at[1:], strict=True):
            ahead[:, then] = _log_sum(ahead[:, here][:, None] + rules[:, :, None], 0) + scores[:, then]
        behind[:] = rules[:, OUT][:, None]
        for here, then in zip(reversed(goes_on), reversed(at[1:]), strict=True):
            behind[:, here] = _log_sum(rules[:, :, None] + (scores[:, then] + behind[:, then])[None], 1)
        total = _log_sum(ahead[:, last] + behind[:, last], 0)[own]
        tag_p = np.exp(ahead + behind - total)
        came[:, later] = ahead[:, before]
        left = scores + behind - total
        move_p = np.array([[np.exp(came[a] + rules[a, b] + left[b]).sum() for b in range(3)] for a in range(3)])
        slope = np.stack([np.bincount(flat, np.tile(error, _FEATURES), 1 << FEATURE_BITS) for error in gold - tag_p]) / n - decay * weights
        slope_m = (gold_moves - move_p) / n - decay * moves
        seen_w, seen_m = seen_w + slope**2, seen_m + slope_m**2
        weights += 0.5 * slope / np.sqrt(seen_w)
        moves += 0.5 * slope_m / np.sqrt(seen_m)
    return FieldModel(np.ascontiguousarray(weights.T), moves)


def _tagged(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    secrets = _secret_parts(text, base_spans(text))
    for a, b in windows(text):
        tokens, features, allowed = sequence(text, a, b)
        tags = np.zeros(len(tokens), np.int64)
        for first, last in secrets:
            inside = False
            for k, (s, e) in enumerate(tokens):
                if s < last and e > first and allowed[k, IN if inside else BEGIN]:
                    tags[k], inside = (IN if inside else BEGIN), True
                elif inside:
                    break
        yield features, allowed, tags


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> FieldModel:
    """Fit the field on the windows of ``sample_docs`` documents at most.

    The sample is the rows with the smallest hash of their id and text among those with a run that could be a secret,
    equal rows once. Of their windows, cut into pieces of ``PIECE_TOKENS`` tokens, ``SAMPLE_PIECES`` at most reach the
    driver, those with the smallest hash; so neither a frequent id nor a very long text makes the sample grow. NULL
    texts have no windows, NULL ids are sampled like others, and an empty table gives a field that tags nothing.
    """
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("string").alias("_id"), text.alias("_text")).filter(text.rlike("[0-9][A-Za-z0-9+/_-]{5}|AKIA"))
    rows = rows.withColumn("_hash", F.xxhash64("_id", "_text"))
    picked = rows.select("_hash").distinct().orderBy("_hash").limit(sample_docs)
    chosen = rows.join(F.broadcast(picked), "_hash").groupBy("_hash").agg(F.first("_text").alias("_text")).select("_text")  # sample_docs rows

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[x[k : k + PIECE_TOKENS] for x in s] for text in batch.column(0).to_pylist() if text for s in _tagged(text) for k in range(0, len(s[2]), PIECE_TOKENS)]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes() for x in part], pa.binary()) for part in (zip(*out, strict=True) if out else ((), (), ()))], names=["features", "allowed", "tags"])

    pieces = chosen.mapInArrow(tag, "features binary, allowed binary, tags binary")
    rows = pieces.orderBy(F.xxhash64("features", "tags")).limit(SAMPLE_PIECES).toArrow()
    take = lambda name, shape: [np.frombuffer(x, "<i8").reshape(shape) for x in rows.column(name).to_pylist()]
    sequences = list(zip(take("features", (-1, _FEATURES)), [x.astype(bool) for x in take("allowed", (-1, 3))], take("tags", (-1,)), strict=True))
    order = sorted(range(len(sequences)), key=lambda k: (sequences[k][0].tobytes(), sequences[k][2].tobytes()))
    return fit([sequences[k] for k in order], steps)


class _Memo(dict):
    """A dictionary that computes what it lacks and forgets all when it is full."""

    def __init__(self, compute: Callable, most: int = 100_000) -> None:
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_FORMS = bytes.maketrans((_LETTERS + _LETTERS.upper() + _DIGITS).encode(), b"a" * 26 + b"A" * 26 + b"9" * 10)  # of UTF-8; other bytes stay
_STARTS = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{1,4}|[^\sA-Za-z0-9+/_-]")


class Screen:
    """What a token can gain at most by being tagged begin or inside, to pass over stretches where no secret can pay.

    The sum of the weights of a token's features is split into parts that depend on one token or two, which are kept, and
    two features (``file``, ``glued``) that are bounded by their greatest value. A stretch of which :meth:`may_hold` is
    false has only outside tags as its best tags, so decoding it in full would add nothing.
    """

    def __init__(self, model: FieldModel) -> None:
        gain = model.weights - model.weights[:, [OUT]]
        part = lambda name: gain[_hashed(name)]
        flags = (False, True)
        self.any = np.max([part(f"file={c}{d}{long}") for c in ("code", "prose") for d in range(11) for long in flags], axis=0)
        self.any = self.any + np.max([part(f"glued={g}{d}") for g in flags for d in flags], axis=0) + part("bias")
        m = model.moves + _RULES
        stay = m[OUT, OUT]
        self.any = self.any + [0, m[:, BEGIN].max() - stay + max(0.0, m[BEGIN:, OUT].max() - stay), m[BEGIN:, IN].max() - stay]
        self.one = _Memo(lambda token: token.lower() if len(token.lower()) == 1 else "*")
        self.own = _Memo(lambda token: sum(part(n) for n in _own_names(token)))
        self.back = _Memo(lambda one: part(f"back={one}"))
        self.back2 = _Memo(lambda pair: part(f"back2={pair[0]}{pair[1]}"))
        self.after = _Memo(lambda one: part(f"after={one}"))
        self.key = _Memo(lambda token: part(f"key={token.lower()}") if len(token.lower()) > 1 else part("key=^"))
        self.first_key = part("key=^")
        self.key_top = _Memo(lambda token: float(self.key[token][BEGIN:].max()))
        self.start = _Memo(lambda begin: float(part(f"start={begin}")[BEGIN:].max()))
        self.any_key = float(gain[:, BEGIN:].max())
        # Of a token's form (letters as a or A, digits as 9): its own features but its start and whether all of it is hex.
        named = lambda token: [n for n in _own_names(token) if not n.startswith(("hex=", "start="))]
        is_hex = lambda token: np.max([part(f"hex={x}{len(token) >= LEAST_HEX}") for x in flags], axis=0)
        self.form = _Memo(lambda token: sum(part(n) for n in named(token)) + is_hex(token))
        like = lambda one: {"a": _LETTERS, "9": _DIGITS}.get(one, one)
        self.form_back = _Memo(lambda one: np.max([self.back[x] for x in like(one)], axis=0))
        self.form_back2 = _Memo(lambda pair: np.max([self.back2[x, y] for x in like(pair[0]) for y in like(pair[1])], axis=0))
        self.form_after = _Memo(lambda one: np.max([self.after[x] for x in like(one)], axis=0))
        self.edges = _Memo(self._edges)
        self.pays = _Memo(lambda asked: self._pays(*asked), 400_000)

    def _gains(self, tokens: list[str], before: str, before2: str, after: str) -> np.ndarray:
        """Bounds by token and tag, without the feature ``key``, which looks back further."""
        ones = [self.one[t] for t in tokens]
        backs = [before, *ones[:-1]]
        backs2 = [before2, before, *ones[:-2]][: len(ones)]
        parts = (self.own[t] + self.back[b] + self.back2[c, b] + self.after[n] for t, b, c, n in zip(tokens, backs, backs2, [*ones[1:], after], strict=True))
        return np.array(list(parts)) + self.any

    @staticmethod
    def _best(tokens: list[str], gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.where([len(t) >= LEAST_TOKEN for t in tokens], gains[:, BEGIN], -np.inf)
        return begins, np.where([t in ".=~" or len(t) > 1 for t in tokens], np.maximum(gains[:, IN], 0), 0)

    def _edges(self, run: str) -> tuple[str, str, str | None]:
        """The first and last two tokens of a run without white space, as neighbours see them."""
        tokens = _TOKEN.findall(run)
        return self.one[tokens[0]], self.one[tokens[-1]], self.one[tokens[-2]] if len(tokens) > 1 else None

    def _pays(self, run: str, before: str, before2: str, after: str, more: int) -> bool:
        """Whether a secret of a run's form could pay beside such neighbours, if key and start give no more than ``more`` halves."""
        tokens = _TOKEN.findall(run)
        ones = [self.one[t] for t in tokens]
        backs = [before, *ones[:-1]]
        backs2 = [before2, before, *ones[:-2]][: len(ones)]
        parts = (self.form[t] + self.form_back[b] + self.form_back2[c, b] + self.form_after[n] for t, b, c, n in zip(tokens, backs, backs2, [*ones[1:], after], strict=True))
        begins, inside = self._best(tokens, np.array(list(parts)) + self.any + more / 2)
        return bool(begins.max() + inside.sum() > 0)

    def _top_start(self, runs: list[str]) -> float:
        """The greatest gain that the start of a token gives in runs that are long enough to hold a secret."""
        long = [run for run in runs if len(run) >= LEAST_TOKEN]
        plain = {run[:4] for run in long if run.isalnum() and run.isascii()}  # each is one token
        mixed = " ".join([run for run in long if not (run.isalnum() and run.isascii())])
        return max(map(self.start.__getitem__, plain.union(_STARTS.findall(mixed))))

    def _forms_pay(self, runs: list[str], edges: list[tuple[str, str, str | None]], more: float) -> bool:
        halves = max(0, math.ceil(2 * more))
        for k, run in enumerate(runs):
            if len(run) >= LEAST_TOKEN:
                _, before, before2 = edges[k - 1] if k else ("^", "^", None)
                if before2 is None:
                    before2 = edges[k - 2][1] if k > 1 else "^"
                if self.pays[run, before, before2, edges[k + 1][0] if k + 1 < len(edges) else "$", halves]:
                    return True
        return False

    def may_hold(self, text: str, a: int, b: int) -> bool:
        """Whether some tags other than outside could be best in a stretch that begins and ends beside white space.

        First by the forms of its runs without white space, which are few, so answers are kept, and by the greatest start
        of a token with any key; then with the keys that the stretch has; and last token by token.
        """
        stretch = text[a:b]
        runs = stretch.split()
        longest = max(map(len, runs), default=0)
        if longest < LEAST_TOKEN:
            return False
        if longest <= LONG_RUN:
            forms = stretch.encode("utf-8", "surrogatepass").translate(_FORMS).decode("utf-8", "surrogatepass").split()
            edges = [self.edges[form] for form in forms]
            start = self._top_start(runs)
            if not self._forms_pay(forms, edges, start + self.any_key):
                return False
            key = max(map(self.key_top.__getitem__, {*_TOKEN.findall(stretch), "^"}))
            if not self._forms_pay(forms, edges, start + key):
                return False
        return self._may_hold(text, a, b)

    def _may_hold(self, text: str, a: int, b: int) -> bool:
        found = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, a, b)]
        tokens = [t for *_, t in found]
        if not any(len(t) >= LEAST_TOKEN for t in tokens):
            return False
        first = np.tile(self.first_key, (len(tokens), 1))
        keys = np.concatenate([np.tile(self.first_key, (4, 1)), np.array([self.key[t] for t in tokens])])
        key = np.max([keys[k : k + len(tokens)] for k in range(4)] + [first], axis=0)
        begins, inside = self._best(tokens, self._gains(tokens, "^", "^", "$") + key)
        heads = [k for k, (s, _, _) in enumerate(found) if k == 0 or found[k - 1][1] != s]
        return bool((np.maximum.reduceat(begins, heads) + np.add.reduceat(inside, heads) > 0).any())


_SPACES = re.compile(r"\s")


def _gaps(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What lies between windows, in stretches of about ``GAP`` characters that do not cut a run without white space."""
    at = 0
    for a, b in [*taken, (len(text), len(text))]:
        while at < a:
            cut = _SPACES.search(text, min(a, at + GAP), a)
            yield at, cut.end() if cut else a
            at = cut.end() if cut else a
        at = b


def _whole_runs(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The windows, widened until they cut no run without white space, and joined where they then meet."""
    out: list[tuple[int, int]] = []
    for a, b in found:
        while a > 0 and not text[a - 1].isspace():
            if out and a <= out[-1][1]:
                break
            a -= 1
        cut = _SPACES.search(text, b) if b and not text[b - 1].isspace() else None
        b = cut.start() if cut else (b if b and text[b - 1].isspace() else len(text))
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def added_spans(text: str, base: list[tuple[int, int, str]], model: FieldModel) -> list[tuple[int, int, str]]:
    """Secrets that the field finds and no base span touches.

    All of the text is tagged: the windows, and the stretches between them unless :class:`Screen` shows that all their
    tokens are outside.
    """
    out = []
    opened = _whole_runs(text, windows(text))
    for a, b in sorted(opened + [gap for gap in _gaps(text, opened) if model.screen.may_hold(text, *gap)]):
        tokens, features, allowed = sequence(text, a, b)
        start = None
        for (s, e), tag in zip([*tokens, (0, 0)], [*viterbi(features, allowed, model), OUT], strict=True):
            if tag != IN and start is not None:
                out.append((start, end, "crf"))
                start = None
            if tag == BEGIN:
                start = s
            end = e
    return [x for x in out if not any(x[0] < e and s < x[1] for s, e, _ in base)]


_SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(df: DataFrame, model: FieldModel, *, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Add ``spans``: all base and found spans of each text by start and then kind (code points, end exclusive).

    A NULL or empty text has none; repeated rows get equal answers; an empty table gives no rows.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(FieldModel(model.weights, model.moves))  # a fixed number of weights; each worker keeps its own screen
    kept = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = kept.drop("_text").schema.add("spans", _SPANS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                base = base_spans(text) if text else []
                every = sorted(base + (added_spans(text, base, shared.value) if text else []), key=lambda x: (x[0], KINDS.index(x[2])))
                out.append([{"kind": k, "start": s, "end": e} for s, e, k in every])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(_SPAN))], names=[f.name for f in schema])

    bounded_batches(spark)
    return kept.mapInArrow(find, schema)
