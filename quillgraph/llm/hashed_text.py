"""Hashed word and character n-grams of whole texts, and a logistic regression on them.

The features of a text are means over its words: of the hashed word, of the hashed pair of
neighbouring words, and of the hashed character n-grams of the word (its own mean).  The
score of a text is then a mean over words.

Texts are worked on by the column: Arrow splits them and numbers their words (``Words``), so
that what belongs to a word, as its hash and the score of its n-grams, is worked out once a
column and by numpy, and what belongs to a text is a sum over a stretch.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Hash slots of each of the three kinds.
SLOTS = 1 << 14
SIZE = 3 * SLOTS
GRAMS = (2, 3, 4)
_PAIR = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Multipliers of the characters of an n-gram, the first ones of each.
_GRAM = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


class Words:
    """The words of a column of texts: ``different`` (as a column; ``words`` as a list), ``which``
    (their numbers, in order) and ``offsets`` (where each text begins in ``which``)."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        self.different = coded.dictionary
        which, offsets = coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy() - split.offsets[0].as_py()
        nothing = pc.index(self.different, "").as_py()
        if nothing >= 0:  # at the ends of texts
            real = which != nothing
            which, offsets = which[real], np.append(0, np.cumsum(real))[offsets]
        self.which, self.offsets = which, offsets
        self.sizes = np.diff(offsets)

    @cached_property
    def words(self) -> list[bytes]:
        return self.different.cast(pa.binary()).to_pylist()

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By text: the sum of a value of each of its words, in their order."""
        out = np.zeros(len(self.sizes), values.dtype)
        there = self.sizes > 0
        if there.any():
            out[there] = np.add.reduceat(values, self.offsets[:-1][there])
        return out

    def texts(self, of_words: np.ndarray):
        """One array a text: a value of each word."""
        values, at = of_words[self.which], self.offsets.tolist()
        return (values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def gram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the character n-grams of whole words with marked ends: (slots, the place of each
    word's first, numbers of each word's)."""
    marked = [f"\x02{w.decode('utf-8', 'replace')}\x03" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    # places left in the word, its end mark included, from each character on
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    total = sum(np.maximum(0, size - n + 1) for n in GRAMS)
    first = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.int64)
    before = np.zeros(len(words), np.int64)
    of_word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    for n in GRAMS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            h += code[k : len(code) - n + 1 + k] * np.uint64(_GRAM[k])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(left[: len(h)] >= n)
        out[first[of_word[at]] + before[of_word[at]] + place[at]] = (h[at] >> np.uint64(40)).astype(np.int64) % SLOTS
        before += np.maximum(0, size - n + 1)
    return out, first, total


def pair_slots(h: np.ndarray) -> np.ndarray:
    return ((h[:-1] * np.uint64(_PAIR[0]) + h[1:] * np.uint64(_PAIR[1])) >> np.uint64(40)).astype(np.int64) % SLOTS


def word_slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % SLOTS


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text, for training."""
    w, out = Words(texts), []
    slots, first, total = gram_slots(w.words)
    for numbers in w.texts(np.arange(len(w.words))):
        n = len(numbers)
        if not n:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        h, x = w.hashes[numbers], np.zeros(SIZE)
        x[:SLOTS] = np.bincount(word_slots(h), minlength=SLOTS) / n
        if n > 1:
            x[SLOTS : 2 * SLOTS] = np.bincount(pair_slots(h), minlength=SLOTS) / n
        mine, times = np.unique(numbers, return_counts=True)
        size = total[mine]
        at = np.repeat(first[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        x[2 * SLOTS :] = np.bincount(slots[at], np.repeat(times / size, size), minlength=SLOTS) / n
        at = np.flatnonzero(x)
        out.append((at.astype(np.int32), x[at].astype(np.float32)))
    return out


class Scorer:
    """The linear score of each text of a column."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.w, self.bias = weights.astype(np.float64), bias

    def __call__(self, w: Words) -> np.ndarray:
        if not len(w.which):
            return np.full(len(w.sizes), self.bias)
        slots, first, total = gram_slots(w.words)
        chars = np.add.reduceat(self.w[2 * SLOTS + slots], first) / total
        value = (self.w[word_slots(w.hashes)] + chars)[w.which]
        pair = np.append(self.w[SLOTS + pair_slots(w.hashes[w.which])], 0.0)
        pair[w.offsets[1:][w.sizes > 0] - 1] = 0.0  # the last word of a text has no neighbour
        return self.bias + w.sums(value + pair) / np.maximum(w.sizes, 1)


class Rows:
    """Training rows in one sparse matrix, held by rows and by columns."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        sizes = np.array([len(i) for i, _ in rows], np.int64)
        self.full = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.full]
        self.at = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int32)
        self.x = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32)
        order = np.argsort(self.at, kind="stable")
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order]
        self.x_of_column = self.x[order]
        self.columns, self.column_starts = np.unique(self.at[order], return_index=True)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.full):
            out[self.full] = np.add.reduceat(self.x * w[self.at], self.starts)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(SIZE)
        if len(self.columns):
            out[self.columns] = np.add.reduceat(self.x_of_column * r[self.row], self.column_starts)
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: Rows, y: np.ndarray, use: np.ndarray, steps: int = 60, ridge: float = 1e-4, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic regression for (soft) labels by Adam; ``use`` weighs rows, classes weigh alike."""
    pos, neg = (use * y).sum(), (use * (1 - y)).sum()
    weight = use * (y / max(pos, 1e-9) + (1 - y) / max(neg, 1e-9)) / 2
    w, b = np.zeros(SIZE), 0.0
    m, v, mb, vb = np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0
    for t in range(1, steps + 1):
        r = weight * (sigmoid(rows.dot(w) + b) - y)
        g, gb = rows.back(r) + ridge * w / SIZE, r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (1 + 0.05 * t)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.1 * step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities (Newton steps, smoothed labels)."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        d, h = p - t, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(m, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def cross_fitted(rows: Rows, y: np.ndarray, fold: np.ndarray, folds: int = 2) -> tuple[np.ndarray, float, float, float]:
    """Weights and bias from all rows; slope and offset from scores of rows left out."""
    z = np.zeros(rows.n)
    for k in range(folds):
        w, b = fit(rows, y, (fold != k).astype(float))
        z[fold == k] = (rows.dot(w) + b)[fold == k]
    w, b = fit(rows, y, np.ones(rows.n))
    return w, b, *platt(z, y)
