"""Boosted trees for the logistic loss, and isotonic calibration: of arrays, or of tables by passes.

``Trees.fit`` and ``isotonic`` take arrays.  ``fit_halves`` and ``isotonic_table`` do the same
for a table of any size: its rows are binned and written once; a pass of histograms a level
sends the driver sums by node, feature and bin, and neighbours in order of score are pooled in
each range of scores before the driver pools what is left.  Bin edges of a table are
``percentile_approx`` over all rows, to 1/10,000 of them in rank.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, saved, small_batches

#: Rows in a chunk of the binned table, and rounds after which scores so far are written.
CHUNK, FOLD = 8_192, 10
TAIL = (0.25, 0.5, 0.75)


def splits(sums: np.ndarray, least: float) -> list[tuple[int, int] | None]:
    """The best (feature, last bin on the left) of each node, from sums (g and h, nodes, features, bins)."""
    left = sums.cumsum(3)
    total, left = left[..., -1:], left[..., :-1]
    (lg, lh), (rg, rh), (tg, th) = left, total - left, total
    gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - tg**2 / (th + 1)
    gain[(lh < least) | (rh < least)] = -1
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(1)
    return [divmod(int(a), gain.shape[2]) if flat[k, a] > 1e-6 else None for k, a in enumerate(at)]


def histograms(bins: np.ndarray, node: np.ndarray, count: int, wide: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of g and h by node, feature and bin; ``bins`` is features x rows."""
    out = np.zeros((2, count, len(bins), wide))
    for f, b in enumerate(bins):
        key = node * wide + b
        out[0, :, f] = np.bincount(key, g, count * wide).reshape(count, wide)
        out[1, :, f] = np.bincount(key, h, count * wide).reshape(count, wide)
    return out


class Trees:
    """Boosted trees for the logistic loss; splits on quantile bins; levels grown as wholes."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def begin(self, mean: float) -> None:
        p = float(np.clip(mean, 1e-3, 1 - 1e-3))
        self.base = float(np.log(p / (1 - p)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.begin(y.mean())
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # rare hits vanish in quantiles: the values above the last edge get a few of their own
        self.edges = [np.unique(np.concatenate([e, np.quantile(c[c > e[-1]], [0, *TAIL])])) if (c > e[-1]).any() else e for e, c in zip(self.edges, x.T, strict=True)]
        # an edge is the least value that goes right
        binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)])
        wide = max(len(e) for e in self.edges) + 1
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            inner = (1 << self.depth) - 1
            feature, edge = np.full(inner, -1), np.zeros(inner)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                local = node - first
                right = np.zeros(len(y), bool)
                for k, c in enumerate(splits(histograms(binned, local, count, wide, g, h), self.least)):
                    if c:
                        feature[first + k], edge[first + k] = c[0], self.edges[c[0]][c[1]]
                        right |= (local == k) & (binned[c[0]] > c[1])
                node = 2 * node + 1 + right
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + 1)
            self.trees.append((feature, edge, value))
            z += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, edge, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] >= edge[node]))
            z += value[node - len(feature)]
        return z


def pooled(blocks: Iterable[list[float]]) -> list[list[float]]:
    """Pool adjacent violators: blocks of [sum of y, rows, least score, greatest score] in order of score."""
    out: list[list[float]] = []
    for block in blocks:
        out.append(list(block))
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            b = out.pop()
            out[-1] = [out[-1][0] + b[0], out[-1][1] + b[1], out[-1][2], b[3]]
    return out


def by_score(z: np.ndarray, y: np.ndarray) -> list[list[float]]:
    """One block a score."""
    score, at = np.unique(z, return_inverse=True)
    return np.column_stack([np.bincount(at, y, len(score)), np.bincount(at, minlength=len(score)), score, score]).tolist()


def steps(blocks: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Scores and non-decreasing probabilities, to interpolate between."""
    at, p = [], []
    for t, n, low, high in blocks:
        q = (t + 0.05) / (n + 0.1)
        at += [low, high] if high > low else [low]
        p += [q, q] if high > low else [q]
    return np.array(at), np.maximum.accumulate(np.array(p))


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return steps(pooled(by_score(z, y)))


def isotonic_table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``isotonic`` of a table (z, y): pooled in ranges of z first, which leaves the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[float]] = []
        last: list[list[float]] = []  # of the greatest score, which the next batch may go on with
        for batch in batches:
            new = by_score(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if last and new and new[0][2] == last[0][2]:
                new[0] = [new[0][0] + last[0][0], new[0][1] + last[0][1], new[0][2], new[0][3]]
                last = []
            held, last = pooled([*held, *last, *new[:-1]]), new[-1:] or last
        c = list(zip(*pooled([*held, *last]), strict=True)) or [()] * 4
        yield pa.record_batch([pa.array(x, pa.float64()) for x in c], ["t", "n", "low", "high"])

    small_batches(rows.sparkSession, CHUNK)
    each = rows.select("z", "y").repartitionByRange("z").sortWithinPartitions("z")
    return steps(pooled(sorted(([*r] for r in each.mapInArrow(run, "t double, n double, low double, high double").collect()), key=lambda b: b[2])))


def _edges(rows: DataFrame, names: list[str], bins: int) -> list[list[np.ndarray]]:
    """Bin edges of each feature for the rows of half 0, of half 1, and all, as in ``Trees.fit``."""
    mine = [F.col("half") == 0, F.col("half") == 1, F.lit(True)]
    at = [float(q) for q in np.linspace(0, 1, bins + 1)[1:-1]]
    every = [(k, c) for k in range(3) for c in names]
    low = rows.agg(*(F.percentile_approx(F.when(mine[k], F.col(c)), at, 10_000) for k, c in every)).first()
    edges = [np.unique(e) for e in low]
    above = [F.when(mine[k] & (F.col(c) > float(e[-1])), F.col(c)) for (k, c), e in zip(every, edges, strict=True)]
    high = rows.agg(*(F.percentile_approx(x, list(TAIL), 10_000) for x in above), *(F.min(x) for x in above)).first()
    for j, (tail, least) in enumerate(zip(high[: len(every)], high[len(every) :], strict=True)):
        if least is not None:
            edges[j] = np.unique([*edges[j], least, *tail])
    return [edges[k * len(names) : (k + 1) * len(names)] for k in range(3)]


def _leaf(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after ``depth`` levels; a row goes right where its bin is beyond the cut."""
    node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(depth):
        f = feature[node]
        node = 2 * node + 1 + ((f >= 0) & (bins[np.maximum(f, 0), rows] > cut[node]))
    return node


BINNED = "model long, y binary, bins binary, z binary"


def _chunks(batches: Iterator[pa.RecordBatch], n_features: int, recent: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """model, y, bins and scores after the ``recent`` trees."""
    for batch in batches:
        for model, y, bins, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b, z = np.frombuffer(bins, np.uint8).reshape(n_features, -1), np.frombuffer(z).copy()
            for feature, cut, value in recent[model]:
                z += value[_leaf(b, feature, cut, len(value).bit_length() - 1) - len(feature)]
            yield model, np.frombuffer(y, np.uint8).astype(float), b, z


def fit_halves(rows: DataFrame, names: list[str], means: list[float]) -> list[Trees]:
    """Trees of the rows of half 0, of half 1, and of all; ``rows`` has y, half and the features.

    All three grow in the same passes: one a level.
    """
    models = [Trees() for _ in means]
    edges = _edges(rows, names, models[0].bins)
    for t, e, mean in zip(models, edges, means, strict=True):
        t.edges = e
        t.begin(mean)
    base, depth, least, wide = [t.base for t in models], models[0].depth, models[0].least, 1 + max(len(x) for e in edges for x in e)
    inner, n_features = (1 << depth) - 1, len(names)

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, half, *x = (c.to_numpy() for c in batch.columns)
            found = []
            for k, mine in enumerate((half == 0, half == 1, half >= 0)):
                if mine.any():
                    bins = np.stack([np.searchsorted(e, c[mine], "right") for e, c in zip(edges[k], x, strict=True)])
                    found.append((k, y[mine].astype(np.uint8).tobytes(), bins.astype(np.uint8).tobytes(), np.full(int(mine.sum()), base[k]).tobytes()))
            c = list(zip(*found, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c[0], pa.int64()), *(pa.array(v, pa.binary()) for v in c[1:])], ["model", "y", "bins", "z"])

    small_batches(rows.sparkSession, CHUNK)
    table = saved(rows.select("y", "half", *names).mapInArrow(bin_rows, BINNED), "tree-rows")
    small_batches(rows.sparkSession, 64)  # of chunks
    recent: list[list] = [[] for _ in models]
    for done in range(models[0].rounds):
        feature, cut = np.full((3, inner), -1), np.zeros((3, inner), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level

            def sums(batches: Iterator[pa.RecordBatch], level=level, first=first, count=count, feature=feature, cut=cut, recent=recent) -> Iterator[pa.RecordBatch]:
                out = np.zeros((3, 2, count, n_features, wide))
                for k, y, bins, z in _chunks(batches, n_features, recent):
                    q = 1 / (1 + np.exp(-z))
                    out[k] += histograms(bins, _leaf(bins, feature[k], cut[k], level) - first, count, wide, y - q, q * (1 - q))
                yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], ["sums"])

            # sums by node, feature and bin go to the driver
            total = sum(np.frombuffer(r.sums).reshape(3, 2, count, n_features, wide) for r in table.mapInArrow(sums, "sums binary").collect())
            for k in range(3):
                for node, c in enumerate(splits(total[k], least)):
                    if c:
                        feature[k, first + node], cut[k, first + node] = c
        for k, t in enumerate(models):
            # the leaves' sums are those of the last level's bins on either side of the cut
            leaves = np.zeros((2, 1 << depth))
            for node in range(count):
                f, c = feature[k, first + node], cut[k, first + node]
                both = total[k][:, node, max(f, 0)]
                leaves[:, 2 * node] = both[:, : c + 1].sum(1) if f >= 0 else both.sum(1)
                leaves[:, 2 * node + 1] = both[:, c + 1 :].sum(1) if f >= 0 else 0
            value = t.rate * leaves[0] / (leaves[1] + 1)
            t.trees.append((feature[k], np.array([edges[k][f][c] if f >= 0 else 0.0 for f, c in zip(feature[k], cut[k], strict=True)]), value))
            recent[k].append((feature[k], cut[k], value))
        if (done + 1) % FOLD == 0 and done + 1 < models[0].rounds:

            def fold(batches: Iterator[pa.RecordBatch], recent=recent) -> Iterator[pa.RecordBatch]:
                for k, y, bins, z in _chunks(batches, n_features, recent):
                    yield pa.record_batch([pa.array([k]), *(pa.array([v], pa.binary()) for v in (y.astype(np.uint8).tobytes(), bins.tobytes(), z.tobytes()))], ["model", "y", "bins", "z"])

            before, table, recent = table, saved(table.mapInArrow(fold, BINNED), "tree-rows"), [[] for _ in models]
            discard(before)
    discard(table)
    return models
