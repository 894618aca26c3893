"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``WINDOW`` words.  Their TF-IDF vectors (document frequencies
counted over all documents; all words outside the benchmark share the weight of a word never
seen) are projected by a distributed randomised SVD: the workers multiply their sparse
passages with a thin random matrix and return sums, the driver orthogonalises.  The SVD is
fitted on the benchmark's passages and those of all documents, where each begins half a window
after the one before and the last holds the words that are left; every window of every document
is searched.

A window is a candidate for an item if its latent vector and that of a window of the item (one
at every word) have a cosine of ``COSINE`` at least.  Candidates are checked in place: the longest common subsequence of the item and the
text around the window must hold ``COMMON`` of the item's words, and half of the item's answer
words (its ``ANSWERS`` rarest) must stand there.

Windows are projected only where that check can pass: where half of an item's answer words
stand, and as many of its distinct words as a subsequence of ``COMMON`` takes.  Both follow
from the check, whatever the weights, so no candidate that would pass is left out.

The benchmark is worked through in blocks of ``BLOCK_ITEMS`` items, so that what is shipped
to the workers has a bound.

Defined cases: null and empty texts and items match nothing; items of fewer words than a
window have windows of their own length, and so have texts; rows of equal doc_id are judged one by one; rows
without doc_id are judged like any other; an empty table of documents or items finds nothing;
extra columns are ignored by ``leaks`` and passed on by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, map_batches, raw_texts, release, saved, small_batches

WINDOW = 12
RANK = 64
HALF = WINDOW // 2
#: Half windows that are multiplied at once, and words in a part of the sums.
HALVES, PART = 1_024, 256
BLOCK_ITEMS = 2000
COSINE = 0.6
COMMON = 0.6
ANSWERS = 5
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain(word: bytes) -> bytes:
    return word.strip(EDGE)


def split(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of ``a``."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & masks.get(x, 0)
        if u:
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Block:
    """Items of the benchmark, their vocabulary and, once fitted, their latent vectors."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int | None, list[int]]] = []
        for item, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            words = [p for w in split((text or "").encode()) if (p := plain(w))]
            if words:
                self.items.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))

    def lengths(self) -> list[int]:
        return sorted({min(WINDOW, len(w)) for _, w in self.items})

    def weigh(self, df: dict[int, int], n: int) -> None:
        found = np.array([df.get(k, 0) for k in range(len(self.vocabulary))], float)
        # the last place is that of all words outside the vocabulary
        self.idf = np.append(np.log((n + 1) / (found + 1)) + 1, np.log((n + 1) / 2) + 1)
        self.distinct = [set(w) for _, w in self.items]
        self.answers = [set(sorted(set(w), key=lambda k: (-self.idf[k], k))[:ANSWERS]) for _, w in self.items]

    def passages(self, ids: np.ndarray, length: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Windows of word ids (-1: outside) and the inverse of their TF-IDF norms."""
        if len(ids) < length:
            return np.zeros((0, length), np.int64), np.zeros(0)
        rows = np.lib.stride_tricks.sliding_window_view(ids, length)[::step]
        return rows, self.scale(rows)

    def scale(self, rows: np.ndarray) -> np.ndarray:
        """1 / norm of the weights summed by word; words outside are taken as all different (-2: no word)."""
        order = np.sort(rows, axis=1)
        w = self.idf[order] ** 2 * (order > -2)
        same = (order[:, 1:] == order[:, :-1]) & (order[:, 1:] >= 0)
        # (2w)**2 is 4w**2 where two are the same: each further one adds its products with those before
        run = np.zeros(order.shape)
        for k in range(1, order.shape[1]):
            run[:, k] = np.where(same[:, k - 1], run[:, k - 1] + 1, 0)
        return 1 / np.sqrt((w * (1 + 2 * run)).sum(axis=1))

    def times(self, rows: np.ndarray, scale: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Passages times a matrix with one row a word and a last row of zeros."""
        return (m[rows] * self.idf[rows][:, :, None]).sum(axis=1) * scale[:, None]

    def back(self, rows: np.ndarray, scale: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Transposed passages times ``y``."""
        out = np.zeros((len(self.idf), y.shape[1]))
        np.add.at(out, rows.reshape(-1), ((scale[:, None] * self.idf[rows])[:, :, None] * y[:, None, :]).reshape(-1, y.shape[1]))
        out[-1] = 0
        return out

    def finish(self, v: np.ndarray) -> None:
        """What a search takes: the latent vectors of each item's windows, and bounds on its words."""
        self.v = v.astype(np.float32)
        self.targets = []
        for _, words in self.items:
            length = min(WINDOW, len(words))
            rows, scale = self.passages(np.array(words, np.int64), length)
            z = self.times(rows, scale, v)
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            self.targets.append((length, np.ascontiguousarray(z.T.astype(np.float32)), np.arange(len(rows))))
        # answer words by item; the place after the vocabulary, never seen, fills up
        self.keys = np.full((len(self.items), ANSWERS), len(self.vocabulary))
        for row, words in zip(self.keys, self.answers, strict=True):
            row[: len(words)] = sorted(words)
        self.enough = np.array([(len(x) + 1) // 2 for x in self.answers])
        # each word that the subsequence lacks costs one distinct word at most
        self.least = [len(d) - (1 - COMMON) * len(w) - 1e-9 for d, (_, w) in zip(self.distinct, self.items, strict=True)]


class Finder:
    """Finds the items of a block in a text."""

    def __init__(self, block: Block):
        self.b = block
        self.known = block.vocabulary | {b"": -2}

    def ids(self, raw: bytes) -> np.ndarray:
        """The ids of the words of a text (-1: not in the vocabulary)."""
        words = split(raw)
        ids = np.fromiter(map(self.known.get, map(bytes.strip, words, repeat(EDGE)), repeat(-1)), np.int64, len(words))
        return ids[ids > -2]

    def __call__(self, raw: bytes) -> list[tuple[int | None, float, float, int]]:
        """What a text holds."""
        return self.search(self.ids(raw))

    def search(self, ids: np.ndarray) -> list[tuple[int | None, float, float, int]]:
        """(item_id, cosine, share of the item's words in common, answer words found)."""
        b = self.b
        seen = np.zeros(len(b.vocabulary) + 1, bool)
        seen[ids[ids >= 0]] = True
        out, at = [], None
        for k in np.flatnonzero(seen[b.keys].sum(axis=1) >= b.enough).tolist():
            if sum(map(seen.__getitem__, b.distinct[k])) < b.least[k]:
                continue
            if at is None:
                at = np.argsort(ids, kind="stable")
                in_order = ids[at]
            if good := self.check(k, ids, at, in_order):
                out.append(good)
        return out

    def cells(self, k: int, n: int, at: np.ndarray, in_order: np.ndarray) -> tuple[np.ndarray, int]:
        """Where item ``k`` may stand by its words, and the number of the first cell.

        A place belongs to the cell of its start; near ones share their surroundings.
        """
        b = self.b
        size, slack = len(b.items[k][1]), max(4, len(b.items[k][1]) // 3)
        length, _, offset = b.targets[k]
        length = min(length, n)
        first = -int(offset[-1]) // slack
        most = (n - length) // slack + 1 - first

        def standing(words: set[int]) -> np.ndarray:
            """How many of the words stand around each cell."""
            w = np.array(sorted(words))
            low, high = np.searchsorted(in_order, w), np.searchsorted(in_order, w, "right")
            p = np.concatenate([at[i:j] for i, j in zip(low, high, strict=True)])
            # a word at p stands around the cells i to j - 1
            i, j = (p - size) // slack - 1 - first, p // slack + 2 - first
            new = np.zeros(len(p) + 1, bool)
            new[np.cumsum(high - low) - (high - low)] = True
            # no cell counts a word twice
            i[1:] = np.where(new[1:-1], i[1:], np.maximum(i[1:], j[:-1]))
            i, j = np.clip(i, 0, most), np.clip(j, 0, most)
            return np.cumsum(np.bincount(i, minlength=most + 1) - np.bincount(j, minlength=most + 1))[:most]

        return (standing(b.answers[k]) >= b.enough[k]) & (standing(b.distinct[k]) >= b.least[k]), first

    def check(self, k: int, ids: np.ndarray, at: np.ndarray, in_order: np.ndarray) -> tuple[int | None, float, float, int] | None:
        b, n = self.b, len(ids)
        item, words = b.items[k]
        length, targets, offset = b.targets[k]
        length = min(length, n)
        slack = max(4, len(words) // 3)
        may, first = self.cells(k, n, at, in_order)
        cells = np.flatnonzero(may) + first
        if not len(cells):
            return None
        # windows whose place may be in such a cell
        edge = np.zeros(n - length + 2, np.int64)
        np.add.at(edge, np.clip(cells * slack, 0, n - length + 1), 1)
        np.add.at(edge, np.clip((cells + 1) * slack + offset[-1], 0, n - length + 1), -1)
        places: dict[int, tuple[float, int]] = {}
        windows = np.flatnonzero(np.cumsum(edge)[:-1])
        for m in range(0, len(windows), 4096):
            starts = windows[m : m + 4096]
            rows = ids[starts[:, None] + np.arange(length)]
            z = (b.v[rows] * b.idf[rows][:, :, None].astype(np.float32)).sum(axis=1)
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            cosine = z @ targets
            i, j = np.nonzero(cosine >= COSINE)
            start = starts[i] - offset[j]
            for c, s in zip((-cosine[i, j]).tolist(), start.tolist(), strict=True):
                cell = s // slack
                if may[cell - first] and (c, s) < places.get(cell, (2.0, 0)):
                    places[cell] = (c, s)
        good = None
        # every place is checked, the likeliest first
        for cell, (c, _) in sorted(places.items(), key=lambda p: p[1]):
            around = ids[max(0, cell * slack - slack) : (cell + 2) * slack + len(words)].tolist()
            share = common_length(words, around) / len(words)
            if share >= COMMON and (good is None or share > good[2]):
                good = (item, -c, share, len(b.answers[k] & set(around)))
                if share == 1:
                    break
        return good


def halves(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts in rows of half a window (-2: no word), and which rows begin a passage.

    A passage is a row and the next; a text of one row gets an empty one.
    """
    sizes = np.array([len(t) for t in texts if len(t)], np.int64)
    rows = np.maximum(2, -(-sizes // HALF))
    ends = np.cumsum(rows)
    words = np.full((int(rows.sum()), HALF), -2)
    if len(sizes):
        start = (ends - rows) * HALF
        words.reshape(-1)[np.arange(sizes.sum()) + np.repeat(start - np.cumsum(sizes) + sizes, sizes)] = np.concatenate([t for t in texts if len(t)])
    begins = np.ones(len(words), bool)
    begins[ends - 1] = False
    return words, begins


def add_product(block: Block, words: np.ndarray, begins: np.ndarray, weighted: np.ndarray, total: np.ndarray) -> None:
    """Adds the transposed passages times the passages times a matrix, less the last weighing by idf.

    ``weighted`` is the matrix times idf, with a last row of zeros.  Rows of half a window are
    summed once for the two passages that hold them.
    """
    for first in range(0, len(words) - 1, HALVES):
        part = words[first : first + HALVES + 1]
        here = begins[first : first + len(part) - 1]
        scale = np.zeros(len(here))
        scale[here] = block.scale(np.hstack([part[:-1][here], part[1:][here]])) ** 2
        known = np.where(part < 0, len(weighted) - 1, part)
        sums = weighted.take(known[:, 0], axis=0)
        for k in range(1, HALF):
            sums += weighted.take(known[:, k], axis=0)
        y = sums[:-1] + sums[1:]
        y *= scale[:, None]
        sums[:-1] = y
        sums[-1] = 0
        sums[1:] += y
        at = np.flatnonzero(part.reshape(-1) >= 0)
        if not len(at):
            continue
        w = part.reshape(-1)[at]
        order = np.argsort(w, kind="stable")
        new = np.flatnonzero(np.diff(w[order], prepend=-1))
        total[w[order[new]]] += np.add.reduceat(sums.take(at[order] // HALF, axis=0), new, axis=0)


def _numbered(docs: DataFrame, block: Block) -> DataFrame:
    """The words of each text by their numbers (-1: not in the vocabulary), written once for all passes."""
    kind = np.min_scalar_type(-len(block.vocabulary) - 1)

    def make():
        finder = Finder(block)
        return lambda batch: pa.record_batch([pa.array([finder.ids(raw).astype(kind).tobytes() for raw in raw_texts(batch)], pa.binary())], ["ids"])

    return saved(map_batches(docs.select("text"), "ids binary", make), "svd-words")


def _read(batch: pa.RecordBatch, block: Block) -> list[np.ndarray]:
    kind = np.min_scalar_type(-len(block.vocabulary) - 1)
    return [np.frombuffer(x, kind).astype(np.int64) for x in batch.column(0).to_pylist()]


def _frequencies(numbered: DataFrame, block: Block) -> tuple[dict[int, int], int]:
    """In how many documents each benchmark word is, and the number of documents."""
    small_batches(numbered.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(block.vocabulary) + 1, np.int64), 0
        for batch in batches:
            for ids in _read(batch, block):
                seen = np.zeros(len(count), bool)
                seen[ids] = True
                count += seen
                n += 1
        at = np.flatnonzero(count[:-1])
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(count[at], n))], ["term", "n"])

    # one row a benchmark word goes to the driver
    rows = numbered.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found, found.pop(-1, 0)


def _product(numbered: DataFrame, block: Block, q: np.ndarray) -> np.ndarray:
    """The transposed passages of all documents times the passages times ``q``."""
    m, rank = q.shape
    weighted = np.vstack([q * block.idf[:-1, None], np.zeros((1, rank))])
    small_batches(numbered.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, rank))
        for batch in batches:
            add_product(block, *halves(_read(batch, block)), weighted, total)
        total *= block.idf[:-1, None]
        task = TaskContext.get().partitionId()
        for k in range(0, m, PART):
            yield pa.record_batch([pa.array([k // PART]), pa.array([task]), pa.array([total[k : k + PART].tobytes()], pa.binary())], ["part", "task", "sums"])
        del total
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums[k] + np.frombuffer(x) if k in sums else np.frombuffer(x).copy()
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "sums"])

    each = numbered.mapInArrow(run, "part long, task long, sums binary")
    # the sums of a part meet in one task, in order of the tasks, so that rounding is always the same
    met = each.repartition(max(1, min(64, -(-m // PART))), "part").sortWithinPartitions("part", "task").select("part", "sums")
    out = np.zeros((m, rank))
    # one matrix of (benchmark words x rank) goes to the driver
    for r in met.mapInArrow(add, "part long, sums binary").collect():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.sums).reshape(-1, rank)
    return out


def _fit(numbered: DataFrame, block: Block, rank: int = RANK, rounds: int = 2, seed: int = 11) -> None:
    """Randomised SVD (subspace iteration) of the passages' TF-IDF matrix."""
    own = [block.passages(np.array(w, np.int64), min(WINDOW, len(w))) for _, w in block.items]
    m = len(block.vocabulary)
    rank = min(rank, m)
    rnd = np.random.default_rng(seed)
    q = np.linalg.qr(rnd.standard_normal((m, rank)))[0]

    def product(q: np.ndarray) -> np.ndarray:
        total, padded = _product(numbered, block, q), np.vstack([q, np.zeros((1, rank))])
        for rows, scale in own:
            total += block.back(rows, scale, block.times(rows, scale, padded))[:-1]
        return total

    for _ in range(rounds):
        before, z = q, product(q)
        q, r = np.linalg.qr(z)
    # Nystroem's formula: the values in that space, without one more pass
    inner = r @ np.linalg.pinv(before.T @ z, rcond=1e-12) @ r.T
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    v = q @ vectors[:, ::-1]
    block.finish(np.vstack([v, np.zeros((1, rank))]))
    block.singular = np.sqrt(np.maximum(values[::-1], 0))


def fitted_blocks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> Iterator[Block]:
    """The benchmark in fitted blocks, in order of item_id."""
    rows, held = benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator(), []
    for r in rows:
        held.append((r.item_id, r.text))
        if len(held) == block_items:
            yield _fitted(docs, held)
            held = []
    if held:
        yield _fitted(docs, held)


def _fitted(docs: DataFrame, items: list) -> Block:
    block = Block(items)
    if block.items:
        numbered = _numbered(docs, block)
        df, n = _frequencies(numbered, block)
        block.weigh(df, max(n, 1))
        _fit(numbered, block)
        discard(numbered)
    return block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document and item that it holds: doc_id, item_id, cosine, common, answers, contaminated."""
    schema = "doc_id long, item_id long, cosine double, common double, answers long, contaminated boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in fitted_blocks(docs, benchmark):

        def make(block=block):
            finder = Finder(block)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [(d, *x) for d, raw in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True) for x in finder(raw)]
                c = list(zip(*found, strict=True)) or [()] * 5
                return pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.int64()), pa.array([True] * len(found), pa.bool_())], ["doc_id", "item_id", "cosine", "common", "answers", "contaminated"])

            return run

        if block.items:
            out = out.unionByName(map_batches(docs.select("doc_id", "text"), schema, make))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that hold no item."""
    schema = docs.schema
    for block in fitted_blocks(docs, benchmark):

        def make(block=block):
            finder = Finder(block)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([not finder(raw) for raw in raw_texts(batch)], pa.bool_()))

            return run

        if block.items:
            docs = map_batches(docs, schema, make)
    return docs
