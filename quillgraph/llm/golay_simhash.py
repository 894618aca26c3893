"""SimHash near-duplicates, their candidates found by Golay-code fuzzy hashing.

The perfect binary Golay code (23, 12, 7) puts each 23-bit word within three bits of
exactly one codeword.  The keys of a word are the codewords of all words at distance one
at most: one or up to six.  If two words differ in two bits, the word between them lies
within one bit of both, so they share a key.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  If two fingerprints
differ in four bits or fewer, then of the three pairs of segments one holds at most two of
these errors (each error lies in two pairs), so in both its segments the two share a key.
Each fingerprint thus gives, for each pair of segments, the products of their keys;
fingerprints with a common product are compared exactly.  No link is lost.

Equal fingerprints are one node.  Fingerprints of one key are not all paired: short runs
are compared neighbour by neighbour, longer ones are searched breadth-first, which gives
the edges of a spanning forest, no more than there are members.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and is
linked like any other; rows of equal doc_id are one node in effect; a null doc_id never is
a component's name unless all its members have none; an empty table gives no rows; columns
other than doc_id and text are ignored (``representatives`` passes them on, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import joined_by_id, map_batches, raw_texts, saved, small_batches
from quillgraph.llm.components import components

BITS = 4
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Runs of one key up to this length are compared pair by pair.
SHORT = 8
GENERATOR = 0b101011100011


def fingerprint(raw: bytes, words: int = 4, seed: int = 42) -> int:
    w = raw.lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(w) - words + 1
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if n > 0 else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(n, 1))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


class Golay:
    """Decoding by syndrome: the remainder names the error of weight three at most."""

    def __init__(self) -> None:
        def rest(x: int) -> int:
            for k in range(22, 10, -1):
                if x >> k & 1:
                    x ^= GENERATOR << (k - 11)
            return x

        of_bit = [rest(1 << k) for k in range(23)]
        self.low, self.high = np.zeros(4096, np.int32), np.zeros(2048, np.int32)
        for k in range(12):
            self.low[np.arange(4096) >> k & 1 == 1] ^= of_bit[k]
        for k in range(11):
            self.high[np.arange(2048) >> k & 1 == 1] ^= of_bit[12 + k]
        self.error = np.zeros(2048, np.int32)
        for a in range(-1, 23):
            for b in range(a if a < 0 else a + 1, 23):
                for c in range(b if b < 0 else b + 1, 23):
                    flips = [k for k in (a, b, c) if k >= 0]
                    s = e = 0
                    for k in flips:
                        s, e = s ^ of_bit[k], e ^ 1 << k
                    self.error[s] = e

    def decode(self, words: np.ndarray) -> np.ndarray:
        """Index (12 bits) of the codeword within distance three."""
        return (words ^ self.error[self.low[words & 4095] ^ self.high[words >> 12]]) >> 11

    def keys(self, words: np.ndarray, width: int) -> np.ndarray:
        """(n, 6): the distinct codewords around each word; -1 where there are fewer."""
        near = np.concatenate([np.zeros(1, np.int32), 1 << np.arange(width, dtype=np.int32)])
        found = np.sort(self.decode(words[:, None] ^ near[None, :]), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        out = np.full((len(words), 6), -1, np.int32)
        row, col = np.nonzero(first)
        out[row, (np.cumsum(first, axis=1) - 1)[row, col]] = found[row, col]
        return out


def fuzzy_keys(golay: Golay, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (26 bits) and the fingerprints that they belong to."""
    of = [golay.keys((prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int32), width) for low, width in SEGMENTS]
    keys, owners = [], []
    for k, (i, j) in enumerate(PAIRS):
        a, b = np.broadcast_to(of[i][:, :, None], (len(prints), 6, 6)), np.broadcast_to(of[j][:, None, :], (len(prints), 6, 6))
        there = (a >= 0) & (b >= 0)
        keys.append((k << 24 | a << 12 | b)[there])
        owners.append(np.broadcast_to(prints[:, None, None], there.shape)[there])
    return np.concatenate(keys).astype(np.int32), np.concatenate(owners)


def forest(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the fingerprints that differ in so many bits at most."""
    left, a, b = prints, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                todo += list(found)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (prints[:0], prints[:0])


def links(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among the fingerprints of each key; rows are sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    short = np.repeat(sizes <= SHORT, sizes)
    for d in range(1, SHORT):
        i = np.flatnonzero(short[:-d] & (keys[d:] == keys[:-d])) if d < len(keys) else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[np.bitwise_count(prints[i] ^ prints[i + d]) <= bits]
        a.append(prints[i])
        b.append(prints[i + d])
    for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
        x, y = forest(np.unique(prints[s : s + n]), bits)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (prints[:0], prints[:0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer)."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in raw_texts(batch)], np.uint64).view(np.int64)
            return pa.record_batch([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

        return run

    return map_batches(docs.select("doc_id", "text"), "doc_id long, fp long", make)


def near_edges(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: edges that connect all fingerprints (column fp, distinct) linked by so few bits."""
    if bits > 4:
        raise ValueError("the segments are made for four bits at most")
    small_batches(prints.sparkSession, 4096)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                keys, owners = fuzzy_keys(golay, batch.column(0).slice(k, 512).to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.record_batch([pa.array(keys), pa.array(owners.view(np.int64))], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x):
            return pa.record_batch([pa.array(x[0].view(np.int64)), pa.array(x[1].view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows < 200_000 or held[0][0][0] == held[-1][0][-1]:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            yield out(links(keys[:cut], fps[:cut], bits))
            held, rows = [(keys[cut:], fps[cut:])], len(keys) - cut
        if rows:
            yield out(links(*(np.concatenate(x) for x in zip(*held, strict=True)), bits))

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.select("fp").mapInArrow(emit, "key int, fp long")
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that links reach)."""
    of = saved(fingerprints(docs), "fingerprints")
    nodes = saved(of.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = components(near_edges(nodes.repartition(n), bits))
    named = nodes.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "label").select("fp", "component_id")
    return of.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Up to so many doc_ids are broadcast (counted); beyond that the join shuffles.
FEW_IDS = 500_000


def representatives(docs: DataFrame, bits: int = BITS, few: int = FEW_IDS) -> DataFrame:
    """The documents, all columns, without those that have a near copy of smaller doc_id.

    Rows that share a doc_id stay or go together; rows without doc_id stay.
    """
    gone = saved(near_duplicates(docs, bits).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return joined_by_id(docs, gone, "left_anti", few)
