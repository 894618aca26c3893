"""Substring dedup by level-wise doubling.

A window of ``length`` words can only repeat if the half-length windows in it repeat.  So
half-length windows are looked at first, and of those only one in each stretch of
neighbours: the one of least hash (equal windows choose alike), a quarter of them in all.
Anchors found in one document alone end there; windows around repeated ones are extended to
(about) twice the length and compared again.  ``longest_repeats`` goes on doubling from
there until no candidates survive.

Windows are compared by 48 bits (anchors, a sieve) and twice 56 bits (windows that decide) of
polynomial hashes of the words' XXH64, not word by word: at 10**15 windows the chance that any
two different ones agree is about 10**-4.  Texts with repeated anchors wait in files of the
shared folder, one a bucket of documents, so that they are shuffled once; there are as many
buckets as shuffle partitions, or more for a large input (one for each ``BUCKET_BYTES``).
Hashes travel in packed blocks, one a task and bucket; before that each task settles what repeats within itself and sends each hash once, with its least
document, so that a passage in a third of all documents is no large group anywhere.

Defined cases: null and empty texts have no words; rows of equal doc_id do not remove words
from each other; rows without doc_id are kept whole and remove nothing (they are dealt out by
their text); an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import new_path, open_shared, raw_texts, saved, small_batches

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Windows that a task gathers before it sends blocks.
GATHER = 1_000_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the window at each place (modulo 2**64), mixed."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor, m = np.zeros(n, np.uint64), 1, _MULTIPLIERS[which]
    for k in range(length):
        out += words[k : k + n] * np.uint64(factor)
        factor = factor * m % 2**64
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def anchors(halves: np.ndarray, span: int) -> np.ndarray:
    """Places of the (first) least of each ``span`` neighbours."""
    n = len(halves) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(halves, span)
    return np.unique(np.arange(n) + view.argmin(axis=1))


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of equal length and so many low bytes of each value; bytes are put in planes.

    Columns of fewer than eight bytes are kept as they are, others as differences.
    """
    parts = []
    for c, size in columns:
        d = np.ascontiguousarray(c).view(np.int64)
        d = np.diff(d, prepend=np.int64(0)) if size == 8 else d
        parts.append(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes, n: int, *sizes: int) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for size in sizes:
        d = np.zeros((n, 8), np.uint8)
        d[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        at += n * size
        d = d.view(np.int64).reshape(-1)
        out.append(np.cumsum(d) if size == 8 else d)
    return out


#: Bytes of: first hash, second hash, document, place, mark.  Anchors are only a sieve, so
#: 48 bits do for them; windows that decide have 112.
_SIEVE, _DECIDE = (6, 0, 8, 8, 1), (7, 7, 8, 8, 1)


class _Sender:
    """Gathers (hash, second hash, doc, place) and emits blocks by bucket.

    Of equal hashes in what was gathered, the record of the least doc_id is sent; of others
    with a larger doc_id it is known at once that they repeat, and ``settled`` gets them.
    """

    def __init__(self, buckets: int, both: bool, anchors_only: bool):
        self.buckets, self.both, self.held, self.n = buckets, both, [], 0
        self.sizes = _SIEVE if anchors_only else _DECIDE

    def add(self, first: np.ndarray, second: np.ndarray, doc: int, places: np.ndarray) -> None:
        if len(first):
            first = first & np.uint64((1 << 8 * self.sizes[0]) - 1)
            self.held.append((first, second, np.full(len(first), doc, np.int64), places.astype(np.int64)))
            self.n += len(first)

    def flush(self) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
        none = np.zeros(0, np.int64)
        if not self.held:
            return [], (none, none)
        h, g, doc, at = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.lexsort((doc, g, h))
        h, g, doc, at = h[order], g[order], doc[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(new) - 1
        least = doc[new][group]
        more = doc > least
        if self.both:
            # anchors: the least document's own record repeats too, if another has it
            shared = np.zeros(int(group[-1]) + 1, bool)
            shared[group[more]] = True
            settled = shared[group]
        else:
            settled = more
        # one record a hash goes on, all of the least document's places if not settled
        send = (doc == least) & (new | ~settled)
        mark = settled.astype(np.int64)
        bucket = (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % self.buckets
        h, g, doc_s, at_s, mark, bucket = h[send], g[send], doc[send], at[send], mark[send], bucket[send]
        by = np.lexsort((at_s, doc_s, bucket))
        cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        blocks = []
        for s, e in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
            k = by[s:e]
            blocks.append((int(bucket[k[0]]), len(k), _pack(*zip((h[k], g[k], doc_s[k], at_s[k], mark[k]), self.sizes, strict=True))))
        return blocks, (doc[settled], at[settled])


def _doc_blocks(doc: np.ndarray, at: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """(doc, place) in blocks by the bucket of the document."""
    if not len(doc):
        return []
    bucket = _doc_bucket(doc, buckets)
    order = np.lexsort((at, doc, bucket))
    bucket, doc, at = bucket[order], doc[order], at[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    bucket, doc, at = bucket[keep], doc[keep], at[keep]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[s]), e - s, _pack((doc[s:e], 8), (at[s:e], 8))) for s, e in zip(cuts, np.append(cuts[1:], len(doc)), strict=True)]


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    """As ``pmod(doc_id, buckets)``; ``buckets`` is prime, so that steps in doc_id do no harm.

    There are about as many buckets as partitions, each dealt to the partition of its number:
    a task sends one block to each, however many there are of either.
    """
    return np.mod(doc, buckets)


#: Bytes of the input for one bucket, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 50_000


def _buckets(docs: DataFrame) -> int:
    """Shuffle partitions, or more where the input (by the optimiser's estimate) is large."""
    size = int(docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # beyond that it is a guess for want of statistics
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-known // BUCKET_BYTES)))


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


_BLOCK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("block", pa.binary())])
_BLOCK_DDL = "kind int, bucket int, n int, block binary"
_HASHES, _PLACES = 0, 1


def _rows(kind: int, blocks: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind] * len(blocks), pa.int32()), pa.array([b[0] for b in blocks], pa.int32()), pa.array([int(b[1]) for b in blocks], pa.int32()), pa.array([b[2] for b in blocks], pa.binary())], schema=_BLOCK)


def _send(df: DataFrame, windows, buckets: int, both: bool, anchors_only: bool = False) -> DataFrame:
    """Blocks of the windows that ``windows(batch)`` yields as (doc, first, second, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, both, anchors_only)

        def out():
            blocks, (doc, at) = sender.flush()
            if blocks:
                yield _rows(_HASHES, blocks)
            if len(doc):
                yield _rows(_PLACES, _doc_blocks(doc, at, buckets))

        for batch in batches:
            for doc, first, second, places in windows(batch):
                sender.add(first, second, doc, places)
                if sender.n >= GATHER:
                    yield from out()
        yield from out()

    return df.mapInArrow(run, _BLOCK_DDL)


def _repeated(sent: DataFrame, n: int, both: bool, anchors_only: bool = False) -> DataFrame:
    """Blocks of places: those settled before, and those that the hashes of other tasks settle."""

    def settle(blocks: list) -> list[tuple[int, int, bytes]]:
        h, g, doc, at, mark = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.lexsort((doc, g, h))
        h, g, doc, at, mark = h[order], g[order], doc[order], at[order], mark[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(new) - 1
        hit = doc > doc[new][group]
        if both:
            known = np.zeros(int(group[-1]) + 1, bool)
            known[group[hit | (mark > 0)]] = True
            hit = known[group]
        return _doc_blocks(doc[hit], at[hit], buckets)

    buckets, sizes = _prime(n), _SIEVE if anchors_only else _DECIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            hashes = np.asarray(batch.column(0)) == _HASHES
            if not hashes.all():
                yield batch.filter(pa.array(~hashes))
                batch = batch.filter(pa.array(hashes))
            for bucket, k, block in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                if held and bucket != last:
                    yield _rows(_PLACES, settle(held))
                    held = []
                last = bucket
                held.append(_unpack(block, k, *sizes))
        if held:
            yield _rows(_PLACES, settle(held))

    return sent.repartitionById(n, F.col("bucket")).sortWithinPartitions("kind", "bucket").mapInArrow(run, _BLOCK_DDL)


def _table(held: list) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((at, doc))
    return doc[order], at[order]


def _places_of(table: tuple[np.ndarray, np.ndarray], doc: int | None) -> np.ndarray:
    if doc is None:
        return table[1][:0]
    a, b = np.searchsorted(table[0], doc), np.searchsorted(table[0], doc, "right")
    return np.unique(table[1][a:b])


def _around(places: np.ndarray, reach: int, n: int) -> np.ndarray:
    """Window starts from ``reach`` before each place up to it, within 0..n-1."""
    found = (places[:, None] - np.arange(reach + 1)[None, :]).reshape(-1)
    return np.unique(found[(found >= 0) & (found < n)])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


# --- a level: rows of documents that are done, and files that hold the others by bucket

_RECORD = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string()), ("text", pa.binary()), ("places", pa.binary())])
_LEVEL = pa.schema([("done", pa.bool_()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("sha256", pa.string()), ("bucket", pa.int32()), ("path", pa.string())])
_LEVEL_DDL = "done boolean, doc_id long, n_words long, n_removed long, sha256 string, bucket int, path string"


def _done(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    none = [None] * len(rows)
    return pa.record_batch([pa.array(x, f.type) for x, f in zip([[True] * len(rows), *c, none, none], _LEVEL, strict=True)], schema=_LEVEL)


class _Files:
    """Writes records to a file a bucket (Arrow stream, zstandard); a repeated task has other names."""

    def __init__(self, root: str):
        self.root, self.at, self.sink, self.writer, self.held, self.size = root, None, None, None, [], 0
        self.fs, self.folder = open_shared(root)
        self.fs.create_dir(self.folder, recursive=True)

    def add(self, bucket: int, record: tuple) -> Iterator[pa.RecordBatch]:
        if bucket != self.at:
            yield from self.close()
            self.at, self.name = bucket, f"{bucket:07d}-{uuid.uuid4().hex}"
            self.sink = self.fs.open_output_stream(f"{self.folder}/{self.name}")
            self.writer = pa.ipc.new_stream(self.sink, _RECORD, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3)))
        self.held.append(record)
        self.size += len(record[3])
        if self.size > 4_000_000:
            self._write()

    def _write(self) -> None:
        if self.held:
            self.writer.write_batch(pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*self.held, strict=True), _RECORD, strict=True)], schema=_RECORD))
            self.held, self.size = [], 0

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.writer is not None:
            self._write()
            self.writer.close()
            self.sink.close()
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip([False, None, None, None, None, self.at, f"{self.root}/{self.name}"], _LEVEL, strict=True)], schema=_LEVEL)
            self.writer = None


def _records(path: str) -> Iterator[tuple]:
    fs, at = open_shared(path)
    with fs.open_input_stream(at) as f, pa.ipc.open_stream(f) as stream:
        for batch in stream:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _half_level(docs: DataFrame, length: int, n: int) -> DataFrame:
    """Documents without repeated half-length anchors are done; the others go to files with the anchors' places."""
    half = (length + 1) // 2
    span = length - half + 1
    docs = docs.select("doc_id", "text")
    out = new_path(docs.sparkSession, "repeats")

    def windows(batch: pa.RecordBatch):
        for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
            h = window_hashes(word_hashes(raw.split()), half)
            at = anchors(h, span)
            yield doc, h[at], np.zeros(len(at), np.int64), at

    sent = _send(docs.where("doc_id is not null"), windows, _prime(n), True, anchors_only=True)
    places = _repeated(sent, n, True, anchors_only=True)
    bucket = F.coalesce(F.pmod("doc_id", F.lit(_prime(n))), F.pmod(F.xxhash64("text"), F.lit(_prime(n)))).cast("int")
    text_rows = docs.select(F.lit(_PLACES + 1).alias("kind"), bucket.alias("bucket"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("block"), "doc_id", "text")
    place_rows = places.select("kind", "bucket", "n", "block", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last, held, table = _Files(out), None, [], _table([])
        for batch in batches:
            rows, done = zip(*(c.to_pylist() for c in batch.columns[:5]), raw_texts(batch), strict=True), []
            for kind, bucket, k, block, doc, raw in rows:
                if bucket != last:
                    last, held, table = bucket, [], None
                if kind == _PLACES:
                    held.append(_unpack(block, k, 8, 8))
                    continue
                if table is None:
                    table, held = _table(held), []
                words, found = raw.split(), _places_of(table, doc)
                if len(found):
                    yield from files.add(bucket, (doc, len(words), _digest(words), raw, found.astype("<i4").tobytes()))
                else:
                    done.append((doc, len(words), 0, _digest(words)))
            if done:
                yield _done(done)
        yield from files.close()

    met = place_rows.unionByName(text_rows).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    return saved(met.mapInArrow(run, _LEVEL_DDL), "level")


def _send_longer(level: DataFrame, length: int, reach: int, n: int, both: bool) -> DataFrame:
    """Windows of the length around the places of a level."""

    def windows(batch: pa.RecordBatch):
        for path in batch.column(0).to_pylist():
            for doc, _, _, raw, places in _records(path):
                words = word_hashes(raw.split())
                at = _around(np.frombuffer(places, "<i4").astype(np.int64), reach, len(words) - length + 1)
                if len(at):
                    second = (window_hashes(words, length, 1)[at] >> np.uint64(8)).astype(np.int64)
                    yield doc, window_hashes(words, length)[at], second, at

    return _send(level.where("not done").select("path", "bucket").repartitionById(n, F.col("bucket")), windows, _prime(n), both)


def _on_files(level: DataFrame, places: DataFrame, n: int, each, schema: str, finish=None) -> DataFrame:
    """``each(record, places)`` over a level's files met with new places, bucket by bucket."""
    file_rows = level.where("not done").select(F.lit(_PLACES + 1).alias("kind"), "bucket", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("block"), "path")
    place_rows = places.select("kind", "bucket", "n", "block", F.lit(None).cast("string").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, f = None, [], each()
        for batch in batches:
            for kind, bucket, k, block, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last:
                    last, held = bucket, []
                if kind == _PLACES:
                    held.append(_unpack(block, k, 8, 8))
                else:
                    yield from f(bucket, path, _table(held))
        if finish:
            yield from finish(f)

    met = place_rows.unionByName(file_rows).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    return met.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: without the windows that an earlier document has."""
    spark = docs.sparkSession
    small_batches(spark)
    n = _buckets(docs)
    level = _half_level(docs, length, n)
    later = _repeated(_send_longer(level, length, length - (length + 1) // 2, n, False), n, False)

    def each():
        def run(bucket: int, path: str, table) -> Iterator[pa.RecordBatch]:
            rows = []
            for doc, size, sha, raw, _ in _records(path):
                at = _places_of(table, doc)
                gone = 0
                if len(at):
                    words = raw.split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[at] += 1
                    edge[at + length] -= 1
                    cover = np.cumsum(edge[:-1]) > 0
                    gone = int(cover.sum())
                    sha = _digest([w for w, c in zip(words, cover.tolist(), strict=True) if not c])
                rows.append((doc, size, gone, sha))
            yield _done(rows)

        return run

    out = _on_files(level, later, n, each, _LEVEL_DDL).unionByName(level.where("done"))
    return out.select("doc_id", "n_words", "n_removed", F.col("sha256").alias("kept_sha256"))


def longest_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, repeated_words: the greatest level (length, twice that, ...) at which one of its
    windows is in another document too; documents without any are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    n = _buckets(docs)
    level, reach, out = _half_level(docs, length, n), length - (length + 1) // 2, None
    while True:
        places = _repeated(_send_longer(level, length, reach, n, True), n, True)
        folder = new_path(spark, "repeats")

        def each(folder=folder):
            files = _Files(folder)

            def run(bucket: int, path: str, table) -> Iterator[pa.RecordBatch]:
                rows = []
                for doc, size, sha, raw, _ in _records(path):
                    found = _places_of(table, doc)
                    if len(found):
                        rows.append((doc, size, 0, sha))
                        yield from files.add(bucket, (doc, size, sha, raw, found.astype("<i4").tobytes()))
                if rows:
                    yield _done(rows)

            run.files = files
            return run

        level = saved(_on_files(level, places, n, each, _LEVEL_DDL, finish=lambda f: f.files.close()), "level")
        found = level.where("done").select("doc_id", F.lit(length).cast("long").alias("repeated_words"))
        out = found if out is None else out.unionByName(found)
        if not level.limit(1).count():
            return out.groupBy("doc_id").agg(F.max("repeated_words").alias("repeated_words"))
        # a window of twice the length begins at a window that repeats
        length, reach = 2 * length, 0
