"""Token ids in binary shards: bit- or byte-plane shuffling, zstandard, a chunk index.

A shard holds the ids of consecutive documents, cut into blocks of a fixed number of ids.
A block is transposed: plane k has bit (or byte) k of each id, so the planes of the high
bits, which hardly vary, shrink to nothing.  Each plane is compressed by itself; planes of
zeros take no bytes.  Behind the blocks lie the documents' ids and lengths and the chunk
index (place, number of ids, size of each plane, checksum), so that one block can be read
without the others.

    magic | blocks of planes | documents (zstd) | index (zstd) | 4 numbers | magic

Documents go to shards in ascending doc_id (nulls first; rows of equal or null doc_id by the
hash of their text, so that many of them are dealt out, too); range partitioning by these
makes shards of consecutive partitions consecutive.  A shard
is closed at ``SHARD_IDS`` ids, so memory does not grow with the input.  A repeated task
writes a file of another name; only files that the index table names are read.

Defined cases: null and empty texts have the end id alone; an empty table has no shards
and gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import Memo, new_path, open_shared, saved, small_batches

MAGIC = b"QPLANES1"
BLOCK_IDS = 65_536
SHARD_IDS = 4_000_000


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of little-endian unsigned 32-bit ids, lowest first; b"" for zeros."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [p.tobytes() if p.any() else b"" for p in by_byte]
    out = []
    for p in by_byte:
        if not p.any():
            out += [b""] * 8
            continue
        for k in range(8):
            plane = p >> k & 1
            out.append(np.packbits(plane).tobytes() if plane.any() else b"")
    return out


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    by_byte = np.zeros((4, n), np.uint8)
    for k, p in enumerate(planes):
        if p:
            if bits:
                by_byte[k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
            else:
                by_byte[k] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(by_byte.T).view("<u4").reshape(-1)


class ShardWriter:
    def __init__(self, sink, bits: bool = False, level: int = 1):
        self.sink, self.bits, self.pack = sink, bits, zstandard.ZstdCompressor(level=level)
        self.at, self.index, self.buffer, self.held = len(MAGIC), [], [], 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.buffer.append(ids)
        self.held += len(ids) // 4
        if self.held >= BLOCK_IDS:
            data = b"".join(self.buffer)
            full = len(data) // (4 * BLOCK_IDS)
            for k in range(full):
                self._block(data[k * 4 * BLOCK_IDS : (k + 1) * 4 * BLOCK_IDS])
            rest = data[full * 4 * BLOCK_IDS :]
            self.buffer, self.held = [rest], len(rest) // 4

    def _block(self, data: bytes) -> None:
        sizes = []
        at = self.at
        for p in to_planes(np.frombuffer(data, "<u4"), self.bits):
            p = self.pack.compress(p) if p else p
            self.sink.write(p)
            sizes.append(len(p))
        self.index.append((at, len(data) // 4, zlib.crc32(data), sizes))
        self.at += sum(sizes)

    def close(self) -> None:
        if self.held:
            self._block(b"".join(self.buffer))
        known = np.array([d is not None for d in self.docs], np.uint8)
        docs = self.pack.compress(known.tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes())
        index = self.pack.compress(b"".join(struct.pack(f"<QII{len(s)}I", a, n, c, *s) for a, n, c, s in self.index))
        self.sink.write(docs)
        self.sink.write(index)
        self.sink.write(struct.pack("<QQQQB", self.at, len(docs), len(self.docs), len(index), self.bits) + MAGIC)


class ShardReader:
    TAIL = struct.calcsize("<QQQQB") + len(MAGIC)

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard, or cut off")
        at, of_docs, n, of_index, bits = struct.unpack("<QQQQB", data[-self.TAIL : -len(MAGIC)])
        unpack = zstandard.ZstdDecompressor().decompress
        self.data, self.bits, self.unpack = data, bool(bits), unpack
        docs = unpack(data[at : at + of_docs])
        known = np.frombuffer(docs[:n], np.uint8)
        self.docs = [int(d) if k else None for k, d in zip(known, np.frombuffer(docs[n : 9 * n], "<i8"), strict=True)]
        self.lengths = np.frombuffer(docs[9 * n :], "<i8")
        planes = 32 if bits else 4
        entry = struct.Struct(f"<QII{planes}I")
        self.index = [(x[0], x[1], x[2], x[3:]) for x in entry.iter_unpack(unpack(data[at + of_docs : at + of_docs + of_index]))]

    def block(self, k: int) -> np.ndarray:
        at, n, crc, sizes = self.index[k]
        planes = []
        for s in sizes:
            planes.append(self.unpack(self.data[at : at + s]) if s else b"")
            at += s
        ids = from_planes(planes, n, self.bits)
        if zlib.crc32(ids) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        held, at, k = b"", 0, 0
        for doc, n in zip(self.docs, self.lengths.tolist(), strict=True):
            if len(held) - at < 4 * n:
                parts, have = [held[at:]], len(held) - at
                while have < 4 * n:
                    parts.append(self.block(k).tobytes())
                    have += len(parts[-1])
                    k += 1
                held, at = b"".join(parts), 0
            yield doc, held[at : at + 4 * n]
            at += 4 * n


#: The normaliser and pre-tokeniser for which the fast way below is right.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: Behind the last letter of a piece in the vocabulary.
_END = "</w>"
#: White space inside a word, special tokens, letters that change under normalisation.
_SLOW = "[\x1c-\x1f\x85\xa0\u0130\u0300-\U0010ffff]|<\\|"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies use: printable bytes stand for themselves, the others, in order, for the letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


_LETTERS = _byte_letters()
#: By code point below 768: what the pattern takes for a letter or a number.
_OTHER, _LETTER, _NUMBER = 0, 1, 2
_KINDS = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x300)], np.uint8)


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def _joined(column: pa.Array, ends: np.ndarray) -> pa.Array:
    """Runs of values of a column of large_binary, each as one value; ends: of the runs, in values, from 0 on."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(_offsets(column)[ends]), column.buffers()[2]])


def _cut(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``_PATTERN`` finds in the lower-cased words (large_string, white space and code points from 768 on in none), not yet lower-cased, and where each word ends, in pieces, from 0 on.

    Every character is of a piece: a number is one, letters and others are so in runs; but an
    apostrophe that begins a run goes with the letters of 's and the like behind it.
    """
    at = _offsets(words)
    first, at, data = at[0], at - at[0], words.buffers()[2] or pa.py_buffer(b"")
    b = np.frombuffer(data, np.uint8)[first : first + at[-1]]
    kind, lead = _KINDS[b], np.flatnonzero(b >= 0xC0)
    kind[lead] = kind[lead + 1] = _KINDS[(b[lead] & 0x1F).astype(np.int64) << 6 | b[lead + 1] & 0x3F]
    cuts = np.ones(len(b) + 1, bool)
    cuts[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    cuts[lead + 1] = False
    cuts[at] = True
    marks = np.flatnonzero((b == ord("'")) & cuts[:-1])
    if len(marks):
        ends, low = np.zeros(len(b) + 3, bool), np.append(b, np.zeros(3, np.uint8)) | 0x20
        ends[at] = True
        x, y = low[marks + 1].astype(np.int64), low[marks + 2]
        two = np.isin(x << 8 | y, [0x7265, 0x7665, 0x6C6C]) & ~ends[marks + 2]  # re, ve, ll
        size = np.where(np.isin(x, list(b"stmd")), 2, np.where(two, 3, 0)) * ~ends[marks + 1]
        marks, size = marks[size > 0], size[size > 0]
        cuts[marks + 1] = False
        cuts[marks + size] = True
    places = np.flatnonzero(cuts)
    return pa.Array.from_buffers(pa.large_string(), len(places) - 1, [None, pa.py_buffer(places + first), data]), np.searchsorted(places, at)


class WordEncoder:
    """Ids of whole texts by the library, which sees each piece of a word once.

    The file's normaliser and pre-tokeniser never look across ASCII white space, so the ids
    of a text are those of its words; and the pre-tokeniser cuts a word into pieces that are
    encoded one by one, so the ids of a word are those of its pieces.  Pieces are given to
    the library's model; words in which the normaliser does more than lower case go to the
    whole tokeniser.  All this is read from the file: if its normaliser, pre-tokeniser or added
    tokens are of another kind, whole texts go to the whole tokeniser.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.fast = (
            (spec.get("normalizer") or {}).get("normalizers") == _NORMALISER
            and (spec.get("pre_tokenizer") or {}).get("pretokenizers") == _SPLIT
            and model["type"] == "BPE"
            and not model.get("dropout")
            and not model.get("continuing_subword_prefix")
            and model.get("end_of_word_suffix") == _END
            and all(x in model["vocab"] for c in _LETTERS.values() for x in (c, c + _END))
            and not spec.get("truncation")
            and all("<|" in a["content"] and not a["single_word"] and not a["lstrip"] and not a["rstrip"] for a in spec.get("added_tokens") or [])
        )
        if not self.fast:
            return
        self.pieces_only = Tokenizer(self.t.model)
        self.pieces_only.pre_tokenizer = Split(" ", "removed")
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.last[[k for x, k in model["vocab"].items() if x.endswith(_END)]] = True
        self.slow_words = Memo(self._library)
        # pieces in two generations, as in Memo, but looked up and added a batch at a time
        self.half, self.longest, self.young, self.old = most // 2, 64, {}, {}

    def _library(self, text: str) -> bytes:
        return _little(self.t.encode(text, add_special_tokens=False).ids)

    def _new(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of several pieces, by one call of the library's model.

        A piece has no space, and no ``_END`` either (its brackets and its letter are never in
        one piece), so the model's ids of a last letter end each piece.
        """
        letters = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_LETTERS) for p in pieces]
        ids = np.array(self.pieces_only.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(0, np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(pieces) + 1 or ends[-1] != 4 * len(ids):
            raise ValueError("the model does not end each piece as its file says")
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).to_numpy(zero_copy_only=False).tolist()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of several different pieces."""
        found = list(map(self.young.get, pieces))
        missed = [k for k, ids in enumerate(found) if ids is None]
        for k in missed:
            found[k] = self.old.get(pieces[k])
        new = [k for k in missed if found[k] is None]
        if new:
            for k, ids in zip(new, self._new([pieces[k] for k in new]), strict=True):
                found[k] = ids
        if len(self.young) + len(missed) > self.half:
            self.old, self.young = self.young, {}
        self.young |= {pieces[k]: found[k] for k in missed if len(pieces[k]) <= self.longest}
        return found

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each of several different words (large_string)."""
        slow = pc.match_substring_regex(words, _SLOW)
        cut, ends = _cut(words.filter(pc.invert(slow)))
        pieces = pc.utf8_lower(cut).dictionary_encode()
        known = pa.array(self._pieces(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        by_piece = _joined(known.take(pieces.indices), ends)
        by_library = pa.array([self.slow_words[w] for w in words.filter(slow).to_pylist()], pa.large_binary())
        slow = slow.to_numpy(zero_copy_only=False)
        place = np.where(slow, len(by_piece) + np.cumsum(slow) - 1, np.cumsum(~slow) - 1)
        return pa.concat_arrays([by_piece, by_library]).take(pa.array(place))

    def __call__(self, text: str) -> bytes:
        return next(self.encode(pa.array([text], pa.string())))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column (null: empty).

        Arrow splits the texts and numbers their words, cuts the different words into pieces and
        numbers these, so that each piece of the column is looked up once, and puts the ids in
        their places.
        """
        texts = texts.fill_null("")
        if not self.fast:
            yield from map(self._library, texts.to_pylist())
            return
        # an empty word may stand at either end of a text; it has no ids
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        found = self._words(words.dictionary.cast(pa.large_string())).take(words.indices)
        for ids in _joined(found, split.offsets.to_numpy() - split.offsets[0].as_py()):
            yield ids.as_py()


_ENCODERS: dict[str, WordEncoder] = {}


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, bits: bool = False, ids_per_shard: int = SHARD_IDS, partitions: int | None = None) -> DataFrame:
    """Encode, write shards, and return their table: path, place (partition, number), documents, ids."""
    spark = docs.sparkSession
    small_batches(spark, 2048)
    out = new_path(spark, "shards")
    end = np.array([end_id], "<u4").tobytes()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.setdefault(tokenizer, None) or WordEncoder(tokenizer)
        _ENCODERS[tokenizer] = encode
        part, number, w, path, sink, total = TaskContext.get().partitionId(), 0, None, "", None, 0
        fs, root = open_shared(out)
        fs.create_dir(root, recursive=True)

        def close():
            w.close()
            sink.close()
            return pa.record_batch([[path], [part], [number], [len(w.docs)], [total]], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1)), strict=True):
                if w is None:
                    name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.planes"
                    path, sink, total = f"{out}/{name}", fs.open_output_stream(f"{root}/{name}"), 0
                    w = ShardWriter(sink, bits)
                w.add(doc, ids + end)
                total += len(ids) // 4 + 1
                if total >= ids_per_shard:
                    yield close()
                    w, number = None, number + 1
        if w is not None:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return saved(dealt.mapInArrow(run, "path string, part int, number int, n_docs long, n_ids long"), "shard-index")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = shards.sparkSession
    # one row a shard of millions of ids: this order is over a short table
    placed = shards.withColumn("first", F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = open_shared(path)
                with fs.open_input_file(at) as f:
                    reader = ShardReader(f.read())
                docs, starts, sizes, crcs, at = [], [], [], [], first or 0
                for doc, ids in reader.documents():
                    docs.append(doc)
                    starts.append(at)
                    sizes.append(len(ids) // 4)
                    crcs.append(zlib.crc32(ids))
                    at += len(ids) // 4
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("path", "first").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
