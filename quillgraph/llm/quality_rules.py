"""Quality rules, and a hashed n-gram logistic regression for what passes them.

The model learns from labelled quality rows (a bounded sample, the ``max_labelled`` documents
of least XXH64 of doc_id, one row each), is calibrated on folds left out, and scores whole texts in Arrow
batches; a text is kept if it breaks no rule and its probability reaches ``threshold``.

Defined cases: null and empty texts have no words and fail the rules; several labels of a
document count as their least; null labels and labels of unknown documents are ignored;
without rows of both classes the model rejects nothing; repeated rows are judged one by one;
rows without doc_id are judged, not learned from; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import map_batches, one_a_document, raw_texts
from quillgraph.llm.hashed_text import Rows, Scorer, Words, cross_fitted, features, sigmoid
from quillgraph.llm.window_doubling import window_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
MAX_LABELLED = 2000
THRESHOLD = 0.5


def rules(raw: bytes, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words' hashes."""
    chars = len(raw.decode()) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    repeat = 0
    windows = window_hashes(h, 5)
    if len(windows) > 1:
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            again = np.zeros(len(windows), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            edge = np.zeros(len(h) + 1, np.int64)
            at = np.flatnonzero(again)
            edge[at] += 1
            edge[at + 5] -= 1
            repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    return len(h), chars, symbols, dup, repeat


def labelled(docs: DataFrame, labels: DataFrame, name: str, most: int) -> DataFrame:
    """doc_id, text, y of at most so many labelled documents, chosen by hash of doc_id."""
    y = labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(name).cast("double").alias("y"))
    # no more rows than the parameter says: small enough to broadcast
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return one_a_document(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "y")


def training_rows(sample: DataFrame) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Features, labels and folds of a bounded sample (doc_id, text, y), in order of doc_id."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = features(batch.column(1))
            return pa.record_batch([batch.column(0), batch.column(2), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["doc_id", "y", "at", "x"])

        return run

    rows = map_batches(sample.select("doc_id", "text", "y"), "doc_id long, y double, at binary, x binary", make).collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.at), bytes(r.x)))
    ids = np.array([r.doc_id for r in rows], np.int64)
    return Rows([(np.frombuffer(r.at, "<i4"), np.frombuffer(r.x, "<f4")) for r in rows]), np.array([r.y for r in rows]), (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype(np.int64) % 2


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple | None:
    rows, y, fold = training_rows(labelled(docs, labels, "quality", max_labelled))
    if not rows.n or not 0 < y.sum() < rows.n:
        return None
    return cross_fitted(rows, y, fold)


def judge(docs: DataFrame, model: tuple | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, kept, probability."""

    def make():
        w, b, slope, offset = model or (np.zeros(0), 0.0, 1.0, 0.0)
        scorer = Scorer(w, b) if model else None

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, out = Words(batch.column(1)), []
            probability = sigmoid(slope * scorer(words) + offset) if scorer else np.ones(batch.num_rows)
            for raw, h, p in zip(raw_texts(batch), words.texts(words.hashes), probability.tolist(), strict=True):
                counts = rules(raw, h)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                out.append((*counts, failed, not failed and p >= threshold, p))
            columns = list(zip(*out, strict=True))
            return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:7]), pa.array(columns[7], pa.float64())], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

        return run

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double", make)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, learn(docs, labels))
