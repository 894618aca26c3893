"""Weak-label quality model.

Overlapping heuristic labellers vote good, bad or nothing on every whole text.  The votes
are counted by pattern over all documents (there are 3**labellers patterns at most, however
many documents); expectation-maximisation on these counts estimates the prior and each
labeller's accuracy.  The posterior labels of a bounded sample (``max_sample`` documents of
least XXH64 of doc_id) train a hashed linear scorer, which then scores every text.

Defined cases: a null or empty text gets one bad vote (it is too short); equal rows get
equal results; rows without doc_id vote and are scored, but no sample has them; of rows that
share a doc_id the sample has the one whose text has the least hash; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import map_batches, one_a_document, raw_texts, saved
from quillgraph.llm.hashed_text import Scorer, Words, fit, platt, sigmoid
from quillgraph.llm.quality_rules import rules, training_rows

#: Frequent words of English, German, French and Spanish.
COMMON = frozenset("the of and to in a is that it was for on are with as be this not by or and der die das und ist nicht von den zu mit sich des auf für im le la les de et un une est que pour dans qui du en pas sur el los las y que se por con para su al lo como más".encode().split())
LABELLERS = ("length", "symbols", "capitals", "repeats", "lines", "common", "word_length", "marks")
BAD, NONE, GOOD = 0, 1, 2
MAX_SAMPLE = 2000
THRESHOLD = 0.5
_UPPER = bytes(range(65, 91))


def votes(raw: bytes, h: np.ndarray, frequent: int) -> list[int]:
    """Of a text, its words' hashes and the number of its frequent words."""
    n, chars, symbols, dup, repeat = rules(raw, h)
    if not n:
        return [BAD] + [NONE] * 7
    letters = max(1, chars - symbols)
    upper = (len(raw) - len(raw.translate(None, _UPPER))) / letters
    lines = raw.count(b"\n") + 1
    common = frequent / n
    mean = chars / n
    marks = (raw.count(b"!") + raw.count(b"|")) / n

    def by(x: float, good: float, bad: float) -> int:
        """Good up to the one, bad from the other (which may lie on either side)."""
        return (GOOD if x <= good else BAD if x >= bad else NONE) if good < bad else (GOOD if x >= good else BAD if x <= bad else NONE)

    return [by(n, 30, 8), by(symbols / chars, 0.01, 0.08), by(upper, 0.12, 0.4), by(repeat / n, 0.05, 0.25), by(dup / lines, 0.02, 0.3), by(common, 0.12, 0.02), GOOD if 3 <= mean <= 8 else BAD if mean > 12 or mean < 2 else NONE, by(marks, 0.02, 0.3)]


def all_votes(raws: list[bytes], words: Words) -> list[str]:
    """The votes on each text of a column."""
    frequent = words.sums(np.fromiter((w.lower() in COMMON for w in words.words), np.int64, len(words.words))[words.which])
    return ["".join(map(str, votes(*x))) for x in zip(raws, words.texts(words.hashes), frequent.tolist(), strict=True)]


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of good, (labeller, class, vote) probabilities, posterior of good by pattern."""
    m = patterns.shape[1]
    hit = np.stack([(patterns == v) for v in (BAD, NONE, GOOD)], axis=2)  # pattern, labeller, vote
    prior = 0.8
    table = np.empty((m, 2, 3))
    table[:, 0], table[:, 1] = (0.5, 0.3, 0.2), (0.1, 0.3, 0.6)
    post = np.full(len(counts), prior)
    for _ in range(steps):
        like = [np.einsum("pmv,mv->p", hit, np.log(table[:, c])) for c in (0, 1)]
        post = sigmoid(np.log(prior / (1 - prior)) + like[1] - like[0])
        weight = [counts * (1 - post), counts * post]
        for c in (0, 1):
            # a little of the first guess keeps rare votes and tiny tables in bounds
            first = np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]][c])
            table[:, c] = (np.einsum("p,pmv->mv", weight[c], hit) + 5 * first) / (weight[c].sum() + 5)
        prior = float(np.clip((weight[1].sum() + 4) / (counts.sum() + 5), 0.01, 0.99))
    return prior, table, post


def weak_quality(docs: DataFrame, max_sample: int = MAX_SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, votes, posterior (from votes), score (of the trained scorer), kept."""
    docs = docs.select("doc_id", "text")

    def make_votes():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([pa.array(all_votes(raw_texts(batch), Words(batch.column(1))), pa.string())], ["votes"])

        return run

    counted = map_batches(docs, "votes string", make_votes).groupBy("votes").count().collect()
    counted.sort(key=lambda r: r.votes)
    if not counted:
        return docs.select("doc_id", F.lit("").alias("votes"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    patterns = np.array([[int(v) for v in r.votes] for r in counted])
    _, _, post = estimate(patterns, np.array([r["count"] for r in counted], float))
    posterior = {r.votes: float(p) for r, p in zip(counted, post, strict=True)}

    chosen = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)

    def make_labels():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            y = [posterior.get(v, 0.5) for v in all_votes(raw_texts(batch), Words(batch.column(1)))]
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(y, pa.float64())], ["doc_id", "text", "y"])

        return run

    sample = map_batches(one_a_document(docs.join(F.broadcast(chosen), "doc_id")), "doc_id long, text string, y double", make_labels)
    rows, y, _ = training_rows(saved(sample, "weak-sample"))
    w, b = fit(rows, y, np.ones(rows.n)) if rows.n else (np.zeros(3), 0.0)
    slope, offset = platt(rows.dot(w) + b, (y > 0.5).astype(float)) if rows.n else (1.0, 0.0)
    trained = rows.n and 0 < (y > 0.5).sum() < rows.n

    def make():
        scorer = Scorer(w, b)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(batch.column(1))
            v = all_votes(raw_texts(batch), words)
            p = np.array([posterior.get(x, 0.5) for x in v])
            # texts without words have their posterior alone
            s = np.where(words.sizes > 0, sigmoid(slope * scorer(words) + offset), p) if trained else p
            return pa.record_batch([batch.column(0), pa.array(v, pa.string()), pa.array(p), pa.array(s), pa.array(s >= threshold)], ["doc_id", "votes", "posterior", "score", "kept"])

        return run

    return map_batches(docs, "doc_id long, votes string, posterior double, score double, kept boolean", make)
