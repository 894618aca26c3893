"""TF-IDF and dense retrieval.

The index is sparse: (key, term, weight) and (term, df, idf).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillgraph.functions.text import dense_cosine, idf, tokenize


def term_counts(chunks: DataFrame, key: str = "id") -> DataFrame:
    """Key, term, tf, max_tf, for queries."""
    t = chunks.select(F.col(key).alias("key"), F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    return t.withColumn("max_tf", F.max("tf").over(Window.partitionBy("key")))


class Index(tuple):
    """(weights, idf), and ``packed``: the weights with one row a key (key, terms, weights)."""

    packed: DataFrame

    def __new__(cls, weights: DataFrame, table: DataFrame, packed: DataFrame):
        out = super().__new__(cls, (weights, table))
        out.packed = packed
        return out


_HAN, _NAME = re.compile("[\u4e00-\u9fff]"), re.compile("[a-zA-Z_][a-zA-Z0-9_]{1,}")


def _tokens(text: str | None) -> list[str]:
    """F1 as in ``tokenize``; only what was found is put in lower case, since that can make letters."""
    if not text:
        return []
    names = " ".join(_NAME.findall(text)).lower().split()
    return names if text.isascii() else _HAN.findall(text) + names


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, tokens) of rows sorted by key: rows of one key are one text."""
    last, tokens, any_yet = None, [], False
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if any_yet and key == last:
                tokens = tokens + _tokens(text)
                continue
            if any_yet:
                yield last, tokens
            last, tokens, any_yet = key, _tokens(text), True
    if any_yet:
        yield last, tokens


#: Rows of one batch that a worker gives back, and bytes of text of one part.
BATCH, PART_BYTES = 100_000, 1 << 25


def _part_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, term, n: the keys of a part that hold a term."""
    found, part = Counter(), None

    def noted():
        nonlocal part
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            yield batch

    for _, tokens in _by_key(noted()):
        found.update(set(tokens))
    terms, n = list(found), list(found.values())
    for i in range(0, len(terms), BATCH):
        some = terms[i : i + BATCH]
        yield pa.record_batch([pa.array([part] * len(some), pa.int32()), pa.array(some, pa.string()), pa.array(n[i : i + BATCH], pa.int64())], ["part", "term", "n"])


def _packer(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf: dict[str, float] = {}

        def texts():
            """The terms of a part come first, then its texts."""
            for batch in batches:
                known = pc.is_valid(batch.column("idf"))
                of = batch.filter(known)
                idf.update(zip(of.column("text").to_pylist(), of.column("idf").to_pylist(), strict=True))
                yield batch.filter(pc.invert(known))

        def packed():
            of = np.fromiter(map(idf.__getitem__, terms), float, len(terms))
            sizes = np.array(lengths)
            w = np.array(counts, float) / np.repeat(np.array(most, float), sizes) * of
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            return pa.record_batch([pa.array(keys, kind), pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(w))], ["key", "terms", "weights"])

        keys, lengths, terms, counts, most = [], [], [], [], []
        for key, tokens in _by_key(texts()):
            if not tokens:
                continue
            tf = Counter(tokens)
            keys.append(key)
            lengths.append(len(tf))
            terms += tf
            counts += tf.values()
            most.append(max(tf.values()))
            if len(terms) >= BATCH:
                yield packed()
                keys, lengths, terms, counts, most = [], [], [], [], []
        if keys:
            yield packed()

    return run


def build_index(chunks: DataFrame, key: str = "id", n: int | None = None) -> Index:
    """Weights (key, term, weight) and idf (term, df, idf).

    Texts are dealt by key to parts of about 32 MB.  A part sends each of its terms once to be
    counted, and gets each once with its idf; the terms of the single keys are never shuffled.
    """
    spark = chunks.sparkSession
    docs = chunks.select(F.col(key).alias("key"), F.col("text").alias("text"))
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = rows if n is None else n
    parts = max(1, -(-size // PART_BYTES), min(2 * spark.sparkContext.defaultParallelism, size >> 20))
    docs = docs.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    found = docs.repartitionById(parts, F.col("part")).sortWithinPartitions("key").mapInArrow(_part_terms, "part int, term string, n long")
    table = found.groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", idf(F.lit(n), F.col("df")))
    known = found.withColumn("df", F.sum("n").over(Window.partitionBy("term"))).select("part", F.lit(None).cast(docs.schema["key"].dataType).alias("key"), F.col("term").alias("text"), idf(F.lit(n), F.col("df")).alias("idf"))
    both = known.unionByName(docs.withColumn("idf", F.lit(None).cast("double"))).repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("idf").isNull(), "key")
    kind = docs.schema["key"].dataType
    packed = both.mapInArrow(_packer(to_arrow_type(kind)), f"key {kind.simpleString()}, terms array<string>, weights array<double>")
    weights = packed.select("key", F.inline(F.arrays_zip("terms", "weights")).alias("term", "weight"))
    return Index(weights, table, packed)


def norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("key").agg(F.greatest(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), F.lit(1e-10)).alias("norm"))


#: Terms of all query vectors that are broadcast (counted); beyond that the join shuffles.
MOST_QUERY_TERMS = 500_000


def query_vectors(queries: DataFrame, table: DataFrame, key: str = "query_id", most: int = MOST_QUERY_TERMS) -> DataFrame:
    """V3: unknown terms are ignored, but count for the greatest frequency."""
    counts = term_counts(queries, key)
    if counts.limit(most + 1).count() <= most:
        counts = F.broadcast(counts)
    return counts.join(table, "term").select("key", "term", (F.col("tf") / F.col("max_tf") * F.col("idf")).alias("weight"))


#: Products and scores that a worker holds at once, and by how much scores that may be equal differ.
MOST_PRODUCTS, NEAR = 4_000_000, 1e-11


class Best:
    """The first k scores of each query, and those that may equal the last of them."""

    def __init__(self, queries: int, k: int, floor: float, kind: pa.DataType):
        self.least, self.k, self.queries, self.kind = np.full(queries, floor), k, queries, kind
        self.held = [(np.empty(0, np.int64), np.empty(0), pa.array([], kind))]
        self.size = 0

    def add(self, scores: np.ndarray, keys: pa.Array, exact=None) -> None:
        """``scores``: a row a key, a column a query; ``exact`` gives those of some rows and columns anew."""
        found = scores >= self.least
        if len(scores) > self.k and np.count_nonzero(found) > 4 * self.k * self.queries:
            at = len(scores) - self.k
            np.maximum(self.least, np.partition(scores, at, axis=0)[at] - NEAR, out=self.least)
            found = scores >= self.least
        r, q = np.nonzero(found)
        self.held.append((q, scores[r, q] if exact is None else exact(r, q), keys.take(pa.array(r))))
        self.size += len(r)
        if self.size > max(500_000, 4 * self.k * self.queries):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        q, s, keys = np.concatenate([x[0] for x in self.held]), np.concatenate([x[1] for x in self.held]), pa.concat_arrays([x[2] for x in self.held])
        order = np.lexsort((-s, q))
        q, s = q[order], s[order]
        first = np.searchsorted(q, np.arange(self.queries))
        last = first + self.k - 1
        full = (last < len(q)) & (q[np.minimum(last, len(q) - 1)] == np.arange(self.queries)) if len(q) else np.zeros(self.queries, bool)
        self.least[full] = np.maximum(self.least[full], s[last[full]] - NEAR)
        keep = s >= self.least[q]
        self.held = [(q[keep], s[keep], keys.take(pa.array(order[keep])))]
        self.size = len(self.held[0][0])
        return self.held[0]


def _scorer(shared, k: int, floor: float, kind: pa.DataType, asked: pa.DataType):
    """Scores packed rows against the queries' postings: query_id, key, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, start, of, qw, qn = shared.value
        vocabulary, best = pa.array(terms, pa.string()), Best(len(ids), k, floor - 1e-9, kind)
        for batch in batches:
            lists = batch.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            w = batch.column("weights").flatten().to_numpy()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.maximum(np.sqrt(np.bincount(doc, w * w, len(sizes))), 1e-10)
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            seen = at >= 0
            doc, at, w = doc[seen], at[seen], w[seen]
            many = start[at + 1] - start[at]
            each = np.concatenate([[0], np.cumsum(np.bincount(doc, many, len(sizes)).astype(np.int64))])
            lo = 0
            while lo < len(sizes):
                # as many rows as give so many products and scores, one at least
                hi = max(lo + 1, min(len(sizes), lo + MOST_PRODUCTS // len(ids), int(np.searchsorted(each, each[lo] + MOST_PRODUCTS, "right")) - 1))
                a, b = np.searchsorted(doc, [lo, hi])
                m = many[a:b]
                row = np.repeat(np.arange(a, b), m)
                place = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[at[a:b]], m)
                dots = np.bincount((doc[row] - lo) * len(ids) + of[place], w[row] * qw[place], (hi - lo) * len(ids)).reshape(hi - lo, len(ids))
                best.add(dots / (norm[lo:hi, None] * qn), batch.column("key").slice(lo, hi - lo))
                lo = hi
        q, s, keys = best.cut()
        yield pa.record_batch([pa.array(ids, asked).take(pa.array(q)), keys, pa.array(s)], ["query_id", "key", "score"])

    return run


def top_k(index: tuple[DataFrame, DataFrame], queries: DataFrame, order: DataFrame, k: int = 5, floor: float = 0.01, most: int = MOST_QUERY_TERMS) -> DataFrame:
    """V4, T3, P12 for many queries (query_id, text): query_id, key, score, rank.

    ``order`` (key, idx) settles ties: the higher place goes first.  The floor applies after
    the ranks.  While the query vectors are few they go to the workers: each task scores its
    rows (one a key) against the postings of the queries' terms and keeps of each query the
    first ``k`` and their equals, so neither products nor scores are shuffled.
    """
    weights, table = index
    vectors = query_vectors(queries, table, most=most).select(F.col("key").alias("query_id"), "term", F.col("weight").alias("qw"))
    few = vectors.limit(most + 1).collect()
    ranked = order.groupBy("key").agg(F.max("idx").alias("idx"))
    if len(few) <= most:
        scored = _scored_by_workers(index, vectors, few, k, floor)
    else:
        dots = weights.join(vectors, "term").groupBy("query_id", "key").agg(F.sum(F.col("qw") * F.col("weight")).alias("dot"))
        qn = norms(vectors.select(F.col("query_id").alias("key"), F.col("qw").alias("weight"))).select(F.col("key").alias("query_id"), F.col("norm").alias("qn"))
        scored = dots.join(norms(weights), "key").join(qn, "query_id").select("query_id", "key", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.desc("idx"))
    return scored.join(ranked, "key").withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") > floor)).select("query_id", "key", "score", "rank")


def _scored_by_workers(index: tuple[DataFrame, DataFrame], vectors: DataFrame, few: list, k: int, floor: float) -> DataFrame:
    weights, spark = index[0], vectors.sparkSession
    asked = vectors.schema["query_id"].dataType
    packed = index.packed if isinstance(index, Index) else weights.groupBy("key").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("key", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    kind = packed.schema["key"].dataType
    schema = f"query_id {asked.simpleString()}, key {kind.simpleString()}, score double"
    if not few:
        return spark.createDataFrame([], schema)
    ids, terms = list(dict.fromkeys(r.query_id for r in few)), sorted({r.term for r in few})
    number, place = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(terms)}
    of, at, qw = np.array([number[r.query_id] for r in few]), np.array([place[r.term] for r in few]), np.array([r.qw for r in few])
    by = np.argsort(at, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms)))])
    qn = np.maximum(np.sqrt(np.bincount(of, qw * qw, len(ids))), 1e-10)
    shared = spark.sparkContext.broadcast((ids, terms, start, of[by], qw[by], qn))
    return packed.mapInArrow(_scorer(shared, k, floor, to_arrow_type(kind), to_arrow_type(asked)), schema)


def without_self(hits: DataFrame) -> DataFrame:
    """After the ranks, so a query that finds itself has one context less."""
    return hits.where("key <> query_id")


#: Queries of one block, and numbers in it at most.
MOST_QUERIES, MOST_NUMBERS = 100_000, 8_000_000


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", most: int = MOST_QUERIES) -> DataFrame:
    """V8's backend: exact cosine of each query to each vector: query_id, key, score, rank.

    The queries are read in blocks beside all rows: one, or beyond ``most`` queries as many as
    keep a block near that size, dealt by hash of key.  All rows of a query_id share a block, so
    the ranks of the blocks are those of the whole.  A task multiplies its rows with a block as
    matrices, takes the products of the pairs that may be among the first ``k`` again one by one
    (equal vectors have equal scores), and gives back only these.
    """
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("qv")).where("qv is not null")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("v is not null")
    odd = lambda x: F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) > 1e150))
    shape = lambda df, x: df.agg(F.count(F.lit(1)), F.min(F.size(x)), F.max(F.size(x)), F.coalesce(F.max(odd(x)), F.lit(False))).first()
    (n, least, largest, q_odd), (m, v_least, v_largest, v_odd) = shape(q, "qv"), shape(rows, "v")
    whole = bool(n and m and least) and least == largest == v_least == v_largest and not (q_odd or v_odd)
    blocks = max(-(-n // most), -(-n * largest // MOST_NUMBERS) if whole else 1)
    parts = [q] if blocks <= 1 else [q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]
    if whole:
        rows = rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, m // 100_000))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.desc("key"))
    out = None
    for part in parts:
        scored = _multiplied(rows, part, k) if whole else _paired(rows, part)
        best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def _paired(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """All scores; each row meets the block of queries as one array.  For vectors of several lengths or without numbers."""
    block = queries.agg(F.collect_list(F.struct("query_id", "qv")).alias("block"))
    pairs = rows.join(F.broadcast(block), F.lit(True)).select("key", "v", F.explode("block").alias("q"))
    return pairs.select(F.col("q.query_id").alias("query_id"), "key", dense_cosine(F.col("q.qv"), F.col("v")).alias("score"))


def _matrix(lists: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their clipped norms."""
    m = lists.flatten().to_numpy().astype(float).reshape(n, -1)
    return m, np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-10)


def _multiplied(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of each task and query the first ``k`` scores and their equals."""
    kind, asked = rows.schema["key"].dataType, queries.schema["query_id"].dataType
    schema = f"query_id {asked.simpleString()}, key {kind.simpleString()}, score double"
    block = queries.toArrow().combine_chunks().to_batches()
    if not block:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(block[0])
    key_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_for = shared.value
        q, qn = _matrix(asked_for.column("qv"), asked_for.num_rows)
        unit = (q / qn[:, None]).T
        best, step = Best(len(q), k, -np.inf, key_type), max(1, MOST_PRODUCTS // len(q))
        for batch in batches:
            if not batch.num_rows:
                continue
            v, norm = _matrix(batch.column("v"), batch.num_rows)
            for i in range(0, len(v), step):
                some, n = v[i : i + step], norm[i : i + step]

                def exact(r, c, some=some, n=n):
                    at = range(0, len(r), BATCH)
                    return np.concatenate([(some[r[j : j + BATCH]] * q[c[j : j + BATCH]]).sum(axis=1) / (qn[c[j : j + BATCH]] * n[r[j : j + BATCH]]) for j in at]) if len(r) else np.empty(0)

                best.add((some / n[:, None]) @ unit, batch.column("key").slice(i, step), exact)
        c, s, keys = best.cut()
        yield pa.record_batch([asked_for.column("query_id").take(pa.array(c)), keys, pa.array(s)], ["query_id", "key", "score"])

    return rows.mapInArrow(run, schema)


def needs_rebuild(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """V5: one row, stale: another number of chunks, or another (id, text) at some place (ord)."""
    a = stored.select("ord", F.struct("id", "text").alias("a"))
    b = chunks.select("ord", F.struct("id", "text").alias("b"))
    return a.join(b, "ord", "full_outer").agg(F.coalesce(F.max(~F.col("a").eqNullSafe(F.col("b"))), F.lit(False)).alias("stale"))


def add_chunks(stored: DataFrame, chunks: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """U5."""
    both = stored.unionByName(chunks, allowMissingColumns=True)
    return both, build_index(both)


def save_index(index: tuple[DataFrame, DataFrame], path: str) -> None:
    """K9."""
    index[0].write.mode("overwrite").parquet(f"{path}/weights")
    index[1].write.mode("overwrite").parquet(f"{path}/idf")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An index that is not there is empty."""
    from quillgraph.sources.store import read_or_empty

    return (
        read_or_empty(spark, f"{path}/weights", "key string, term string, weight double"),
        read_or_empty(spark, f"{path}/idf", "term string, df bigint, idf double"),
    )
