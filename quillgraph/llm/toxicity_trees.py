"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of three lexicons (fixed words; words and word
beginnings learned from labels), how near its hits stand to words of the second person,
capitals, punctuation, and rates of obfuscated words (digits or signs inside a word, and
hits found only after undoing them).

The learned lexicon is counted by Spark, once in toxic and once in other rows, over all labelled
documents (one row a document, that of least XXH64 of text; ``max_labelled`` bounds them where it
is asked for, to those of least XXH64 of doc_id); its ``MOST_TERMS`` strongest terms are the
model's lexicon.  The rows have two halves; a row's training features use the lexicon of the
other half, so that the trees see hits as new texts have them.  The scores for isotonic
calibration come from trees of the other half, too.  Up to ``MOST_HELD`` rows the driver holds
the features and fits; beyond that Spark does, in passes over all rows (``boosted``).

Only documents whose crc32(doc_id as text) mod 3 is not 1 give labels; labels, lang, source
and doc_id are no inputs of a score.

Defined cases: null and empty texts get the score of a text without words; several labels
of a document count as their greatest; null labels and labels of unknown documents are
ignored; without rows of both classes every score is 0; repeated rows are scored one by one;
rows without doc_id are scored and neither held out nor learned from; an empty table gives no
rows; extra columns, whatever their names, are ignored (``score`` passes on those asked for).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillgraph.llm.boosted import Trees, fit_halves, isotonic, isotonic_table
from quillgraph.llm.common import Memo, discard, map_batches, named, one_a_document, raw_texts, release, saved, small_batches
from quillgraph.llm.hashed_text import Words

#: Rows whose features the driver holds, and the most bits that say which terms toxic rows have.
MOST_HELD, MOST_BITS = 20_000, 1 << 26
THRESHOLD = 0.7
MOST_TERMS = 3000
BEGINNINGS = (4, 5, 6)
#: Insults, and words of the second person, in four languages.
INSULTS = frozenset("idiot moron stupid scum trash loser clown pathetic worthless disgusting dumb fool jerk imbecile cretin vermin garbage dumm dummkopf trottel abschaum versager widerlich idiota imbécil estúpido basura asqueroso inútil imbécile stupide crétin ordure débile dégoûtant".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tú ti tus su vosotros".split())
#: Signs that stand for letters.
_UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_FIXED, _WORD, _START, _SECOND, _CAPITALS, _CAPITAL, _INSIDE, _HIDDEN = (1 << k for k in range(8))
NAMES = ("fixed", "words", "starts", "any_hits", "hit_count", "hidden", "inside", "second", "near", "nearest", "capitals", "capital", "marks", "exclaims", "longest_run", "log_words")


def whole(w: str) -> str:
    """The term of a whole word; long words are known by their hash."""
    return f"={w}" if len(w) <= 60 else f"#{xxhash.xxh3_128_hexdigest(w.encode())}"


def terms(word: str) -> list[str]:
    w = _EDGE.sub("", word.lower())
    return [whole(w)] + [w[:k] for k in BEGINNINGS if len(w) >= k] if w else []


def word_code(raw: bytes, lexicon: frozenset) -> int:
    word = raw.decode("utf-8", "replace")
    bare = _EDGE.sub("", word)
    w = bare.lower()
    code = 0
    if w in INSULTS:
        code |= _FIXED
    if whole(w) in lexicon:
        code |= _WORD
    if any(w[:k] in lexicon for k in BEGINNINGS if len(w) >= k):
        code |= _START
    if w in SECOND:
        code |= _SECOND
    if len(bare) > 1 and bare.isupper():
        code |= _CAPITALS
    elif bare[:1].isupper():
        code |= _CAPITAL
    if w and not w.isalpha() and any(c.isalpha() for c in w):
        code |= _INSIDE
        plain = w.translate(_UNDO)
        if plain != w and (plain in INSULTS or whole(plain) in lexicon):
            code |= _HIDDEN
    return code


#: Code points that Arrow strips, lower-cases and classes as Python does, as UTF-8.
_PLAIN = r"^(?:[\x00-\x7f]|\xc2[\x80-\xa9\xab-\xb9\xbb-\xbf]|[\xc3\xc5-\xc9][\x80-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xca[\x80-\xaf])*$"
_SIGNS = "".join(c for c in map(chr, range(0x2B0)) if not c.isalnum())


class Bare:
    """A column of words without signs at their ends: ``bare`` and, lower-cased, ``lower`` of the
    plain ones (at ``plain``); the others (at ``rest``) are for ``word_code`` and ``terms``."""

    def __init__(self, words: pa.Array):
        raw = words.cast(pa.binary())
        plain = pc.and_(pc.less_equal(pc.binary_length(raw), 60), pc.match_substring_regex(raw, _PLAIN))
        self.words, self.raw, self.n = words, raw, len(words)
        self.plain, self.rest = np.flatnonzero(plain), np.flatnonzero(pc.invert(plain))
        self.bare = pc.utf8_trim(words.filter(plain), _SIGNS)
        self.lower = pc.utf8_lower(self.bare)

    def whole(self) -> pa.Array:
        """As ``whole``, null for the empty word."""
        return pc.if_else(pc.equal(self.lower, ""), None, pc.binary_join_element_wise("=", self.lower, ""))

    def beginning(self, k: int) -> pa.Array:
        """The first k letters, null where there are fewer."""
        return pc.if_else(pc.greater_equal(pc.utf8_length(self.lower), k), pc.utf8_slice_codeunits(self.lower, 0, k), None)


class Coder:
    """``word_code`` of each word of a column: letters alone by Arrow, others one by one."""

    def __init__(self, lexicon: frozenset, most: int):
        self.lexicon, self.insults, self.second = (pa.array(sorted(s), pa.string()) for s in (lexicon, INSULTS, SECOND))
        self.memo = Memo(lambda w: word_code(w, lexicon), most)

    def __call__(self, b: Bare) -> np.ndarray:
        capitals = pc.and_(pc.utf8_is_upper(b.bare), pc.greater(pc.utf8_length(b.bare), 1))
        found = [
            (_FIXED, pc.is_in(b.lower, value_set=self.insults)),
            (_WORD, pc.is_in(b.whole(), value_set=self.lexicon)),
            *((_START, pc.is_in(b.beginning(k), value_set=self.lexicon)) for k in BEGINNINGS),
            (_SECOND, pc.is_in(b.lower, value_set=self.second)),
            (_CAPITALS, capitals),
            (_CAPITAL, pc.and_not(pc.utf8_is_upper(pc.utf8_slice_codeunits(b.bare, 0, 1)), capitals)),
        ]
        codes = np.zeros(len(b.plain), np.uint8)
        for bit, has in found:
            codes |= has.to_numpy(zero_copy_only=False) * np.uint8(bit)
        out = np.zeros(b.n, np.uint8)
        out[b.plain] = codes
        # digits and signs among letters may hide a hit
        mixed = pc.invert(pc.or_(pc.utf8_is_alpha(b.lower), pc.equal(b.lower, ""))).to_numpy(zero_copy_only=False)
        rest = np.append(b.rest, b.plain[mixed])
        out[rest] = [self.memo[w] for w in b.raw.take(pa.array(rest)).to_pylist()]
        return out


def measured(words: Words, codes: np.ndarray, raws: list[bytes]) -> np.ndarray:
    """Features of each text (rows, features) from the codes of its words, in their order."""
    sizes, rows = words.sizes, len(words.sizes)
    n, row = np.maximum(sizes, 1), np.repeat(np.arange(rows), sizes)
    share = lambda bit: words.sums(np.sign(codes & bit).astype(np.int64)) / n
    hit, second = np.flatnonzero(codes & (_FIXED | _WORD | _START | _HIDDEN)), np.flatnonzero(codes & _SECOND)
    of, hits = row[hit], np.bincount(row[hit], minlength=rows)
    near, nearest, run = np.zeros(rows), np.full(rows, 50), np.full(rows, 50)
    if len(second):
        at = np.searchsorted(second, hit)
        beside = second[np.minimum(at, len(second) - 1)], second[np.maximum(at - 1, 0)]
        gap = np.min([np.where(row[s] == of, np.abs(hit - s), 50) for s in beside], axis=0)
        near = np.bincount(of[gap <= 5], minlength=rows) / n
        np.minimum.at(nearest, of, gap)
    # the first hit counts as if one stood nine words before the text
    new = np.diff(of, prepend=-1) > 0
    np.minimum.at(run, of, np.where(new, hit - words.offsets[of] + 9, np.diff(hit, prepend=0)))
    marks = np.array([(len(raw) - len(raw.translate(None, b"!?.,;:*#$%&|<>\"'()-"))) / max(1, len(raw)) for raw in raws])
    exclaims = np.array([raw.count(b"!") for raw in raws])
    x = np.column_stack([share(_FIXED), share(_WORD), share(_START), hits / n, np.minimum(20, hits), share(_HIDDEN), share(_INSIDE), share(_SECOND), near, nearest, share(_CAPITALS), share(_CAPITAL), marks, exclaims / n, np.where(hits > 1, run, 50), np.log1p(n)])
    x[sizes == 0] = 0
    return x


def features(raw: bytes, codes: Memo) -> list[float]:
    """Features of one text."""
    words = Words(pa.array([raw], pa.binary()).view(pa.string()))
    own = np.array([codes[w] for w in words.words], np.uint8)
    return measured(words, own[words.which], [raw])[0].tolist()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def _sample(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, text, y, half of the labelled documents that are not held out (of so many at most)."""
    shared = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    mine = labels.where(F.col("toxic").isin(0, 1) & shared).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    if most is not None:
        mine = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = mine.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    return saved(one_a_document(docs.where(shared).select("doc_id", "text")).join(chosen, "doc_id"), "toxic-rows")


#: Terms of batches that a task holds before it sends their counts on.
GATHER = 400_000


class Bits:
    """Holds every term that was put in, and by chance some others."""

    def __init__(self, table: np.ndarray):
        self.table, self.last = table, 8 * len(table) - 1

    def place(self, term: str) -> int:
        return xxhash.xxh3_64_intdigest(term.encode()) & self.last

    def __contains__(self, term: str) -> bool:
        k = self.place(term)
        return bool(self.table[k >> 3] >> (k & 7) & 1)

    def among(self, terms: pa.Array) -> np.ndarray:
        """Which of a column of terms it holds."""
        raw = terms.cast(pa.binary()).to_numpy(zero_copy_only=False)
        k = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)) & np.uint64(self.last)
        return (self.table[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bits(terms: DataFrame) -> Bits:
    """The terms as bits, 64 a term or ``MOST_BITS`` in all."""
    size = min(MOST_BITS, 1 << (64 * terms.count() + 64).bit_length()) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bits(np.zeros(size, np.uint8))
        for batch in batches:
            for term in batch.column(0).to_pylist():
                k = own.place(term)
                own.table[k >> 3] |= 1 << (k & 7)
        yield pa.record_batch([pa.array([own.table.tobytes()], pa.binary())], ["bits"])

    out = Bits(np.zeros(size, np.uint8))
    # a table a task, one after the other
    for r in terms.select("term").mapInArrow(run, "bits binary").toLocalIterator():
        out.table |= np.frombuffer(r.bits, np.uint8)
    return out


def batch_terms(words: Words, memo: Memo) -> tuple[pa.Array, np.ndarray]:
    """Different terms of a column of texts, and the numbers (kinds, words) of each word's, -1 for none.

    ``memo`` has the terms of words that are not plain.
    """
    b, kinds = Bare(words.different), 1 + len(BEGINNINGS)
    rest = [memo[w] for w in b.raw.take(pa.array(b.rest)).to_pylist()]
    coded = pa.concat_arrays([b.whole(), *map(b.beginning, BEGINNINGS), pa.array([t for own in rest for t in own], b.lower.type)]).dictionary_encode()
    numbers = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.full((kinds, b.n), -1, np.int64)
    plain = kinds * len(b.plain)
    out[:, b.plain] = numbers[:plain].reshape(kinds, -1)
    sizes = np.array([len(own) for own in rest], np.int64)
    out[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(b.rest, sizes)] = numbers[plain:]
    return coded.dictionary, out


def term_counts(texts: pa.Array, half: np.ndarray, memo: Memo, wanted: frozenset | Bits | None) -> pa.Table:
    """term, n0, n1 of a column of texts, each text counted once for a term."""
    words = Words(texts)
    found, numbers = batch_terms(words, memo)
    if wanted is not None:
        has = wanted.among(found) if isinstance(wanted, Bits) else pc.is_in(found, value_set=pa.array(sorted(wanted), found.type)).to_numpy(zero_copy_only=False)
        # numbers among the wanted; -1 for the others, and for none (the last)
        numbers = np.append(np.where(has, np.cumsum(has) - 1, -1), -1)[numbers]
        found = found.filter(pa.array(has))
    at = np.repeat(np.arange(len(texts)), words.sizes)
    pairs = [(at * len(found) + n)[n >= 0] for n in (kind[words.which] for kind in numbers)]
    pairs = np.sort(np.concatenate(pairs))
    row, term = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], max(1, len(found)))
    counts = [np.bincount(term[half[row] == h], minlength=len(found)) for h in (0, 1)]
    return pa.table([found, *map(pa.array, counts)], ["term", "n0", "n1"])


def _counted(rows: DataFrame, least: int, wanted: frozenset | Bits | None = None) -> DataFrame:
    """term, n0, n1: in how many rows of either half a term is, for terms (of the wanted) in so many rows at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: terms(w.decode("utf-8", "replace")), most=40_000)
        held: list[pa.Table] = []

        def out() -> list[pa.RecordBatch]:
            sums = pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("n0", "sum"), ("n1", "sum")])
            held.clear()
            return sums.rename_columns(["term", "n0", "n1"]).to_batches(GATHER)

        for batch in batches:
            if batch.num_rows:
                held.append(term_counts(batch.column(0), batch.column(1).to_numpy(), memo, wanted))
            if sum(map(len, held)) >= GATHER:
                yield from out()
        if held:
            yield from out()
        del memo
        release()

    small_batches(rows.sparkSession)
    counted = rows.select("text", "half").mapInArrow(run, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return counted.where(F.col("n0") + F.col("n1") >= least)


def _counts(rows: DataFrame, least: int, wanted: frozenset | None = None) -> dict[str, tuple[int, int]]:
    """The same in the driver, for few rows."""
    return {r.term: (r.n0, r.n1) for r in _counted(rows, least, wanted).collect()}


def _lexicons(sample: DataFrame) -> list[frozenset]:
    """Learned terms of half 0, of half 1, and of both: frequent in toxic rows, rare in others.

    Terms are counted in toxic rows first, and in the others those alone that may be chosen
    (and a few by chance, which the join drops).
    """
    toxic = saved(_counted(sample.where("y > 0.5"), 3), "toxic-terms")
    clean = _counted(sample.where("y < 0.5"), 1, _bits(toxic)).toDF("term", "c0", "c1")
    both = saved(toxic.join(clean, "term", "left").na.fill(0, ["c0", "c1"]), "toxic-lifts")
    sizes = {(r.half, r.y): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    out = []
    for use in ((0,), (1,), (0, 1)):
        n_toxic, n_clean = (sum(sizes.get((h, y), 0) for h in use) for y in (1.0, 0.0))
        t, c = (sum((F.col(f"{kind}{h}") for h in use), F.lit(0)) for kind in "nc")
        lift = t / max(n_toxic, 1) / ((c + 0.5) / (n_clean + 1))
        found = both.select("term", t.alias("t"), lift.alias("lift")).where("t >= 3 and lift >= 8")
        out.append(frozenset(r.term for r in found.orderBy(F.desc("t"), F.desc("lift"), "term").limit(MOST_TERMS).collect()))
    discard(toxic)
    discard(both)
    return out


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None) -> dict | None:
    sample = _sample(docs, labels, max_labelled)
    lexicons = _lexicons(sample)
    columns = [f"x{k}" for k in range(len(NAMES))]

    def make():
        coders = [Coder(lexicons[k], most=60_000) for k in (0, 1)]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(batch.column(1))
            bare, half = Bare(words.different), np.repeat(batch.column(3).to_numpy(), words.sizes)
            codes = np.stack([coders[1 - k](bare) for k in (0, 1)])[half, words.which]
            x = measured(words, codes, raw_texts(batch))
            return pa.record_batch([batch.column(0), batch.column(2), batch.column(3), *map(pa.array, x.T)], ["doc_id", "y", "half", *columns])

        return run

    schema = "doc_id long, y double, half int, " + ", ".join(f"{c} double" for c in columns)
    rows = saved(map_batches(sample.select("doc_id", "text", "y", "half"), schema, make), "toxic-features")
    discard(sample)
    model = _fitted(rows, columns)
    discard(rows)
    return None if model is None else model | {"lexicon": lexicons[2]}


def _fitted(rows: DataFrame, columns: list[str]) -> dict | None:
    """Trees of all rows, and steps of the scores that trees of the other half give."""
    sizes = {r.half: (r.n, r.t) for r in rows.groupBy("half").agg(F.count("*").alias("n"), F.sum("y").alias("t")).collect()}
    n, toxic = (sum(x) for x in zip((0, 0), *sizes.values(), strict=True))
    if not 0 < toxic < n:
        return None
    if n > MOST_HELD and len(sizes) == 2:
        trees = fit_halves(rows, columns, [sizes[0][1] / sizes[0][0], sizes[1][1] / sizes[1][0], toxic / n])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, half, *x = (c.to_numpy() for c in batch.columns)
                z, x = np.zeros(len(y)), np.column_stack(x)
                for k in (0, 1):
                    z[half == k] = trees[1 - k].raw(x[half == k])
                yield pa.record_batch([pa.array(z), pa.array(y)], ["z", "y"])

        small_batches(rows.sparkSession, 8_192)
        return {"trees": trees[2], "steps": isotonic_table(rows.select("y", "half", *columns).mapInArrow(run, "z double, y double"))}
    held = rows.orderBy("doc_id").toArrow()
    y, half, *x = (held.column(c).to_numpy() for c in ("y", "half", *columns))
    x, z = np.column_stack(x), np.zeros(len(y))
    for k in (0, 1):
        mine, other = half == k, half != k
        if other.any() and mine.any():
            z[mine] = Trees().fit(x[other], y[other]).raw(x[mine])
    return {"trees": Trees().fit(x, y), "steps": isotonic(z, y)}


def score(docs: DataFrame, model: dict | None, columns: list[str], threshold: float = THRESHOLD, name: str = "score") -> DataFrame:
    """The columns, and the score; rows keep their number."""
    schema = StructType([*docs.select(*named(columns)).schema, StructField(name, DoubleType())])
    wanted = list(dict.fromkeys([*columns, "text"]))

    def make():
        coder = Coder(model["lexicon"], most=200_000) if model else None

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = np.zeros(batch.num_rows)
            if model:
                words = Words(batch.column(batch.schema.get_field_index("text")))
                x = measured(words, coder(Bare(words.different))[words.which], raw_texts(batch))
                s = np.interp(model["trees"].raw(x), *model["steps"])
            out = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            return pa.record_batch([*out, pa.array(s)], [*columns, name])

        return run

    return map_batches(docs.select(*named(wanted)), schema, make)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, learn(docs, labels), ["doc_id"], threshold)
    return out.select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
