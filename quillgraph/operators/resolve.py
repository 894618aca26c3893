"""Entity resolution: greedy leaders in order of first appearance, worked out in parallel.

Sequentially, a name joins the earliest leader that is similar enough, or becomes a leader.
A name is a leader if and only if none of its earlier similar names is one: the first maximal
independent set in that order.  So in rounds: an undecided name with no undecided and no
leading earlier neighbour leads; one with a leading earlier neighbour follows; until all are
decided.  Each follower then takes its earliest leader.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import normalize_name, similarity
from quillgraph.operators.iterate import cut


def first_seen(triples: DataFrame) -> DataFrame:
    """name, ord: subjects before objects within a triple; blank names are left out."""
    side = lambda n, k: triples.select(F.col(n).alias("name"), (F.col("triple_ord") * 2 + k).alias("ord"))
    both = side("subject", 0).unionByName(side("object", 1)).where("name is not null and trim(name) <> ''")
    return both.groupBy("name").agg(F.min("ord").alias("ord"))


def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """F3's other form: twice the longest common subsequence over the sum of lengths."""

    def one(x: str, y: str) -> float:
        if not x and not y:
            return 1.0
        masks: dict[str, int] = {}
        for k, ch in enumerate(x):
            masks[ch] = masks.get(ch, 0) | 1 << k
        full = v = (1 << len(x)) - 1
        for ch in y:
            u = v & masks.get(ch, 0)
            v = (v + u | v - u) & full
        return 2 * (len(x) - v.bit_count()) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def similar_pairs(names: DataFrame, threshold: float = 0.85, mode: str = "edit") -> DataFrame:
    """Name, ord, earlier, earlier_ord with a similarity of the threshold at least.

    Equal normalised names meet on their key.  For the others: with at most k edits two names
    share one of k+1 pieces of the shorter, shifted by k places at most (pigeonhole), so they
    meet on (piece, text) and are then compared.  Nothing is compared all with all, and no
    pair above the threshold is lost.
    """
    n = names.select("name", "ord", normalize_name("name").alias("norm"))
    # distinct normalised names are compared; names of one form are alike by definition
    forms = cut(n.select("norm").distinct().withColumn("len", F.length("norm")))
    share = 1 - threshold
    if mode == "edit":
        longest = F.floor(F.col("len") / threshold + 1e-9)
        edits = lambda length: F.floor(length * share + 1e-9).cast("int")
    else:
        # of indel ratio r, the lengths differ by a factor (2 - r) / r at most
        longest = F.floor(F.col("len") * (2 - threshold) / threshold + 1e-9)
        edits = lambda length: F.floor(2 * length * share + 1e-9).cast("int")
    # the shorter name is cut in pieces, one more than there may be edits to its longest partner
    short = forms.where("len > 0").withColumn("k", edits(longest))
    short = short.withColumn("k", F.least(F.col("k"), F.col("len") - 1))
    piece = F.floor(F.col("len") / (F.col("k") + 1)).cast("int")
    short = short.withColumn("piece", F.greatest(piece, F.lit(1)))
    cutting = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.substring(F.col("norm"), i * F.col("piece") + 1, F.col("piece")))
    left = short.select("norm", "len", F.explode(F.array_distinct(cutting)).alias("t"))
    # every substring of the longer one that may be a piece of a shorter partner
    ratio = (2 - threshold) / threshold if mode == "indel" else 1 / threshold
    k_of = lambda n: F.least(edits(F.floor(n * ratio + 1e-9)), n - 1)
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("len") / ratio - 1e-9).cast("int")), F.col("len"))
    sizes = F.array_distinct(F.transform(lengths, lambda n: F.greatest(F.floor(n / (k_of(n) + 1)).cast("int"), F.lit(1))))
    grams = forms.where("len > 0").select("norm", "len", F.explode(sizes).alias("size"))
    grams = grams.select(F.col("norm").alias("other"), F.col("len").alias("olen"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("len") - F.col("size") + 1), lambda i: F.substring(F.col("norm"), i, F.col("size"))))).alias("t"))
    met = left.join(grams, "t").where((F.col("olen") >= F.col("len")) & (F.col("olen") <= F.floor(F.col("len") * ratio + 1e-9)) & (F.col("norm") != F.col("other")))
    met = met.select(F.least("norm", "other").alias("a"), F.greatest("norm", "other").alias("b")).distinct()
    if mode == "edit":
        like = met.where(similarity(F.col("a"), F.col("b")) >= threshold - 1e-9)
    else:
        like = met.where(F.pandas_udf(indel_ratio, "double")("a", "b") >= threshold - 1e-9)
    both = like.unionByName(like.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(forms.select(F.col("norm").alias("a"), F.col("norm").alias("b")))
    later = n.select("name", "ord", F.col("norm").alias("a"))
    earlier = n.select(F.col("name").alias("earlier"), F.col("ord").alias("earlier_ord"), F.col("norm").alias("b"))
    return later.join(both, "a").join(earlier, "b").where("earlier_ord < ord").select("name", "ord", "earlier", "earlier_ord")


def leaders(names: DataFrame, pairs: DataFrame, most_rounds: int = 200, decided: DataFrame | None = None) -> DataFrame:
    """R2: name, canonical.  ``decided`` (name, canonical): names that are settled already."""
    pairs = cut(pairs.select("name", "earlier", "earlier_ord"))
    state = names.select("name", F.lit(None).cast("boolean").alias("leads"))
    if decided is not None:
        known = decided.select("name", (F.col("name") == F.col("canonical")).alias("leads"))
        state = names.select("name").join(known, "name", "left")
    state = cut(state)
    for _ in range(most_rounds):
        near = pairs.join(state.select(F.col("name").alias("earlier"), F.col("leads").alias("e")), "earlier").groupBy("name").agg(F.max(F.coalesce("e", F.lit(False))).alias("led"), F.max(F.col("e").isNull()).alias("open"))
        decided = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        state = cut(state.join(near, "name", "left").select("name", decided.alias("leads")))
        if state.where("leads is null").isEmpty():
            break
    else:
        raise RuntimeError("leaders did not settle")
    lead = state.where("leads").select(F.col("name").alias("earlier"))
    first = pairs.join(lead, "earlier").groupBy("name").agg(F.min_by("earlier", "earlier_ord").alias("leader"))
    return state.join(first, "name", "left").select("name", F.when(F.col("leads"), F.col("name")).otherwise(F.col("leader")).alias("canonical"))


def _edit_similarity(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


def asked_in_order(names: DataFrame, threshold: float, mode: str, ask: Callable[[str, list[str]], str | None], most: int = 20) -> list[tuple[str, str]]:
    """(name, canonical) of the first names, as long as ``most`` leaders at most are known.

    A name that no leader resembles is shown to the backend before it becomes one; an answer
    that is no leader, and an error, count as none.  Names come to the driver one by one, each
    at the price of a call at most, until there are more leaders than may be asked about.
    """
    alike = _edit_similarity if mode == "edit" else lambda a, b: float(indel_ratio(pd.Series([a]), pd.Series([b]))[0])
    out: list[tuple[str, str]] = []
    known: dict[str, str] = {}  # leader and its normal form, in order
    for r in names.select("name", normalize_name("name").alias("norm")).orderBy(names["ord"]).toLocalIterator():
        if len(known) > most:
            break
        found = next((k for k, norm in known.items() if alike(r.norm, norm) >= threshold - 1e-9), None)
        if found is None and known and len(known) <= most:
            try:
                answer = ask(r.name, list(known))
            except Exception:
                answer = None
            found = answer if answer in known else None
        if found is None:
            known[r.name] = r.norm
        out.append((r.name, found or r.name))
    return out


def resolve_names(names: DataFrame, threshold: float = 0.85, mode: str = "edit", ask: Callable[[str, list[str]], str | None] | None = None) -> DataFrame:
    """R2; where a backend is given it is asked about the first names."""
    pairs = similar_pairs(names, threshold, mode)
    if ask is None:
        return leaders(names, pairs)
    first = names.sparkSession.createDataFrame(asked_in_order(names, threshold, mode, ask), "name string, canonical string")
    rest = leaders(names, pairs, decided=first)
    return rest.join(first.select("name", F.col("canonical").alias("given")), "name", "left").select("name", F.coalesce("given", "canonical").alias("canonical"))


def rewrite(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Subjects and objects by their canonical names; blanks stay."""
    columns = triples.columns
    for side in ("subject", "object"):
        of = names.select(F.col("name").alias(side), F.col("canonical").alias("_canonical"))
        triples = triples.join(of, side, "left").withColumn(side, F.coalesce("_canonical", side)).drop("_canonical")
    return triples.select(*columns)


def resolve(triples: DataFrame, threshold: float = 0.85, mode: str = "edit") -> DataFrame:
    return rewrite(triples, resolve_names(first_seen(triples), threshold, mode))


def resolver_stats(names: DataFrame) -> DataFrame:
    """Canonical entities, and names that were merged into another."""
    return names.agg(F.countDistinct("canonical").alias("entities"), (F.count(F.lit(1)) - F.countDistinct("canonical")).alias("merged"))
