"""Paths, neighbourhoods and two-hop inference by joins of bounded depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.iterate import cut, kept, numbered

STEP = "array<struct<from:string,to:string,relation:string>>"


def find_paths(edges: DataFrame, source: str, target: str, max_depth: int = 3) -> DataFrame:
    """G1: all simple directed paths of ``max_depth`` edges at most: path, edges, length.

    Only the frontier is joined; each path stops at the target.  A node that is missing has
    no paths, and so has a node to itself.
    """
    step = edges.select("src", "dst", F.coalesce("relation", F.lit("")).alias("relation"))
    at = edges.sparkSession.range(1).select(F.lit(source).alias("end"), F.array(F.lit(source)).alias("path"), F.expr(f"cast(array() as {STEP})").alias("edges"))
    found = None
    for depth in range(max_depth):
        reach = step if depth < max_depth - 1 else step.where(F.col("dst") == target)
        at = at.join(reach, at["end"] == reach["src"]).where(~F.array_contains("path", F.col("dst")))
        at = at.select(F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path"), F.concat("edges", F.array(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "relation"))).alias("edges"))
        hits = at.where(F.col("end") == target).select("path", "edges", F.size("edges").alias("length"))
        found = hits if found is None else found.unionByName(hits)
        at = at.where(F.col("end") != target)
    return found


#: Names of a frontier that are broadcast (counted).
MOST_FRONTIER = 500_000


def bfs(edges: DataFrame, name: str, depth: int = 2, most: int = MOST_FRONTIER) -> DataFrame:
    """Entity and least distance along out-edges, without the start.

    Each round joins the new frontier alone and drops what was seen.  The edges are written once;
    while a frontier has few names it goes to where the edges are, which are not shuffled.
    """
    step = kept(edges.select("src", "dst"))
    seen = edges.sparkSession.range(1).select(F.lit(name).alias("entity"), F.lit(0).alias("distance"))
    frontier = seen
    for d in range(1, depth + 1):
        few = frontier.limit(most + 1).count() <= most
        at = frontier.select(F.col("entity").alias("src"))
        new = step.join(F.broadcast(at) if few else at, "src").select(F.col("dst").alias("entity")).distinct()
        frontier = cut(new.join(seen.select("entity"), "entity", "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


#: Ids in one list, and names that a broadcast may hold (counted).
MOST_IDS, MOST_NAMES = 1000, 2_000_000


def _new_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, ids, direct) sorted by s become (s, ids): the different ids without the direct ones.

    Ids of the last name of a batch are held until another name comes.
    """
    name, mine, edges = None, np.empty(0, np.int64), np.empty(0, np.int64)

    def out(names, keys):
        """``keys``: place of the name and id in one number, sorted."""
        at = np.searchsorted(keys >> 32, np.arange(len(names) + 1)).astype(np.int32)
        return pa.record_batch([names, pa.ListArray.from_arrays(pa.array(at), pa.array((keys & 0xFFFFFFFF).astype(np.int32)))], ["s", "ids"])

    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("s").dictionary_encode()
        names, ids = coded.dictionary, batch.column("ids")
        sizes = np.diff(ids.offsets.to_numpy())
        keys = np.repeat(coded.indices.to_numpy().astype(np.int64) << 32, sizes) | ids.flatten().to_numpy()
        direct = np.repeat(batch.column("direct").to_numpy(zero_copy_only=False), sizes)
        found, known = np.unique(keys[~direct]), np.unique(keys[direct])
        if name is not None and names[0].as_py() == name:
            found, known = np.union1d(mine, found), np.union1d(edges, known)
        elif name is not None:
            yield out(pa.array([name]), np.setdiff1d(mine, edges, assume_unique=True))
        last = len(names) - 1
        a, b = np.searchsorted(found, last << 32), np.searchsorted(known, last << 32)
        if last:
            yield out(names.slice(0, last), np.setdiff1d(found[:a], known[:b], assume_unique=True))
        name, mine, edges = names[last].as_py(), found[a:] & 0xFFFFFFFF, known[b:] & 0xFFFFFFFF
    if name is not None:
        yield out(pa.array([name]), np.setdiff1d(mine, edges, assume_unique=True))


def transitive(edges: DataFrame, confidence: float = 0.5, most_names: int = MOST_NAMES) -> DataFrame:
    """Pairs that two edges join and none does: subject, relation, object, confidence, source.

    Middle nodes with many edges make many pairs; those are the result.  Second ends are numbered,
    so that what is shuffled before the pairs are told apart is a list of numbers an edge, not two
    names a pair; that shuffle, by subject, is the only one of pairs.
    """
    e = kept(edges.where("src <> dst").select("src", "dst").distinct())
    second = kept(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
    ends = numbered(second.select("dst").distinct(), "dst", name="id").withColumn("id", F.col("id").cast("int"))
    if ends.limit(most_names + 1).count() <= most_names:
        ends = F.broadcast(ends)
    near = second.join(ends, "dst").groupBy(F.col("src").alias("mid")).agg(F.collect_list("id").alias("ids"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / MOST_IDS).cast("int")), lambda i: F.slice("ids", i * MOST_IDS + 1, F.lit(MOST_IDS)))
    near = near.select("mid", F.explode(pieces).alias("ids"))
    reached = e.join(near, e["dst"] == near["mid"]).select(F.col("src").alias("s"), "ids", F.lit(False).alias("direct"))
    direct = e.join(ends, "dst").select(F.col("src").alias("s"), F.array("id").alias("ids"), F.lit(True).alias("direct"))
    new = reached.unionByName(direct).repartition("s").sortWithinPartitions("s").mapInArrow(_new_pairs, "s string, ids array<int>")
    pairs = new.select(F.col("s").alias("subject"), F.explode("ids").alias("id")).join(ends, "id").select("subject", F.col("dst").alias("object")).where("subject <> object")
    return pairs.select("subject", F.lit("INFLUENCES").alias("relation"), "object", F.lit(confidence).alias("confidence"), F.lit("transitive_inference").alias("source"))
