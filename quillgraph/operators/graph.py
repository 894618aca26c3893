"""The property graph: triples fold into nodes and edges, and queries over these two tables.

nodes (name, types, node_ord) and edges (src, dst, relation, confidence, source_text,
source_chunk, wiki_updated) have at most one edge a pair.  Every function is lazy and takes
and returns DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import render_types, strip
from quillgraph.schemas import DEFAULT_RELATION, DEFAULT_TYPE


def confident(triples: DataFrame, threshold: float = 0.7) -> DataFrame:
    """A missing confidence is 0."""
    return triples.where(F.coalesce("confidence", F.lit(0.0)) >= threshold)


def stamp(triples: DataFrame, chunk_id: str) -> DataFrame:
    """P2."""
    return triples.withColumn("source_chunk", F.lit(chunk_id))


def cleaned(triples: DataFrame) -> DataFrame:
    """Trimmed names, default relation; without blank subjects or objects."""
    out = triples.withColumn("subject", strip(F.coalesce("subject", F.lit("")))).withColumn("object", strip(F.coalesce("object", F.lit(""))))
    out = out.withColumn("relation", strip(F.coalesce("relation", F.lit(DEFAULT_RELATION))))
    return out.where((F.col("subject") != "") & (F.col("object") != ""))


def fold_edges(triples: DataFrame) -> DataFrame:
    """A1: of each pair the triple of highest confidence, of equal ones the first.

    ``max_by`` of structs is planned as a sort aggregate: each task sorts its triples by pair,
    so that a hot pair is one row a task in the one shuffle.
    """
    t = cleaned(triples)
    kept = ["relation", "confidence", "source_text", "source_chunk"]
    best = F.max_by(F.struct(*kept), F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("triple_ord")).alias("o"))).alias("b")
    return t.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(best).select("src", "dst", *(F.col(f"b.{k}").alias(k) for k in kept), F.lit(False).alias("wiki_updated"))


def fold_nodes(triples: DataFrame) -> DataFrame:
    """A2: names with the sorted set of their types, in order of first appearance.

    Each task hashes its names and types; only these meet as sets.
    """
    t = cleaned(triples)
    side = lambda n, k: F.struct(F.col(n).alias("name"), F.coalesce(f"{n}_type", F.lit("")).alias("type"), (F.col("triple_ord") * 2 + k).alias("o"))
    both = t.select(F.inline(F.array(side("subject", 0), side("object", 1))))
    typed = both.groupBy("name", "type").agg(F.min("o").alias("o"))
    return typed.groupBy("name").agg(F.array_sort(F.collect_set("type")).alias("types"), F.min("o").alias("node_ord"))


def build(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    return fold_nodes(triples), fold_edges(triples)


# --- lookups


def find_relations(edges: DataFrame, subject: str | None = None, relation: str | None = None, obj: str | None = None) -> DataFrame:
    """Empty arguments do not filter; the filters reach the scan."""
    for column, value in (("src", subject), ("relation", relation), ("dst", obj)):
        if value:
            edges = edges.where(F.col(column) == value)
    return edges.select(F.col("src").alias("subject"), F.coalesce("relation", F.lit("")).alias("relation"), F.col("dst").alias("object"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("source_text", F.lit("")).alias("source_text"))


def find_entity(nodes: DataFrame, name: str) -> DataFrame:
    """No row if there is none."""
    return nodes.where(F.col("name") == name)


def find_by_type(nodes: DataFrame, kind: str) -> DataFrame:
    """P5."""
    return nodes.where(F.array_contains("types", kind))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Name, in_degree, out_degree, degree; a loop counts twice in degree."""
    end = lambda c, o, i: F.struct(F.col(c).alias("name"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = edges.select(F.inline(F.array(end("src", 1, 0), end("dst", 0, 1))))
    d = ends.groupBy("name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(d, "name", "left").select("name", zero("in_degree"), zero("out_degree"), (F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))).cast("long").alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """J11."""
    return nodes.join(degrees(nodes.select("name"), edges).select("name", "degree"), "name")


def entity_list(nodes: DataFrame, edges: DataFrame, q: str = "", kind: str = "", page: int | None = 1, per: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of names by degree, then name; and the total before the page.

    No page means all rows in that order.
    """
    rows = nodes.select("name", render_types("types").alias("type"))
    if q:
        rows = rows.where(F.lower("name").contains(q.lower()))
    if kind:
        rows = rows.where(F.col("type").contains(kind))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    rows = with_degree(rows, edges).orderBy(F.desc("degree"), "name")
    return (rows if page is None else rows.offset((page - 1) * per).limit(per)), total


def name_search(nodes: DataFrame, edges: DataFrame, q: str, most: int = 10) -> DataFrame:
    """The first names that hold the query, in order of appearance."""
    hits = nodes.where(F.lower("name").contains(q.lower())).orderBy("node_ord").limit(most)
    return with_degree(hits.select("name", render_types("types").alias("type"), "node_ord"), edges)


def neighbours(edges: DataFrame, name: str | None = None) -> DataFrame:
    """Entity, direction, relation, other, and the edge's other columns; of all entities or one.

    One scan of the edges gives both directions.
    """
    if name is not None:
        edges = edges.where((F.col("src") == name) | (F.col("dst") == name))
    rest = [c for c in edges.columns if c not in ("src", "dst", "relation", "wiki_updated")]
    side = lambda mine, direction, other: F.struct(F.col(mine).alias("entity"), F.lit(direction).alias("direction"), "relation", F.col(other).alias("other"), *rest)
    near = edges.select(F.inline(F.array(side("src", "outgoing", "dst"), side("dst", "incoming", "src"))))
    return near if name is None else near.where(F.col("entity") == name)


def _sorted_relations(direction: str) -> Column:
    """T5: by confidence, highest first; then by the other end."""
    mine = F.collect_list(F.when(F.col("direction") == direction, F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("k"), "other", "relation", "confidence")))
    return F.transform(F.array_sort(mine), lambda x: F.concat_ws("|", x["relation"], x["other"]))


def entity_detail(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Type, sorted relations both ways and degree of one entity; no row if there is none."""
    near = neighbours(edges, name).groupBy("entity").agg(_sorted_relations("outgoing").alias("outgoing"), _sorted_relations("incoming").alias("incoming"), F.count(F.lit(1)).alias("degree"))
    none = F.array().cast("array<string>")
    shown = F.when(F.size("types") > 0, render_types("types")).otherwise(DEFAULT_TYPE).alias("type")
    one = find_entity(nodes, name).select("name", shown)
    return one.join(near, one["name"] == near["entity"], "left").select("name", "type", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def viz_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Size grows with degree up to a limit."""
    shown = F.when(F.array_join("types", "") != "", render_types("types")).otherwise(DEFAULT_TYPE).alias("type")
    return with_degree(nodes.select("name", shown), edges).select("name", "type", F.least(F.lit(40), 5 + 2 * F.col("degree")).cast("long").alias("size"))


def viz_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("relation", F.lit(DEFAULT_RELATION)).alias("relation"))


# --- counts


def type_counts(nodes: DataFrame) -> DataFrame:
    """A5."""
    return nodes.select(F.explode("types").alias("type")).groupBy("type").count().withColumnRenamed("count", "n")


def relation_counts(edges: DataFrame) -> DataFrame:
    """A6."""
    return edges.groupBy(F.coalesce("relation", F.lit("")).alias("relation")).count().withColumnRenamed("count", "n")


def relation_types(edges: DataFrame, blank: bool = False) -> DataFrame:
    """Distinct and sorted; blank ones on request."""
    r = edges.select(F.coalesce("relation", F.lit("")).alias("relation")).distinct()
    return (r if blank else r.where("relation <> ''")).orderBy("relation")


def entity_types(nodes: DataFrame) -> DataFrame:
    """A8."""
    return nodes.select(F.explode("types").alias("type")).distinct().orderBy("type")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A3: nodes, edges, density, avg_degree, max_degree, min_degree in one row."""
    d = degrees(nodes.select("name"), edges)
    n, m = F.count(F.lit(1)), F.sum("out_degree")
    one = d.agg(n.alias("nodes"), F.coalesce(m, F.lit(0)).alias("edges"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.min("degree"), F.lit(0)).alias("min_degree"), F.coalesce(F.sum("degree"), F.lit(0)).alias("total"))
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    average = F.when(F.col("nodes") > 0, F.col("total") / F.col("nodes")).otherwise(0.0)
    return one.select("nodes", "edges", F.round(density, 4).alias("density"), F.round(average, 2).alias("avg_degree"), "max_degree", "min_degree")


# --- changes


def update_entity(nodes: DataFrame, edges: DataFrame, name: str, kind: str | None = None, outgoing: DataFrame | None = None, incoming: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M2: make the entity, replace its type, replace all its outgoing (or incoming) edges.

    outgoing: relation, target, confidence; incoming: relation, source, confidence.
    """
    spark = nodes.sparkSession
    types = F.array(F.lit(kind)) if kind else F.array().cast("array<string>")
    if kind:
        nodes = nodes.withColumn("types", F.when(F.col("name") == name, types).otherwise(F.col("types")))
    fresh = spark.range(1).select(F.lit(name).alias("name"), types.alias("types"))
    for given, mine, other, column in ((outgoing, "src", "dst", "target"), (incoming, "dst", "src", "source")):
        if given is None:
            continue
        new = given.select(F.lit(name).alias(mine), strip(column).alias(other), F.coalesce("relation", F.lit(DEFAULT_RELATION)).alias("relation"), F.coalesce("confidence", F.lit(1.0)).cast("double").alias("confidence"), F.lit("").alias("source_text"), F.lit("").alias("source_chunk"), F.lit(True).alias("wiki_updated")).where(F.col(other) != "").dropDuplicates([mine, other])
        fresh = fresh.unionByName(new.select(F.col(other).alias("name"), F.array().cast("array<string>").alias("types")))
        pairs = new.select("src", "dst")
        edges = edges.where(F.col(mine) != name).join(pairs, ["src", "dst"], "left_anti").unionByName(new.select(*edges.columns))
    fresh = fresh.groupBy("name").agg(F.max("types").alias("types")).join(nodes.select("name"), "name", "left_anti")
    return nodes.unionByName(fresh.withColumn("node_ord", F.lit(2**62))), edges


def delete_entity(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """M3."""
    return nodes.where(F.col("name") != name), edges.where((F.col("src") != name) & (F.col("dst") != name))


def rank_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
