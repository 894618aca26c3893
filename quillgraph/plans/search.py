"""Entry B: hybrid search: passages, names and paths for one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import parse_path_query, path_chain
from quillgraph.operators import graph, paths, vectors


def hybrid(query: str, index: tuple[DataFrame, DataFrame], chunks: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, k: int = 5) -> DataFrame:
    """V7: section, rank, key, detail, score.

    Passages always; names and paths if there is a graph.  ``chunks``: id, text, ord.
    """
    spark = chunks.sparkSession
    q = spark.createDataFrame([(0, query)], "query_id int, text string")
    hits = vectors.top_k(index, q, chunks.select(F.col("id").alias("key"), F.col("ord").alias("idx")), k)
    passages = hits.join(chunks.select(F.col("id").alias("key"), "text"), "key").select(F.lit("vector").alias("section"), "rank", "key", F.substring("text", 1, 300).alias("detail"), "score")
    if nodes is None or edges is None:
        return passages
    found = graph.name_search(nodes, edges, query)
    names = found.select(F.lit("graph").alias("section"), F.row_number().over(Window.orderBy("node_ord")).alias("rank"), F.col("name").alias("key"), F.col("type").alias("detail"), F.col("degree").cast("double").alias("score"))
    out = passages.unionByName(names)
    ends = parse_path_query(query)
    if ends:
        p = paths.find_paths(edges, *ends)
        out = out.unionByName(p.select(F.lit("path").alias("section"), F.col("length").alias("rank"), F.array_join("path", ">").alias("key"), path_chain("edges").alias("detail"), F.lit(1.0).alias("score")))
    return out
