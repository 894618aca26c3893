"""A stream of triples that keeps a graph store up to date, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillgraph.operators.graph import fold_edges, fold_nodes
from quillgraph.sources.store import GraphStore


def merge(store: GraphStore, batch: DataFrame) -> None:
    """Fold a batch of triples into the stored graph; old edges win ties, as earlier ones do."""
    nodes, edges = store.load()
    old = edges.select(F.col("src").alias("subject"), F.lit("").alias("subject_type"), "relation", F.col("dst").alias("object"), F.lit("").alias("object_type"), "confidence", "source_text", "source_chunk", F.lit(-1).cast("long").alias("triple_ord"))
    new_edges = fold_edges(old.unionByName(batch.select(*old.columns)))
    both = nodes.unionByName(fold_nodes(batch))
    new_nodes = both.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"), F.min("node_ord").alias("node_ord"))
    store.save(new_nodes, new_edges)


def follow(triples: DataFrame, store: GraphStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start merging a streaming DataFrame of triples; with ``once`` it takes what is there and ends."""
    writer = triples.writeStream.foreachBatch(lambda batch, _: merge(store, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
