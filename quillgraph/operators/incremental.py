"""Snapshots of files, their four-way difference, and the upkeep of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed(files: DataFrame) -> DataFrame:
    """path, hash of (path, content)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def scan(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Path, status: new, modified, deleted or unchanged."""
    a = current.select("path", F.col("hash").alias("now"))
    b = snapshot.select("path", F.col("hash").alias("then"))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("then"), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def to_process(diff: DataFrame, full: bool = False, first_run: bool = False) -> DataFrame:
    """I2."""
    return diff.where("status <> 'deleted'" if full or first_run else "status in ('new', 'modified')").select("path")


def is_first_run(snapshot: DataFrame) -> bool:
    return snapshot.isEmpty()


def maintain(old: DataFrame, fresh: DataFrame, diff: DataFrame, key: str = "path") -> DataFrame:
    """Rows of unchanged files, and the fresh rows; keyed by file, not by place."""
    gone = diff.where("status in ('deleted', 'modified')").select(F.col("path").alias(key))
    return old.join(gone, key, "left_anti").unionByName(fresh)


def union_chunks(fresh: DataFrame, cached: DataFrame, diff: DataFrame, key: str = "path") -> DataFrame:
    """Fresh chunks, and the cached ones of unchanged files."""
    same = diff.where("status = 'unchanged'").select(F.col("path").alias(key))
    return fresh.unionByName(cached.join(same, key, "left_semi"), allowMissingColumns=True)


def register(snapshot: DataFrame, processed: DataFrame) -> DataFrame:
    """M4 and I4: the snapshot with the processed files (path, hash, chunk_ids) put in or replaced."""
    return snapshot.join(processed.select("path"), "path", "left_anti").unionByName(processed)


def unregister(snapshot: DataFrame, paths: DataFrame) -> DataFrame:
    return snapshot.join(paths.select("path"), "path", "left_anti")


def triples_by_file(triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """Source, triple_ords (sorted), through the chunk of each triple."""
    of = chunks.select(F.col("id").alias("source_chunk"), "source").dropDuplicates(["source_chunk"])
    return triples.join(of, "source_chunk").groupBy("source").agg(F.array_sort(F.collect_list("triple_ord")).alias("triple_ords"))
