"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session (as in tests) gets a temporary
    one of this process, and a cluster, whose executors could not see that, an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    return _OWN[key]


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it survives the loss of executors."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Written once as Parquet to the shared folder, for rows that are read several times; later
    plans read only the columns that they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "ord", first: int = 0) -> DataFrame:
    """Rows numbered from ``first`` in an order, without a window over all of them.

    Range partitions are sorted and cut; each row adds its place in its partition to the sizes
    of the partitions before, of which the driver sees one count each.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_row", F.monotonically_increasing_id()))
    part, at = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], first
    for p, n in sizes:
        starts.append((p, total))
        total += n
    of = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return placed.withColumn("_part", part).join(F.broadcast(of), "_part").withColumn(name, F.col("_start") + at).drop("_part", "_start", "_row")
