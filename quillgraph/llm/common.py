"""Plumbing that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch.  Texts are whole, so a batch must hold few of them.
BATCH_ROWS = 256

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a temporary one for this process; on a
    cluster that would be a folder which the executors cannot see, so it is an error there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    return _OWN[key]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing will read it again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release() -> None:
    """Give back what a task held: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` whose function is made once a task; empty batches are skipped."""
    small_batches(df.sparkSession, rows)
    names = df.columns
    if any("`" in c for c in names):  # Spark's method cannot name these
        plain: list[str] = []
        for c in names:
            plain.append(free(c.replace("`", "_"), [*names, *plain]) if "`" in c else c)
        df = df.toDF(*plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield f(batch.rename_columns(names))
        del f
        release()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of whole texts; null is the empty text."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def one_a_document(rows: DataFrame, *by: str) -> DataFrame:
    """Of rows that share ``doc_id`` (and the columns ``by``, which follow from it) the one whose
    text has the least hash, so that a bound on documents is a bound on rows."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("least")
    return rows.groupBy("doc_id", *by).agg(least).select("doc_id", F.col("least.text").alias("text"), *by)


def free(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str]) -> list:
    """Columns by their plain names, whatever is in these."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def joined_by_id(docs: DataFrame, found: DataFrame, how: str, few: int, only: Column | None = None) -> DataFrame:
    """``docs`` (left or left_anti) join ``found`` (saved, of distinct doc_ids, none null) by doc_id.

    ``found`` is broadcast while it has ``few`` rows at most (counted).  Beyond that both are
    shuffled; rows without doc_id match nothing and stay out of the shuffle, and so do those
    that by ``only`` (never null) cannot match.
    """
    columns = [*docs.columns, *(c for c in found.columns if how == "left" and c != "doc_id")]
    if found.limit(few + 1).count() <= few:
        return docs.join(F.broadcast(found), "doc_id", how).select(*named(columns))
    may = F.col("doc_id").isNotNull() if only is None else F.col("doc_id").isNotNull() & only
    rest = docs.where(~may)
    met = docs.where(may).join(found, "doc_id", how).select(*named(columns))
    return met.unionByName(rest, allowMissingColumns=True)


class Memo(dict):
    """A bounded memo of two generations: ``memo[key]`` computes what is missing.

    When the young one has ``most / 2`` entries it becomes the old one, and the old one goes;
    what is asked for meanwhile moves back to the young one, so frequent keys stay.
    """

    def __init__(self, f: Callable, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.f, self.half, self.longest, self.old = f, most // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def open_shared(path: str):
    """A file system that the workers reach themselves, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)
