"""Chunking of texts: paragraphs packed to a size (F22), and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import strip, word_count, words


def fixed_parts(text: Column, separator: str, size: int) -> Column:
    """Array of chunk texts, blank ones included.

    Paragraphs gather until the next would pass ``size`` words; the last paragraph of a
    chunk of several opens the next one.
    """
    quoted = "\\Q" + separator + "\\E"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        n = word_count(p)
        full = (a["n"] + n > size) & (F.size(a["cur"]) > 0)
        last = F.element_at(a["cur"], -1)
        carried = F.when((F.size(a["cur"]) > 1) & (last != ""), F.array(last)).otherwise(F.array().cast("array<string>"))
        carry_n = F.when(F.size(carried) > 0, word_count(last)).otherwise(0)
        return F.when(
            full,
            F.struct(F.concat(a["done"], F.array(F.array_join(a["cur"], " "))).alias("done"), F.concat(carried, F.array(p)).alias("cur"), (carry_n + n).alias("n")),
        ).otherwise(F.struct(a["done"].alias("done"), F.concat(a["cur"], F.array(p)).alias("cur"), (a["n"] + n).alias("n")))

    return F.aggregate(F.split(text, quoted), start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["done"]))


def fixed_chunks(docs: DataFrame, separator: str = "\n\n", size: int = 1500, source: str = "source", text: str = "text") -> DataFrame:
    """id, source, index, text, word_count; ids keep the place among blank chunks too."""
    parts = docs.select(F.col(source).alias("source"), F.posexplode(fixed_parts(F.coalesce(F.col(text), F.lit("")), separator, size)).alias("index", "text"))
    parts = parts.withColumn("text", strip("text")).where("text <> ''")
    return parts.select(F.concat("source", F.lit("_chunk_"), F.col("index")).alias("id"), "source", "index", "text", word_count("text").alias("word_count"))


def sliding_chunks(docs: DataFrame, size: int = 1500, overlap: int = 250, source: str = "source", text: str = "text") -> DataFrame:
    """id, source, index, text, word_count of windows of ``size`` words every ``size - overlap``."""
    step = size - overlap
    if step == 0:
        raise ValueError("the overlap must differ from the chunk size")
    w = docs.select(F.col(source).alias("source"), words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    if step < 0:
        w = w.limit(0)
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(abs(step)))).otherwise(F.array().cast("array<int>"))
    rows = w.select("source", "w", F.posexplode(starts).alias("index", "start"))
    rows = rows.select("source", "index", F.slice("w", F.col("start") + 1, F.lit(size)).alias("w"))
    return rows.select(F.concat("source", F.lit("_chunk_"), F.col("index")).alias("id"), "source", "index", F.array_join("w", " ").alias("text"), F.size("w").alias("word_count"))
