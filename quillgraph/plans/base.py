"""The relational graph that the registered queries work on, and its SQL twin.

Suppliers supply parts (the relation depends on the return flag, the confidence on the
quantity), customers and suppliers stand in nations, nations in regions.  ``triple_ord`` is
computed from keys, not by a global row number, so nothing meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _triples(df: DataFrame, s, st: str, r, o, ot: str, conf, chunk, order) -> DataFrame:
    return df.select(s.alias("subject"), F.lit(st).alias("subject_type"), r.alias("relation"), o.alias("object"), F.lit(ot).alias("object_type"), conf.cast("double").alias("confidence"), F.lit("").alias("source_text"), chunk.alias("source_chunk"), order.cast("long").alias("triple_ord"))


def supply_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    relation = F.when(F.col("l_returnflag") == "R", "RECALLED").when(F.col("l_returnflag") == "A", "ARCHIVED").otherwise("SUPPLIES")
    return _triples(li, _key("supplier", "l_suppkey"), "SUPPLIER", relation, _key("part", "l_partkey"), "PART", F.round(F.col("l_quantity") / 50, 2), F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit("_chunk_"), F.col("l_linenumber").cast("string")), F.lit(10**12) + F.col("l_orderkey") * 8 + F.col("l_linenumber"))


def place_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    chunk = lambda kind: F.lit(f"{kind}_row_0")
    nation = F.concat(F.lit("nation:"), F.col("n_name"))
    names = n.select("n_nationkey", "n_name")
    out = _triples(n.join(r, n["n_regionkey"] == r["r_regionkey"]), nation, "NATION", F.lit("PART_OF"), F.concat(F.lit("region:"), F.col("r_name")), "REGION", F.lit(1.0), chunk("nation"), F.col("n_nationkey"))
    out = out.unionByName(_triples(c.join(names, c["c_nationkey"] == names["n_nationkey"]), _key("customer", "c_custkey"), "CUSTOMER", F.lit("LOCATED_IN"), nation, "NATION", F.lit(0.9), chunk("customer"), F.lit(10**9) + F.col("c_custkey")))
    return out.unionByName(_triples(s.join(names, s["s_nationkey"] == names["n_nationkey"]), _key("supplier", "s_suppkey"), "SUPPLIER", F.lit("LOCATED_IN"), nation, "NATION", F.lit(0.4), chunk("supplier"), F.lit(2 * 10**9) + F.col("s_suppkey")))


def chain_edges(spark: SparkSession, sf_dir: str, which: str = "true", distinct: bool = True) -> DataFrame:
    """Edges of paths: orders, their parts' suppliers, places.  ``which``: a condition on order lines, for tests.

    Without ``distinct`` an edge has as many rows as it has order lines.
    """
    li, o = table(spark, sf_dir, "lineitem").where(which), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ordered = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(_key("customer", "o_custkey").alias("src"), _key("part", "l_partkey").alias("dst"), F.lit("ORDERED").alias("relation"))
    supplied = li.select(_key("part", "l_partkey").alias("src"), _key("supplier", "l_suppkey").alias("dst"), F.lit("SUPPLIED_BY").alias("relation"))
    if distinct:
        ordered, supplied = ordered.distinct(), supplied.distinct()
    places = place_triples(spark, sf_dir).select(F.col("subject").alias("src"), F.col("object").alias("dst"), "relation")
    return ordered.unionByName(supplied).unionByName(places)


# --- the same in DuckDB's SQL, as common table expressions

PLACES_SQL = """places AS (
  SELECT 'nation:' || n_name AS subject, 'NATION' AS subject_type, 'PART_OF' AS relation, 'region:' || r_name AS object, 'REGION' AS object_type, 1.0::DOUBLE AS confidence, 'nation_row_0' AS source_chunk, n_nationkey::BIGINT AS triple_ord FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer:' || c_custkey, 'CUSTOMER', 'LOCATED_IN', 'nation:' || n_name, 'NATION', 0.9, 'customer_row_0', 1000000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'SUPPLIER', 'LOCATED_IN', 'nation:' || n_name, 'NATION', 0.4, 'supplier_row_0', 2000000000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
SUPPLY_SQL = """supply AS (
  SELECT 'supplier:' || l_suppkey AS subject, 'SUPPLIER' AS subject_type, CASE l_returnflag WHEN 'R' THEN 'RECALLED' WHEN 'A' THEN 'ARCHIVED' ELSE 'SUPPLIES' END AS relation, 'part:' || l_partkey AS object, 'PART' AS object_type, round(l_quantity / 50, 2) AS confidence, 'order_' || l_orderkey || '_chunk_' || l_linenumber AS source_chunk, 1000000000000 + l_orderkey * 8 + l_linenumber AS triple_ord FROM lineitem)"""
TRIPLES_SQL = f"{PLACES_SQL}, {SUPPLY_SQL}, triples AS (SELECT * FROM places UNION ALL SELECT * FROM supply)"


def fold_sql(of: str = "triples") -> str:
    return f"""edges AS (SELECT subject AS src, object AS dst, relation, confidence, source_chunk FROM (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY confidence DESC, triple_ord) AS k FROM {of}) WHERE k = 1),
nodes AS (SELECT name, list_sort(list_distinct(list(type))) AS types, min(o) AS node_ord FROM (SELECT subject AS name, subject_type AS type, triple_ord * 2 AS o FROM {of} UNION ALL SELECT object, object_type, triple_ord * 2 + 1 FROM {of}) GROUP BY name)"""


GRAPH_SQL = f"{TRIPLES_SQL}, {fold_sql()}"
PLACE_GRAPH_SQL = f"{PLACES_SQL}, {fold_sql('places')}"
DEGREE_SQL = "ends AS (SELECT src AS name, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges), deg AS (SELECT n.name, coalesce(sum(i), 0)::BIGINT AS in_degree, coalesce(sum(o), 0)::BIGINT AS out_degree, coalesce(sum(i) + sum(o), 0)::BIGINT AS degree FROM nodes n LEFT JOIN ends e ON n.name = e.name GROUP BY n.name)"
NEAR_SQL = "near AS (SELECT src AS entity, 'outgoing' AS direction, relation, dst AS other, confidence, source_chunk FROM edges UNION ALL SELECT dst, 'incoming', relation, src, confidence, source_chunk FROM edges)"


def chain_sql(which: str = "true") -> str:
    return f"""{PLACES_SQL}, chain AS (
  SELECT DISTINCT 'customer:' || o_custkey AS src, 'part:' || l_partkey AS dst, 'ORDERED' AS relation FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {which}
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY' FROM lineitem WHERE {which}
  UNION ALL SELECT subject, object, relation FROM places)"""
