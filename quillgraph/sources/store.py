"""The graph store: Parquet tables, readers of exchange formats, and exports."""

from __future__ import annotations

import uuid

import pyarrow.fs
from py4j.protocol import Py4JJavaError
from pyspark.errors import SparkRuntimeException as SparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillgraph.functions.text import cypher_quote, parse_types, render_types, xml_escape
from quillgraph.schemas import CHUNKS, EDGES, NODES, SNAPSHOT, TRIPLES


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table; an empty one where there is no such path."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_chunks(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Stored chunks: ``parquet`` as ``write_chunks`` makes them, or ``json`` documents
    (``*_chunks.json``), broken ones left out."""
    if fmt == "parquet":
        return read_or_empty(spark, path, CHUNKS)
    raw = spark.read.schema(CHUNKS + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", "true").option("pathGlobFilter", "*_chunks.json").json(path)
    return raw.where("_corrupt_record is null and id is not null").drop("_corrupt_record")


def write_chunks(chunks: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: by source; as ``json`` one array a source, in files that ``read_chunks`` reads."""
    if fmt == "parquet":
        chunks.write.mode("overwrite").partitionBy("source").parquet(path)
        return
    fields = [c.strip().split(" ")[0] for c in CHUNKS.split(",")]
    rows = chunks.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("index", "id", F.struct(*(f for f in fields if f in chunks.columns)).alias("c")))).alias("l"))
    name = F.concat(F.regexp_replace("source", r"\.[^.]*$", ""), F.lit("_chunks.json"))
    write_pages(rows.select(name.alias("filename"), F.to_json(F.transform("l", lambda x: x["c"])).alias("content")), path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """S12."""
    return read_or_empty(spark, path, TRIPLES)


def write_triples(triples: DataFrame, path: str) -> None:
    """K2."""
    triples.write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """S13."""
    return read_or_empty(spark, path, SNAPSHOT)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """The new snapshot is written beside the old one and then named; readers see one or the other."""
    version = uuid.uuid4().hex
    snapshot.select("path", "hash", "chunk_ids").write.parquet(f"{path.rstrip('/')}/{version}")
    snapshot.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/current")


def current_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """S13 of what ``write_snapshot`` named last; empty where there is none."""
    found = [r.value for r in read_or_empty(spark, f"{path.rstrip('/')}/current", "value string", "text").collect()]
    return read_snapshot(spark, f"{path.rstrip('/')}/{found[0]}") if found else spark.createDataFrame([], SNAPSHOT)


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    """Empty where there are none."""
    return read_or_empty(spark, path, "entity string, degree bigint, pagerank double, betweenness double", "json")


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


class GraphStore:
    """Nodes and edges in Parquet; a save writes beside and swaps a pointer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, nodes: DataFrame, edges: DataFrame) -> str:
        version = uuid.uuid4().hex
        nodes.write.parquet(f"{self.path}/{version}/nodes")
        edges.write.parquet(f"{self.path}/{version}/edges")
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{self.path}/current")
        return version

    def export(self, nodes: DataFrame, edges: DataFrame) -> None:
        """K6: the graph, and the three exchange formats beside it."""
        self.save(nodes, edges)
        write_lines(graphml(nodes, edges), f"{self.path}/graph.graphml")
        write_lines(gexf(nodes, edges), f"{self.path}/graph.gexf")
        write_json_graph(nodes, edges, f"{self.path}/graph.json")

    def load(self) -> tuple[DataFrame, DataFrame]:
        """An empty graph where nothing was saved."""
        current = [r.value for r in read_or_empty(self.spark, f"{self.path}/current", "value string", "text").collect()]
        if not current:
            return self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES)
        at = f"{self.path}/{current[0]}"
        return self.spark.read.schema(NODES).parquet(f"{at}/nodes"), self.spark.read.schema(EDGES).parquet(f"{at}/edges")


# --- exports: lines with their order, so that one writer can put them out


def _ordered(*parts: DataFrame) -> DataFrame:
    out = None
    for k, p in enumerate(parts):
        p = p.select(F.lit(k).alias("part"), "key", "line")
        out = p if out is None else out.unionByName(p)
    return out


def _fixed(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit("").alias("key"), F.lit(text).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file in order; such exports are for graphs that one reader can take."""
    lines.orderBy("part", "key").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _data(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'<data key="{key}">'), xml_escape(value), F.lit("</data>"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K3: part, key, line."""
    spark = nodes.sparkSession
    keys = "".join(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="{t}"/>' for k, f, t in (("types", "node", "string"), ("relation", "edge", "string"), ("confidence", "edge", "double"), ("source_text", "edge", "string"), ("source_chunk", "edge", "string")))
    head = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'
    n = nodes.select(F.col("name").alias("key"), F.concat(F.lit('<node id="'), xml_escape("name"), F.lit('">'), _data("types", render_types("types")), F.lit("</node>")).alias("line"))
    e = edges.select(F.concat_ws("\u0001", "src", "dst").alias("key"), F.concat(F.lit('<edge source="'), xml_escape("src"), F.lit('" target="'), xml_escape("dst"), F.lit('">'), _data("relation", F.col("relation")), _data("confidence", F.coalesce("confidence", F.lit(0.0)).cast("string")), _data("source_text", F.col("source_text")), _data("source_chunk", F.col("source_chunk")), F.lit("</edge>")).alias("line"))
    return _ordered(_fixed(spark, head), n, e, _fixed(spark, "</graph></graphml>"))


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K4."""
    spark = nodes.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><attributes class="node"><attribute id="types" title="types" type="string"/></attributes><attributes class="edge"><attribute id="relation" title="relation" type="string"/><attribute id="confidence" title="confidence" type="double"/></attributes><nodes>'
    value = lambda k, c: F.concat(F.lit(f'<attvalue for="{k}" value="'), xml_escape(c), F.lit('"/>'))
    n = nodes.select(F.col("name").alias("key"), F.concat(F.lit('<node id="'), xml_escape("name"), F.lit('" label="'), xml_escape("name"), F.lit('"><attvalues>'), value("types", render_types("types")), F.lit("</attvalues></node>")).alias("line"))
    e = edges.select(F.concat_ws("\u0001", "src", "dst").alias("key"), F.concat(F.lit('<edge source="'), xml_escape("src"), F.lit('" target="'), xml_escape("dst"), F.lit('"><attvalues>'), value("relation", F.col("relation")), value("confidence", F.coalesce("confidence", F.lit(0.0)).cast("string")), F.lit("</attvalues></edge>")).alias("line"))
    return _ordered(_fixed(spark, head), n, _fixed(spark, "</nodes><edges>"), e, _fixed(spark, "</edges></graph></gexf>"))


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K5 row by row: part 0 nodes {id, types}, part 1 edges {source, target, ...}."""
    n = nodes.select(F.col("name").alias("key"), F.to_json(F.struct(F.col("name").alias("id"), F.array_sort("types").alias("types"))).alias("line"))
    e = edges.select(F.concat_ws("\u0001", "src", "dst").alias("key"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "confidence", "source_text", "source_chunk")).alias("line"))
    return _ordered(n, e)


def write_json_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K5 as one document; the separators are written around the ordered lines."""
    spark = nodes.sparkSession
    lines = json_lines(nodes, edges)
    first = lines.groupBy("part").agg(F.min("key").alias("first"))
    rows = lines.join(F.broadcast(first), "part").withColumn("line", F.when(F.col("key") == F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")))
    at = lambda p: rows.where(F.col("part") == p).select("key", "line")
    write_lines(_ordered(_fixed(spark, '{"nodes":['), at(0), _fixed(spark, '],"edges":['), at(1), _fixed(spark, "]}")), path)


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K7 and F16: part, key, line; nodes first."""
    label = F.when(F.array_join("types", "") != "", F.array_join(F.array_sort("types"), "_")).otherwise("Entity")
    n = nodes.select(F.col("name").alias("key"), F.concat(F.lit("CREATE (n:"), label, F.lit(" {name: '"), cypher_quote("name"), F.lit("'})")).alias("line"))
    e = edges.select(F.concat_ws("\u0001", "src", "dst").alias("key"), F.concat(F.lit("MATCH (a {name: '"), cypher_quote("src"), F.lit("'}), (b {name: '"), cypher_quote("dst"), F.lit("'}) CREATE (a)-[:"), F.coalesce("relation", F.lit("RELATED_TO")), F.lit("]->(b)")).alias("line"))
    return _ordered(n, e)


_ATTRIBUTES = r"""(?:\s+[^\s=>/]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of a kind in a file, parsed one by one; kinds do not nest.

    Records of text end where an element closes, so that many tasks share a file.  A record holds
    elements without content, and at its end the beginning of one with content.  Where a comment
    or such could hold such an end, one task reads the file.
    """
    pieces = spark.read.option("lineSep", ">").text(path)
    if not pieces.where(F.col("value").contains("<!")).isEmpty():
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    records = spark.read.option("lineSep", f"</{tag}>").text(path)
    empty = F.regexp_extract_all("value", F.lit(rf"<{tag}{_ATTRIBUTES}/>"), F.lit(0))
    opened = F.regexp_extract("value", rf"(?s)<{tag}{_ATTRIBUTES}>(?!.*<{tag}[\s>]).*$", 0)
    full = F.when(opened != "", F.array(F.concat(opened, F.lit(f"</{tag}>")))).otherwise(F.array().cast("array<string>"))
    return records.select(F.explode(F.concat(empty, full)).alias("x")).select(F.from_xml("x", schema, {"rowTag": tag}).alias("e")).select("e.*")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Types are restored from their rendered form."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    value = lambda k: F.get(F.transform(F.filter("data", lambda d: d["_key"] == k), lambda d: d["_VALUE"]), F.lit(0))
    n = _elements(spark, path, "node", f"_id string, {data}")
    e = _elements(spark, path, "edge", f"_source string, _target string, {data}")
    nodes = n.select(F.col("_id").alias("name"), parse_types(value("types")).alias("types"), F.monotonically_increasing_id().alias("node_ord"))
    edges = e.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), value("relation").alias("relation"), value("confidence").cast("double").alias("confidence"), F.coalesce(value("source_text"), F.lit("")).alias("source_text"), F.coalesce(value("source_chunk"), F.lit("")).alias("source_chunk"), F.lit(False).alias("wiki_updated"))
    return nodes, edges


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S11."""
    data = "attvalues struct<attvalue:array<struct<_for:string,_value:string>>>"
    value = lambda k: F.get(F.transform(F.filter("attvalues.attvalue", lambda d: d["_for"] == k), lambda d: d["_value"]), F.lit(0))
    n = _elements(spark, path, "node", f"_id string, {data}")
    e = _elements(spark, path, "edge", f"_source string, _target string, {data}")
    nodes = n.select(F.col("_id").alias("name"), parse_types(value("types")).alias("types"), F.monotonically_increasing_id().alias("node_ord"))
    edges = e.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), value("relation").alias("relation"), value("confidence").cast("double").alias("confidence"), F.lit("").alias("source_text"), F.lit("").alias("source_chunk"), F.lit(False).alias("wiki_updated"))
    return nodes, edges


def read_json_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``{nodes: [...], edges: [...]}`` in one document."""
    schema = "nodes array<struct<id:string,types:array<string>>>, edges array<struct<source:string,target:string,relation:string,confidence:double,source_text:string,source_chunk:string>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    nodes = doc.select(F.posexplode("nodes").alias("node_ord", "n")).select("n.id", "n.types", "node_ord").select(F.col("id").alias("name"), F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.col("node_ord").cast("long").alias("node_ord"))
    edges = doc.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.relation", "e.confidence", F.coalesce("e.source_text", F.lit("")).alias("source_text"), F.coalesce("e.source_chunk", F.lit("")).alias("source_chunk"), F.lit(False).alias("wiki_updated"))
    return nodes, edges


def load_any(spark: SparkSession, candidates: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first of the named files (graphml, gexf or json) that is there and can be read,
    else an empty graph."""
    for path in candidates:
        reader = read_graphml if path.endswith(".graphml") else read_gexf if path.endswith(".gexf") else read_json_graph
        try:
            found = reader(spark, path)
            if not found[0].isEmpty():
                return found
        except (AnalysisException, SparkException, Py4JJavaError):  # missing or broken
            continue
    return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)


def write_pages(pages: DataFrame, folder: str) -> None:
    """One file a page, by the workers, into a folder that they all reach: a path of a
    shared mount or the address of a store (file, hdfs, s3, gs).  A repeated task writes the
    same files again."""

    def put(rows) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for r in rows:
            tmp = f"{root}/.{r.filename}.{uuid.uuid4().hex}"
            with fs.open_output_stream(tmp) as f:
                f.write(r.content.encode())
            fs.move(tmp, f"{root}/{r.filename}")

    pages.select("filename", "content").foreachPartition(put)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """filename, content."""
    t = spark.read.text(folder, wholetext=True).select("value", "_metadata.file_name")
    return t.select(F.url_decode("file_name").alias("filename"), F.col("value").alias("content")).where("filename <> 'index.md'")
