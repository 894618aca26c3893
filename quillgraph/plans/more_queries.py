"""Further registered queries: files and stores written and read again, and functions of tables."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import extract, graph, incremental, resolve, vectors, wiki
from quillgraph.operators.iterate import shared_folder
from quillgraph.plans import base
from quillgraph.plans.api import Api
from quillgraph.plans.base import DEGREE_SQL, GRAPH_SQL, NEAR_SQL, PLACE_GRAPH_SQL, fold_sql, table
from quillgraph.plans.queries import _COUNTS_SQL, _EDITS_SQL, _PAGES_SQL, _PAIRS_SQL, _SNAP_SQL, _TOKENS_SQL, _WORDS_SQL, _all, _edited, _file, _file_sql, _graph, _kept_graph, _part_names, _places, _snapshots, _topk_sql, query
from quillgraph.plans.search import hybrid
from quillgraph.schemas import Settings
from quillgraph.sources import files, remote, store


def _folder(spark, tag: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


# --- scans and readers


@query("SELECT lang, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def scanned_files(spark, d):
    """Texts written as files by language, found again below their folder.

    A line is a mark and a text, so that blank and missing texts are lines too; folders are named
    by the language's bytes, so that any name, a blank and a missing one stay apart.
    """
    path = _folder(spark, "scan")
    docs = table(spark, d, "documents")
    line = F.coalesce(F.concat(F.lit("="), F.translate("text", "\n", "\u0001")), F.lit("-"))
    folder = F.coalesce(F.concat(F.lit("x"), F.hex(F.encode("lang", "UTF-8"))), F.lit("none"))
    docs.select(folder.alias("lang"), line.alias("value")).write.partitionBy("lang").option("maxRecordsPerFile", 5000).text(path)
    found = files.discover(spark, path).select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), F.decode("content", "UTF-8").alias("t"))
    lines = found.select("lang", F.explode(F.split("t", "\n")).alias("line")).where("line <> ''")
    text = F.when(F.col("line").startswith("="), F.octet_length("line") - 1)
    by = lines.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(text).cast("long").alias("bytes"))
    return by.select(F.when(F.col("lang") != "none", F.decode(F.unhex(F.substring("lang", 2, 2**30)), "UTF-8")).alias("lang"), "n", "bytes")


@query(f"""WITH f AS (SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS source, {_WORDS_SQL} AS w FROM documents), r AS (SELECT source, w, unnest(range(0, len(w), 150)) AS s FROM f)
SELECT source || '_chunk_' || (s // 150) AS id, source, (s // 150)::INT AS index, md5(array_to_string(w[s + 1 : s + 200], ' ')) AS digest, len(w[s + 1 : s + 200])::INT AS word_count FROM r""")
def text_file_chunks(spark, d):
    """Markdown and plain files, by sliding windows."""
    docs = table(spark, d, "documents")
    name, content = F.concat(F.lit("d"), "doc_id"), F.col("text")
    found = docs.where("doc_id % 2 = 0").select(*_file(name, "md", content)).unionByName(docs.where("doc_id % 2 <> 0").select(*_file(name, "txt", content)))
    return files.chunk_files(found, Settings(strategy="sliding_window", chunk_size=200, overlap=50)).select("id", "source", "index", F.md5(F.col("text").cast("binary")).alias("digest"), "word_count")


@query("""SELECT 'p' || p_partkey || '.' || e || '_image_0' AS id, '[Image file: p' || p_partkey || '.' || e || ']' AS text, 4 AS word_count, '/tables/p' || p_partkey || '.' || e AS image_path, m AS mime
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'webp' END AS e, CASE p_partkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/webp' END AS m FROM part)""")
def image_chunks(spark, d):
    """S8 and F20's types."""
    p, out = table(spark, d, "part"), None
    for k, ext in enumerate(("png", "jpg", "webp")):
        some = p.where(F.col("p_partkey") % 3 == k).select(*_file(F.concat(F.lit("p"), "p_partkey"), ext, F.lit("x")))
        out = some if out is None else out.unionByName(some)
    return files.chunk_files(out).select("id", "text", "word_count", "image_path", T.mime_of("image_path").alias("mime"))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def _zip(parts: dict[str, str]) -> bytes:
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return f.getvalue()


def _relations(targets: list[str]) -> str:
    return f"<Relationships {_RELS}>" + "".join(f'<Relationship Id="r{k}" Target="{t}"/>' for k, t in enumerate(targets)) + "</Relationships>"


def _docx(names: list[str]) -> bytes:
    body = "<w:p/>".join(f"<w:p><w:r><w:t>  {escape(n)}</w:t></w:r></w:p>" for n in names)
    return _zip({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>"})


def _xlsx(names: list[str]) -> bytes:
    cells = lambda row, values: f'<row r="{row}">' + "".join(f'<c r="{c}{row}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{c}{row}"><v>{v}</v></c>' for c, v in zip("AB", values, strict=True)) + "</row>"
    rows = cells(1, ["nation", "place"]) + "".join(cells(k + 2, [n, k + 1]) for k, n in enumerate(names))
    return _zip({"xl/workbook.xml": f'<workbook {_S} {_R}><sheets><sheet name="N" sheetId="1" r:id="r0"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _relations(["worksheets/sheet1.xml"]), "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{rows}</sheetData></worksheet>"})


def _pptx(names: list[str]) -> bytes:
    ids = "".join(f'<p:sldId id="{256 + k}" r:id="r{k}"/>' for k in range(len(names)))
    slides = {f"ppt/slides/s{k}.xml": f"<p:sld {_P} {_A}><a:p><a:r><a:t>{escape(n)}</a:t></a:r></a:p><a:p/><a:p><a:r><a:t>second</a:t></a:r></a:p></p:sld>" for k, n in enumerate(names)}
    return _zip({"ppt/presentation.xml": f"<p:presentation {_P} {_R}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _relations([f"slides/s{k}.xml" for k in range(len(names))])} | slides)


_OFFICE = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}
_NATIONS_SQL = "n AS (SELECT r_name AS r, n_name AS n, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _office(spark, d, ext: str) -> DataFrame:
    """Chunks of one file a region with the names of its nations."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    by = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("r")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    make = _OFFICE[ext]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"r": pdf.r, "content": [make(list(x)) for x in pdf.names]})

    return files.chunk_files(by.mapInPandas(run, "r string, content binary").select(*_file(F.col("r"), ext, F.col("content")))).select("id", "source", "text")


@query(f"WITH {_NATIONS_SQL} SELECT r || '.docx_chunk_0' AS id, r || '.docx' AS source, string_agg(n, ' ' ORDER BY n) AS text FROM n GROUP BY r")
def docx_chunks(spark, d):
    """S5."""
    return _office(spark, d, "docx")


@query(f"WITH {_NATIONS_SQL} SELECT r || '.xlsx_N_row_' || (k + 1) AS id, r || '.xlsx' AS source, 'Sheet=N, 行 ' || (k + 1) || ':, nation=' || n || ', place=' || k AS text FROM n")
def xlsx_rows(spark, d):
    """S6."""
    return _office(spark, d, "xlsx")


@query(f"WITH {_NATIONS_SQL} SELECT r || '.pptx_slide_' || k AS id, r || '.pptx' AS source, n || chr(10) || 'second' AS text FROM n")
def pptx_slides(spark, d):
    """S7."""
    return _office(spark, d, "pptx")


# --- stores


def _chunks(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("id"), "source", F.lit(0).alias("index"), "text", T.word_count("text").alias("word_count"), F.lit(None).cast("string").alias("image_path"), F.col("doc_id").cast("long").alias("ord"))


@query(f"SELECT 'c' || doc_id AS id, source, len({_WORDS_SQL})::INT AS word_count, md5(text) AS digest FROM documents")
def chunk_store(spark, d):
    """Parquet by source."""
    path = _folder(spark, "chunks")
    store.write_chunks(_chunks(spark, d), path)
    return store.read_chunks(spark, path, "parquet").select("id", "source", "word_count", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey || '.md' AS source, n_name AS text FROM nation")
def chunk_documents(spark, d):
    """JSON documents."""
    path = _folder(spark, "chunks")
    n = table(spark, d, "nation")
    chunks = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey", F.lit(".md")).alias("source"), F.col("n_nationkey").cast("int").alias("index"), F.col("n_name").alias("text"), F.lit(1).alias("word_count"), F.lit(None).cast("string").alias("image_path"), F.col("n_nationkey").cast("long").alias("ord"))
    store.write_chunks(chunks, path, "json")
    return store.read_chunks(spark, path).select("id", "source", "text")


@query(f"WITH {GRAPH_SQL} SELECT subject, subject_type, relation, object, object_type, confidence, source_chunk, triple_ord FROM triples")
def triple_store(spark, d):
    """S12, K2."""
    path = _folder(spark, "triples")
    store.write_triples(_all(spark, d), path)
    return store.read_triples(spark, path).drop("source_text")


@query(f"WITH {GRAPH_SQL} SELECT src, dst, relation, confidence, source_chunk, array_to_string(types, ',') AS types FROM edges JOIN nodes ON name = src")
def graph_store(spark, d):
    """Nodes and edges saved and loaded."""
    s = store.GraphStore(spark, _folder(spark, "graph"))
    s.save(*_graph(spark, d))
    nodes, edges = s.load()
    return edges.join(nodes, F.col("src") == F.col("name")).select("src", "dst", "relation", "confidence", "source_chunk", F.array_join("types", ",").alias("types"))


def _read_again(spark, d, form: str) -> DataFrame:
    s = store.GraphStore(spark, _folder(spark, "exports"))
    s.export(*_places(spark, d))
    nodes, edges = store.load_any(spark, [f"{s.path}/nothing.json", f"{s.path}/graph.{form}"])
    return edges.join(nodes, F.col("src") == F.col("name")).select("src", "dst", "relation", "confidence", T.render_types("types").alias("types"))


_AGAIN_SQL = f"WITH {PLACE_GRAPH_SQL} SELECT src, dst, relation, confidence, array_to_string(types, ', ') AS types FROM edges JOIN nodes ON name = src"


@query(_AGAIN_SQL)
def graphml_again(spark, d):
    """Written with its edges and read again."""
    return _read_again(spark, d, "graphml")


@query(_AGAIN_SQL)
def gexf_again(spark, d):
    """S11, K4, K6."""
    return _read_again(spark, d, "gexf")


@query(_AGAIN_SQL)
def graph_json_again(spark, d):
    """S11, K5, K6."""
    return _read_again(spark, d, "json")


@query(f"WITH {_SNAP_SQL} SELECT path, hash FROM now")
def snapshot_store(spark, d):
    """A second snapshot takes the place of the first."""
    path = _folder(spark, "snapshot")
    now, old = _snapshots(spark, d)
    store.write_snapshot(old, path)
    store.write_snapshot(now.withColumn("chunk_ids", F.array().cast("array<string>")), path)
    return store.current_snapshot(spark, path).select("path", "hash")


@query(f"WITH {GRAPH_SQL}, {DEGREE_SQL} SELECT name AS entity, degree, 0.5::DOUBLE AS pagerank, 0.25::DOUBLE AS betweenness FROM deg")
def insight_files(spark, d):
    """A report in JSON lines."""
    path = _folder(spark, "insights")
    store.write_report(graph.degrees(*_graph(spark, d)).select(F.col("name").alias("entity"), "degree", F.lit(0.5).alias("pagerank"), F.lit(0.25).alias("betweenness")), path)
    return store.read_insights(spark, path)


@query(f"WITH {_COUNTS_SQL} SELECT doc_id::VARCHAR AS key, count(*) AS n, round(sum(weight * df.idf), 6) AS total FROM wt JOIN df ON wt.term = df.term GROUP BY doc_id")
def index_files(spark, d):
    """The index saved and loaded."""
    path = _folder(spark, "index")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    vectors.save_index(vectors.build_index(docs), path)
    weights, idf = vectors.load_index(spark, path)
    return weights.join(idf, "term").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("weight") * F.col("idf")), 6).alias("total"))


#: The graph of nations and regions.
_LAND_SQL = f"""land AS (SELECT 'nation:' || n_name AS subject, 'NATION' AS subject_type, 'PART_OF' AS relation, 'region:' || r_name AS object, 'REGION' AS object_type, 1.0::DOUBLE AS confidence, 'nation_row_0' AS source_chunk, n_nationkey::BIGINT AS triple_ord FROM nation JOIN region ON n_regionkey = r_regionkey), {fold_sql('land')}"""


def _land_pages(spark, d) -> DataFrame:
    land = base.place_triples(spark, d).where("subject_type = 'NATION'")
    return wiki.compile_pages(*graph.build(land))


@query(f"WITH {_LAND_SQL}, {_PAGES_SQL} SELECT filename, md5(content) AS digest FROM pages")
def page_files(spark, d):
    """Pages as files, read again."""
    path = _folder(spark, "wiki")
    store.write_pages(_land_pages(spark, d), path)
    return store.read_pages(spark, path).select("filename", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"WITH {_LAND_SQL}, {_PAGES_SQL} SELECT filename, md5(content) AS digest FROM pages WHERE name = 'nation:NATION_3'")
def page_of_entity(spark, d):
    """S16, J13."""
    return wiki.page_of(_land_pages(spark, d), "nation:NATION_3").select("filename", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"WITH {GRAPH_SQL}, {NEAR_SQL} SELECT entity, count(DISTINCT s) AS n_sources, min(s) AS main_source FROM (SELECT entity, CASE WHEN source_chunk LIKE 'order%' THEN 'file' || (split_part(source_chunk, '_', 2)::BIGINT % 10) ELSE regexp_extract(source_chunk, '^(.*)_row_', 1) END AS s FROM near) GROUP BY entity")
def chunk_table_sources(spark, d):
    """Sources by the chunk table, by the chunk's name where it has none."""
    li = table(spark, d, "lineitem")
    chunks = li.select(F.concat(F.lit("order_"), "l_orderkey", F.lit("_chunk_"), "l_linenumber").alias("id"), F.concat(F.lit("file"), (F.col("l_orderkey") % 10).cast("string")).alias("source"))
    return wiki.entity_sources(_graph(spark, d)[1], chunks).select("entity", F.size("sources").cast("long").alias("n_sources"), F.get("sources", F.lit(0)).alias("main_source"))


@query("""WITH l AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN trim(coalesce(text, ''), ' ') WHEN 1 THEN '## ' || trim(coalesce(text, ''), ' ') WHEN 2 THEN '- ' || trim(coalesce(text, ''), ' ') WHEN 3 THEN '![image](img_' || role || '.bin)' WHEN 4 THEN '[table]' END AS line FROM conversations)
SELECT conv_id, md5(coalesce(string_agg(line, chr(10) ORDER BY turn, line) FILTER (line <> ''), '')) AS digest FROM l GROUP BY conv_id""")
def blocks_markdown(spark, d):
    """A conversation's turns as blocks of all kinds."""
    kinds = F.array(*map(F.lit, (1, 3, 10, 7, 4, 99)))
    kind = F.get(kinds, (F.col("turn") % 6).cast("int"))
    block = F.struct("turn", F.struct(kind.alias("block_type"), "text", F.lit(2).alias("style"), F.col("role").alias("image")).alias("b"))
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("l"))
    return by.select("conv_id", F.md5(remote.blocks_to_markdown(F.transform("l", lambda x: x["b"])).cast("binary")).alias("digest"))


# --- extraction and retrieval


def _echo(text: str, chunk_id: str, contexts, image_path=None) -> str:
    """Two triples a text, one of them doubtful; no answer for every fifth."""
    if int(chunk_id[1:]) % 5 == 0:
        raise ValueError("no answer")
    one = {"subject": f" {chunk_id} ", "subject_type": "CHUNK", "relation": "HAS", "object": str(len(text)), "object_type": "SIZE", "source_text": text[:10]}
    return "Here: " + json.dumps([one | {"confidence": 0.9}, one | {"confidence": 0.3}, one | {"object": "x", "confidence": 0.7}])


_FIVE = "WHERE doc_id % 5 <> 0"


@query(f"SELECT 'c' || doc_id AS source_chunk, ' c' || doc_id || ' ' AS subject, 'HAS' AS relation, length(text)::VARCHAR AS object, 0.9::DOUBLE AS confidence, doc_id * 16777216 AS triple_ord FROM documents {_FIVE} UNION ALL SELECT 'c' || doc_id, ' c' || doc_id || ' ', 'HAS', 'x', 0.7, doc_id * 16777216 + 2 FROM documents {_FIVE}")
def extracted_triples(spark, d):
    """A backend's answers with provenance and ordinals."""
    return extract.extract(_chunks(spark, d), _echo).select("source_chunk", "subject", "relation", "object", "confidence", "triple_ord")


@query("SELECT 'c' || doc_id AS id, 'mark' AS source_chunk FROM documents")
def stamped_triples(spark, d):
    """P2."""
    return graph.stamp(table(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("id")), "mark")


_BENCH_TOPK = _topk_sql("SELECT doc_id AS query_id, text FROM documents", 3).replace("FROM documents", "FROM bench")


@query("WITH bench AS (SELECT item_id AS doc_id, text FROM benchmark), " + _BENCH_TOPK.removeprefix("WITH ") + " AND doc_id <> query_id")
def contexts_without_self(spark, d):
    """Each item's nearest others."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    hits = vectors.top_k(vectors.build_index(b), b.select(F.col("id").alias("query_id"), "text"), b.select(F.col("id").alias("key"), F.col("id").alias("idx")), 3)
    return vectors.without_self(hits).select("query_id", F.col("key").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_COUNTS_SQL} SELECT term, df, round(idf, 9) AS idf FROM df")
def index_append(spark, d):
    """Half of the texts, then the rest."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return vectors.add_chunks(docs.where("id % 2 = 0"), docs.where("id % 2 <> 0"))[1][1].select("term", "df", F.round("idf", 9).alias("idf"))


@query("SELECT * FROM (VALUES ('same', false), ('fewer', (SELECT count(*) > 0 FROM documents)), ('changed', (SELECT count(*) > 0 FROM documents))) AS t(kind, stale)")
def index_staleness(spark, d):
    """V5."""
    c = table(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("id"), "text", F.col("doc_id").alias("ord"))
    least = c.agg(F.min("ord").alias("m"))
    changed = c.join(F.broadcast(least), F.lit(True)).withColumn("text", F.when(F.col("ord") == F.col("m"), F.lit("other")).otherwise(F.col("text"))).drop("m")
    fewer = c.join(F.broadcast(least), F.col("ord") > F.col("m")).drop("m")
    out = None
    for kind, now in (("same", c), ("fewer", fewer), ("changed", changed)):
        row = vectors.needs_rebuild(c, now).select(F.lit(kind).alias("kind"), "stale")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {PLACE_GRAPH_SQL}, {DEGREE_SQL}, v AS ({_topk_sql("SELECT 1 AS query_id, 'on' AS text", 5).replace("SELECT query_id, doc_id, rank", "SELECT doc_id, rank")}),
h AS (SELECT n.name, array_to_string(types, ', ') AS type, degree, row_number() OVER (ORDER BY node_ord) AS k FROM nodes n JOIN deg ON n.name = deg.name WHERE contains(lower(n.name), 'on'))
SELECT 'vector' AS section, rank::INT AS rank, v.doc_id::VARCHAR AS key, substring(text, 1, 300) AS detail, score FROM v JOIN documents ON v.doc_id = documents.doc_id UNION ALL SELECT 'graph', k::INT, name, type, degree::DOUBLE FROM h WHERE k <= 10""")
def hybrid_names(spark, d):
    """V7: passages and names."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("ord"))
    return hybrid("on", vectors.build_index(chunks), chunks, *_places(spark, d)).withColumn("score", F.round("score", 6))


# --- names, pages, changes


_RESOLVED = f"""WITH RECURSIVE {_PAIRS_SQL}, sim AS (SELECT name, earlier FROM pairs WHERE s >= 0.75 - 1e-9), o AS (SELECT name, row_number() OVER (ORDER BY ord) AS k FROM n),
r(k, leaders, canon) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR UNION ALL
  SELECT o.k, CASE WHEN m.c IS NULL THEN list_append(r.leaders, o.name) ELSE r.leaders END, coalesce(m.c, o.name)
  FROM r JOIN o ON o.k = r.k + 1 LEFT JOIN (SELECT sim.name, r2.k, r2.leaders, min_by(sim.earlier, list_position(r2.leaders, sim.earlier)) FILTER (list_contains(r2.leaders, sim.earlier)) AS c FROM sim, r r2 GROUP BY ALL) m ON m.name = o.name AND m.k = r.k),
canon AS (SELECT o.name, r.canon AS canonical FROM r JOIN o ON o.k = r.k)"""


@query(f"{_RESOLVED} SELECT p_partkey, canonical AS subject, '' AS object FROM part JOIN canon ON p_name = name")
def rewritten_triples(spark, d):
    """Canonical names in place of names; blanks stay."""
    t = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("subject"), F.lit("").alias("object"))
    return resolve.rewrite(t, resolve.resolve_names(_part_names(spark, d), 0.75))


@query(f"{_RESOLVED} SELECT count(DISTINCT canonical) AS entities, count(*) - count(DISTINCT canonical) AS merged FROM canon")
def resolver_stats(spark, d):
    """A16."""
    return resolve.resolver_stats(resolve.resolve_names(_part_names(spark, d), 0.75))


@query(f"WITH {PLACE_GRAPH_SQL}, {_PAGES_SQL} SELECT filename, name AS title, type AS entity_type, coalesce(array_to_string(s, ','), '') AS sources FROM pages JOIN li ON name = entity")
def wiki_heads(spark, d):
    """Front matter, title and type of pages."""
    return wiki.parse_pages(wiki.compile_pages(*_places(spark, d)))[0].select("filename", "title", "entity_type", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {PLACE_GRAPH_SQL}, {_EDITS_SQL} SELECT src AS entity FROM edges WHERE src LIKE 'supplier:%' UNION SELECT src FROM moved")
def changed_entities(spark, d):
    """P16."""
    return wiki.has_changes(wiki.diff_pages(*_edited(spark, d)))


@query(f"""WITH {PLACE_GRAPH_SQL}, {_EDITS_SQL}, c AS (SELECT 'updated' AS action FROM edges WHERE src LIKE 'supplier:%' UNION ALL SELECT unnest(['removed', 'added']) FROM moved)
SELECT action, count(*) AS n, (SELECT count(*) FROM edges) AS edges_after, (SELECT count(*) FROM edges WHERE src LIKE 'supplier:%' OR src IN (SELECT src FROM moved)) AS touched FROM c GROUP BY action""")
def wiki_sync(spark, d):
    """The report of a synchronisation, and the graph after it."""
    _, edges, changes = wiki.sync(*_edited(spark, d))
    after = edges.agg(F.count(F.lit(1)).alias("edges_after"), F.count_if("wiki_updated").alias("touched"))
    return changes.groupBy("action").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(after), F.lit(True))


@query(f"WITH {GRAPH_SQL}, k AS (SELECT 'info' AS severity, count(*) AS c FROM edges WHERE confidence < 0.5 UNION ALL SELECT 'warning', count(*) FROM (SELECT subject FROM triples GROUP BY subject, object HAVING count(DISTINCT relation) > 1)) SELECT severity, count(*) AS n, sum(c)::BIGINT AS findings FROM k WHERE c > 0 GROUP BY severity")
def lint_severities(spark, d):
    """A13."""
    none = spark.createDataFrame([], "filename string, content string")
    return wiki.severities(wiki.lint(*_kept_graph(spark, d), _all(spark, d), none))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS short FROM documents")
def shortened(spark, d):
    """F15."""
    return table(spark, d, "documents").select("doc_id", T.shorten("text", 80, "...").alias("short"))


@query("SELECT event_id, printf('%.2f', value) AS shown FROM events")
def two_places(spark, d):
    """F24's numbers, by their exact binary values."""
    return table(spark, d, "events").select("event_id", T.two_places("value").alias("shown"))


@query(f"WITH {PLACE_GRAPH_SQL} SELECT a.src || ' --[' || a.relation || ']--> ' || a.dst || ' → ' || b.src || ' --[' || b.relation || ']--> ' || b.dst AS chain FROM edges a JOIN edges b ON a.dst = b.src")
def path_chains(spark, d):
    """the chains of all two-step paths."""
    e = _places(spark, d)[1].select("src", "dst", "relation")
    step = lambda p: F.struct(F.col(f"{p}.src").alias("from"), F.col(f"{p}.dst").alias("to"), F.col(f"{p}.relation").alias("relation"))
    return e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).select(T.path_chain(F.array(step("a"), step("b"))).alias("chain"))


@query(f"WITH {_SNAP_SQL} SELECT path AS source, 'fresh' AS text FROM diff WHERE status IN ('new', 'modified') UNION ALL SELECT path, 'old' FROM old WHERE path IN (SELECT path FROM diff WHERE status = 'unchanged')")
def chunk_union(spark, d):
    """Chunks of unchanged files beside the new ones."""
    now, old = _snapshots(spark, d)
    diff = incremental.scan(now, old)
    chunk = lambda df, t: df.select(F.col("path").alias("id"), F.col("path").alias("source"), "path", F.lit(t).alias("text"))
    return incremental.union_chunks(chunk(incremental.to_process(diff), "fresh"), chunk(old, "old"), diff).select("source", "text")


@query(f"""WITH {GRAPH_SQL} SELECT relation, problem, count(*) AS n FROM (SELECT relation, CASE WHEN relation NOT IN ('PART_OF', 'LOCATED_IN', 'SUPPLIES') THEN 'unknown relation' WHEN relation = 'LOCATED_IN' AND subject_type <> 'SUPPLIER' THEN 'subject type' WHEN relation = 'PART_OF' THEN 'object type' END AS problem FROM triples) GROUP BY ALL""")
def ontology_problems(spark, d):
    """D17's check of triples against allowed types."""
    known = spark.createDataFrame([("PART_OF", "", ["NATION"], ["PLANET"]), ("LOCATED_IN", "", ["SUPPLIER"], ["NATION"]), ("SUPPLIES", "", None, None)], "type string, label string, valid_subject array<string>, valid_object array<string>")
    return extract.validate(_all(spark, d), known).groupBy("relation", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRAPH_SQL} SELECT count(*) AS total FROM nodes WHERE contains(lower(name), 'nation')")
def api_entity_total(spark, d):
    """A route's total."""
    return Api(*_graph(spark, d)).entities("Nation")[1]


@query(f"WITH {GRAPH_SQL}, {NEAR_SQL} SELECT CASE WHEN contains(text, 'than') THEN 1 ELSE 0 END AS holds, count(*) AS n, sum(len({_TOKENS_SQL}))::BIGINT AS tokens FROM documents GROUP BY holds")
def token_totals(spark, d):
    """F1 over all texts."""
    docs = table(spark, d, "documents")
    return docs.groupBy(F.when(F.col("text").contains("than"), 1).otherwise(0).alias("holds")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(T.tokenize("text"))).cast("long").alias("tokens"))


@query(f"SELECT 'n' || n_nationkey AS id, {_file_sql('n_name')} || '.md' AS filename FROM nation")
def entity_files(spark, d):
    """F4 of nations."""
    return table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(T.safe_filename("n_name"), F.lit(".md")).alias("filename"))
