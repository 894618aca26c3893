"""Registered graph queries beside their SQL on small tables with odd rows."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from oracle_check import rows_of
from quillgraph.functions import text as T
from quillgraph.operators import centrality, graph, paths, vectors, wiki
from quillgraph.plans import queries
from quillgraph.sources import store

PLACES = {
    "region": "SELECT * FROM (VALUES (0, 'EUROPE'), (1, 'ASIA')) t(r_regionkey, r_name)",
    "nation": "SELECT * FROM (VALUES (0, 'NATION_0', 0), (1, 'NATION_1', 1), (7, 'NATION_7', 1)) t(n_nationkey, n_name, n_regionkey)",
    "customer": "SELECT k AS c_custkey, k % 2 AS c_nationkey FROM range(3) t(k)",
    "supplier": "SELECT k AS s_suppkey, 1 AS s_nationkey FROM (VALUES (3), (404)) t(k)",
}


def tables(folder, **made):
    """Writes tables, gives their folder and a connection that sees them."""
    con = duckdb.connect()
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return str(folder), con


def both(spark, folder, con, name):
    df = queries.QUERIES[name](spark, folder)
    r = con.execute(queries.ORACLES[name])
    return rows_of(df.columns, df.collect()), rows_of([c[0] for c in r.description], r.fetchall())


@pytest.mark.parametrize("name", ["wiki_diff", "wiki_apply", "wiki_sync", "changed_entities"])
def test_edited_pages_of_names_that_look_like_junk(spark, tmp_path, name):
    got, want = both(spark, *tables(tmp_path, **PLACES), name)
    assert got == want and want


TEXTS = {
    # a key of two rows, no key, no text, no words, Han, letters that lower case makes, copies
    "documents": """SELECT doc_id::BIGINT AS doc_id, text FROM (VALUES (1, 'than the heedth of ing'), (1, 'than the rest'), (2, 'the heedth the'), (3, NULL), (4, ''), (5, '! 1 a'),
        (6, '中文 than the 文'), (7, 'İstanbul Kelvin THE Than'), (8, 'the heedth the'), (9, 'x1 _y than ing of'), (10, 'ing')) t(doc_id, text)""",
    "benchmark": "SELECT k AS item_id, CASE k WHEN 3 THEN NULL WHEN 4 THEN 'nothing known' ELSE 'the heedth of ' || k || ' than 文 İng' END AS text FROM range(6) t(k)",
}


@pytest.mark.parametrize("name", ["doc_freq", "tfidf_weights", "tfidf_topk", "tfidf_topk_batch", "index_files"])
def test_index_of_odd_texts(spark, tmp_path, name):
    got, want = both(spark, *tables(tmp_path, **TEXTS), name)
    assert got == want and want


def test_terms_of_single_texts_are_not_shuffled(spark, monkeypatch):
    """Each part sends and gets each of its words once: the plan deals out no (key, term)."""
    monkeypatch.setattr(vectors, "PART_BYTES", 100)
    rows = spark.range(100).selectExpr("id", "concat('than word', id) as text")
    plan = vectors.build_index(rows)[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(key" not in plan and "hashpartitioning(term" in plan


def test_best_scores_stay_few():
    best = vectors.Best(2, 3, 0.0, pa.int64())
    rnd = np.random.default_rng(1)
    scores = rnd.random((5000, 2))
    for i in range(0, 5000, 500):
        best.add(scores[i : i + 500], pa.array(np.arange(i, i + 500)))
    q, s, keys = best.cut()
    assert [keys.to_numpy()[q == j].tolist() for j in (0, 1)] == [np.argsort(-scores[:, j])[:3].tolist() for j in (0, 1)]


VECTORS = {"embeddings": """SELECT CASE WHEN k = 41 THEN 40 ELSE k END AS vec_id, CASE WHEN k = 7 THEN NULL WHEN k % 3 = 0 THEN [0.1, 0.7, 0.2]::FLOAT[] WHEN k = 20 THEN [0, 0, 0]::FLOAT[]
    ELSE [sin(k), cos(3 * k), sin(7 * k)]::FLOAT[] END AS embedding FROM range(60) t(k)"""}


def test_dense_top_k_of_copies_makes_no_pairs(spark, tmp_path):
    """A third of the vectors are one, one is null and one zero, a key has two rows; no row meets all queries in Spark."""
    folder, con = tables(tmp_path, **VECTORS)
    con.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('" + folder + "/embeddings.parquet') WHERE embedding IS NOT NULL")
    df = queries.QUERIES["dense_topk"](spark, folder)
    got = sorted((r.query_id, r.rank, r.key, r.score) for r in df.collect())
    e = [(i, v) for i, v in con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (max(sum(x * x for x in a) ** 0.5, 1e-10) * max(sum(x * x for x in b) ** 0.5, 1e-10))
    want = []
    for of in {i for i, _ in e if i % 20 == 0}:
        pairs = sorted(((round(cos(a, v), 12), i) for j, a in e if j == of for i, v in e), reverse=True)[:5]
        want += [(of, n + 1, i, round(s, 6)) for n, (s, i) in enumerate(pairs)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, sorted(want), strict=True))
    assert "BroadcastNestedLoopJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("blocks", [1, 3])
def test_betweenness_by_joins(spark, blocks):
    """Beyond the edges that each worker may hold: cycles, loops, several shortest paths, many distances."""
    rnd = random.Random(blocks)
    pairs = {(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(26)} | {(f"n{i}", f"n{i + 1}") for i in range(13, 18)} | {("n3", "n3"), ("x", "n0")}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in sorted({y for p in pairs for y in p} | {"alone"})], "name string")
    whole = {r.name: round(r.betweenness, 12) for r in centrality.betweenness(nodes, edges).collect()}
    got = {r.name: round(r.betweenness, 12) for r in centrality.betweenness(nodes, edges, most_edges=5, most_begun=-(-len(pairs) // blocks)).collect()}
    assert got == whole and max(whole.values()) > 0.1 and whole["alone"] == 0


def test_scanned_files_of_odd_texts(spark, tmp_path):
    """Blank and missing texts count, and so do languages of any name, blank and missing ones."""
    made = "SELECT * FROM (VALUES ('en', 'a'), ('en', ''), ('en', NULL), ('a/b: %c=', chr(10)), ('a/b: %c=', 'ä' || chr(10) || chr(13) || chr(10)), ('', 'x'), (NULL, 'yy'), ('de', NULL)) t(lang, text)"
    got, want = both(spark, *tables(tmp_path, documents=made), "scanned_files")
    assert got == want and len(want) == 5


@pytest.mark.parametrize("few", [True, False])
def test_transitive_shuffles_lists_of_numbers(spark, monkeypatch, few):
    """Loops, cycles, doubled edges, a hub longer than a list; names of pairs are not shuffled."""
    monkeypatch.setattr(paths, "MOST_IDS", 4)
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(90)] + [("hub", f"n{i}") for i in range(20)] + [("n1", "hub"), ("n1", "n1"), ("n2", "n3"), ("n2", "n3")]
    df = paths.transitive(spark.createDataFrame(pairs, "src string, dst string"), most_names=100 if few else 3)
    e = set(pairs)
    want = {(a, d) for a, b in e for c, d in e if b == c and a != d and a != b and c != d and (a, d) not in e}
    got = [(r.subject, r.object) for r in df.collect()]
    assert sorted(got) == sorted(want)
    assert "hashpartitioning(subject" not in df._jdf.queryExecution().executedPlan().toString()


def test_ends_and_marks(spark):
    """White space is only sought where an end may have it; sources end before the last mark."""
    rows = [" a ", "a", "\u00a0é\u2003", "é", "", None, "\n", "a_chunk_b_chunk_1", "a_row_b_row_", "_chunk_chunk_", "x_row_1_chunk_", "none", " _row_", "\U0001f600 "]
    df = spark.createDataFrame([(x,) for x in rows], "x string").select(T.strip("x").alias("s"), T.source_of_chunk("x").alias("c"))
    before = lambda x: None if x is None else x.rpartition("_chunk_")[0] if "_chunk_" in x else x.rpartition("_row_")[0] if "_row_" in x else None
    assert [tuple(r) for r in df.collect()] == [(x and x.strip(), before(x)) for x in rows]


def test_folds_and_lint_hash_what_they_can(spark):
    """Types, ends and contradictory pairs are first made different in each task, as numbers or keys."""
    t = spark.createDataFrame([("a", "T", "R", "b", "U", 0.9, "", "c", 1), ("a", "T", "S", "b", "U", 0.8, "", "c", 2), ("b", "T", None, "a", "T", 0.8, "", "c", 3), ("b", "T", "R", "a", "T", 0.8, "", "c", 4)], "subject string, subject_type string, relation string, object string, object_type string, confidence double, source_text string, source_chunk string, triple_ord long")
    assert [tuple(r) for r in wiki.contradictions(t).collect()] == [("a", "b", ["R", "S"])]
    nodes, edges = graph.build(t)
    assert {r.name: (r.types, r.node_ord) for r in nodes.collect()} == {"a": (["T"], 2), "b": (["T", "U"], 3)}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan(wiki.contradictory_pairs(t)) and "SortAggregate" not in plan(wiki.orphans(nodes.select("name"), edges))
    assert "partial_min(o" in plan(nodes) and "keys=[name" in plan(nodes)


PRETTY = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><!-- <node id="not"> </node> -->
<graph edgedefault="directed"><node id="lone"/><node
   id='a &gt; "b"'>
  <data key="types">T, U</data>
</node><node id="ü"/>
<edge source="lone" target="ü" /><edge source="a &gt; &quot;b&quot;" target="lone">
  <data key="relation">R &amp; S</data><data key="confidence">0.5</data></edge><edge source="ü" target="ü"/></graph></graphml>
"""


@pytest.mark.parametrize("comment", [True, False])
def test_graphml_of_other_tools(spark, tmp_path, comment):
    (tmp_path / "g.graphml").write_text(PRETTY if comment else PRETTY.replace('<!-- <node id="not"> </node> -->', ""))
    nodes, edges = store.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted((r.name, r.types) for r in nodes.collect() if r.name != "not") == [('a > "b"', ["T", "U"]), ("lone", []), ("ü", [])]
    assert sorted((r.src, r.dst, r.relation, r.confidence) for r in edges.collect()) == [('a > "b"', "lone", "R & S", 0.5), ("lone", "ü", None, None), ("ü", "ü", None, None)]


@pytest.mark.parametrize("form", ["graphml", "gexf"])
def test_many_tasks_read_one_export(spark, tmp_path, form):
    names = [(f"n{i} <&> \u4e2d", ["T", "U"], i) for i in range(3000)]
    nodes = spark.createDataFrame(names, "name string, types array<string>, node_ord long")
    edges = spark.createDataFrame([(names[i][0], names[i // 2][0], "R", 0.5, "", f"c_{i}") for i in range(3000)], "src string, dst string, relation string, confidence double, source_text string, source_chunk string")
    store.write_lines(getattr(store, form)(nodes, edges), str(tmp_path / form))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        n, e = getattr(store, f"read_{form}")(spark, str(tmp_path / form))
        assert n.rdd.getNumPartitions() > 3 and e.rdd.getNumPartitions() > 3
        assert sorted((r.name, r.types) for r in n.collect()) == sorted((a, b) for a, b, _ in names)
        assert sorted((r.src, r.dst, r.relation, r.confidence) for r in e.collect()) == sorted((r.src, r.dst, r.relation, r.confidence) for r in edges.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


@pytest.mark.parametrize("most", [2, 1000])
def test_bfs_does_not_shuffle_edges_to_a_small_frontier(spark, monkeypatch, most):
    pairs = [(f"n{i}", f"n{j}") for i in range(40) for j in (i + 1, i + 1, i * 3 % 40, i)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    plans = []
    monkeypatch.setattr(paths, "cut", lambda df, f=paths.cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    near, far, level = {}, {"n1": 0}, ["n1"]
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    for d in (1, 2, 3):
        level = sorted({b for a in level for b in near.get(a, ())} - set(far))
        far |= dict.fromkeys(level, d)
    got = {r.entity: r.distance for r in paths.bfs(edges, "n1", 3, most).collect()}
    assert got == {k: v for k, v in far.items() if v} and len(plans) == 3
    if most > 2:
        assert all("BroadcastHashJoin [src" in p and "SortMergeJoin [src" not in p for p in plans[1:])
