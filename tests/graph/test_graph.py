import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import centrality, community, extract, graph, incremental, paths, resolve, vectors, wiki
from quillgraph.plans import pipeline
from quillgraph.plans.api import Api, BadRequest, NotFound
from quillgraph.plans.search import hybrid
from quillgraph.schemas import EDGES, NODES, TRIPLES
from quillgraph.sources import store
from quillgraph.streaming.incremental import follow


def triples(spark, rows):
    """rows: subject, relation, object, confidence."""
    full = [(s, "T", r, o, "U", c, "text of " + (s or ""), f"d_chunk_{i}", i) for i, (s, r, o, c) in enumerate(rows)]
    return spark.createDataFrame(full, TRIPLES)


def edges_of(spark, pairs, confidence=0.9):
    return graph.fold_edges(triples(spark, [(a, "R", b, confidence) for a, b in pairs]))


def nodes_of(spark, names):
    return spark.createDataFrame([(n, ["T"], i) for i, n in enumerate(names)], NODES)


def test_fold(spark):
    t = triples(spark, [("a", "R1", "b", 0.8), (" a ", "R2", "b", 0.9), ("a", "R3", "b", 0.9), ("", "R", "x", 1.0), ("c", None, "a", None)])
    nodes, edges = graph.build(t)
    got = {(r.src, r.dst): (r.relation, r.confidence) for r in edges.collect()}
    assert got == {("a", "b"): ("R2", 0.9), ("c", "a"): ("RELATED_TO", None)}
    assert {r.name: r.types for r in nodes.collect()} == {"a": ["T", "U"], "b": ["U"], "c": ["T"]}
    assert graph.confident(t).count() == 4


def test_degrees_and_lists(spark):
    nodes, edges = nodes_of(spark, "abcd"), edges_of(spark, ["ab", "ac", "bb"])
    d = {r.name: (r.in_degree, r.out_degree, r.degree) for r in graph.degrees(nodes, edges).collect()}
    assert d == {"a": (0, 2, 2), "b": (2, 1, 3), "c": (1, 0, 1), "d": (0, 0, 0)}
    rows, total = graph.entity_list(nodes, edges, page=1, per=2)
    assert [r.name for r in rows.collect()] == ["b", "a"] and total.first().total == 4
    s = graph.stats(nodes, edges).first()
    assert (s.nodes, s.edges, s.density, s.avg_degree, s.max_degree, s.min_degree) == (4, 3, 0.25, 1.5, 3, 0)
    assert graph.stats(nodes.limit(0), edges.limit(0)).first().nodes == 0
    assert [r.name for r in wiki.orphans(nodes, edges).collect()] == ["d"]


def test_update_delete(spark):
    nodes, edges = nodes_of(spark, "abc"), edges_of(spark, ["ab", "bc"])
    out = spark.createDataFrame([("S", " z ", 0.5), ("S", " ", 0.5)], "relation string, target string, confidence double")
    n, e = graph.update_entity(nodes, edges, "a", "K", out)
    assert {r.name: r.types for r in n.collect()} == {"a": ["K"], "b": ["T"], "c": ["T"], "z": []}
    assert {(r.src, r.dst, r.relation, r.wiki_updated) for r in e.collect()} == {("a", "z", "S", True), ("b", "c", "R", False)}
    n, e = graph.delete_entity(nodes, edges, "b")
    assert n.count() == 2 and e.count() == 0


def test_paths(spark):
    e = edges_of(spark, ["ab", "bd", "ac", "cd", "da"])
    assert {"".join(r.path) for r in paths.find_paths(e, "a", "d").collect()} == {"abd", "acd"}
    assert paths.find_paths(e, "a", "nowhere").count() == 0
    chain = edges_of(spark, ["ab", "bc", "cd"])
    assert {(r.entity, r.distance) for r in paths.bfs(chain, "a", 2).collect()} == {("b", 1), ("c", 2)}
    t = paths.transitive(edges_of(spark, ["ab", "bc", "ac", "cd", "bb"]))
    assert {(r.subject, r.object) for r in t.collect()} == {("a", "d"), ("b", "d")}


def random_graph(n, m, seed):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    return names, sorted({tuple(rnd.sample(names, 2)) for _ in range(m)})


def test_pagerank(spark):
    names, pairs = random_graph(12, 20, 1)
    out = {v: [b for a, b in pairs if a == v] for v in names}
    r = dict.fromkeys(names, 1 / 12)
    for _ in range(200):
        loose = sum(r[v] for v in names if not out[v])
        r = {v: 0.15 / 12 + 0.85 * (loose / 12 + sum(r[a] / len(out[a]) for a, b in pairs if b == v)) for v in names}
    got = {x.name: x.pagerank for x in centrality.pagerank(nodes_of(spark, names), edges_of(spark, pairs)).collect()}
    assert max(abs(got[v] - r[v]) for v in names) < 1e-5


def test_betweenness(spark):
    names, pairs = random_graph(14, 40, 2)
    out = {v: [b for a, b in pairs if a == v] for v in names}

    def shortest(s, t):
        level, found = [[s]], []
        while level and not found:
            level = [p + [w] for p in level for w in out[p[-1]] if w not in p]
            found = [p for p in level if p[-1] == t]
        return found

    want = dict.fromkeys(names, 0.0)
    for s, t in itertools.permutations(names, 2):
        ps = shortest(s, t)
        for p in ps:
            for v in p[1:-1]:
                want[v] += 1 / len(ps)
    got = {r.name: r.betweenness for r in centrality.betweenness(nodes_of(spark, names), edges_of(spark, pairs)).collect()}
    assert all(abs(got[v] - want[v] / (13 * 12)) < 1e-9 for v in names)
    table = centrality.centrality(nodes_of(spark, names), edges_of(spark, pairs))
    assert table.columns == ["entity", "degree", "pagerank", "betweenness"] and table.count() == 14


def test_communities(spark):
    pairs = ["ab", "bc", "ca", "de", "ef", "fd", "cd"]
    nodes, edges = nodes_of(spark, "abcdefg"), edges_of(spark, pairs)
    rows = community.communities(nodes, edges).collect()
    assert [(r.community_id, "".join(r.members)) for r in rows] == [(0, "abc"), (1, "def"), (2, "g")]
    assert abs(community.modularity(edges, community.communities(nodes, edges)).first().modularity - (6 / 7 - 0.5)) < 1e-9
    labels = {r.name: r.component for r in community.components(nodes, edges).collect()}
    assert set(labels.values()) == {"a", "g"}
    assert not community.weakly_connected(nodes, edges).first().is_connected
    assert not community.weakly_connected(nodes.limit(0), edges.limit(0)).first().is_connected


def sequential(names, threshold):
    def sim(a, b):
        norm = lambda x: "".join(c for c in x.lower() if c.isalnum() or c == "_")
        a, b = norm(a), norm(b)
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return 1.0 if not a and not b else 1 - d[-1] / max(len(a), len(b))

    leaders, out = [], {}
    for n in names:
        out[n] = next((x for x in leaders if sim(n, x) >= threshold - 1e-9), n)
        if out[n] == n:
            leaders.append(n)
    return out


@pytest.mark.parametrize("threshold", [0.85, 0.7])
def test_leaders(spark, threshold):
    rnd = random.Random(5)
    names = list(dict.fromkeys("".join(rnd.choice("ab-") for _ in range(rnd.randint(1, 9))) for _ in range(90)))
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord long")
    got = {r.name: r.canonical for r in resolve.resolve_names(df, threshold).collect()}
    assert got == sequential(names, threshold)


def test_resolve(spark):
    t = triples(spark, [("Rockchip", "R", "Firefly", 0.9), ("rock-chip", "R", "Fireflys", 0.9), ("Other", "R", "", 0.9)])
    got = [(r.subject, r.object) for r in resolve.resolve(t).orderBy("triple_ord").collect()]
    assert got == [("Rockchip", "Firefly"), ("Rockchip", "Firefly"), ("Other", "")]
    names = resolve.resolve_names(resolve.first_seen(t), ask=lambda name, known: "Rockchip" if name == "Other" else None)
    assert {r.name: r.canonical for r in names.collect()}["Other"] == "Rockchip"
    assert resolve.resolver_stats(names).first().merged == 3
    assert abs(resolve.indel_ratio(*map(__import__("pandas").Series, (["abcdefg"], ["abcdefgh"])))[0] - 14 / 15) < 1e-9


def test_vectors(spark):
    chunks = spark.createDataFrame([("c0", "apple pie apple", 0), ("c1", "pie crust", 1), ("c2", "", 2), ("c3", "apple tree", 3)], "id string, text string, ord long")
    index = vectors.build_index(chunks)
    idf = lambda df: math.log(5 / (df + 1)) + 1
    w = {(r.key, r.term): r.weight for r in index[0].collect()}
    assert abs(w["c0", "pie"] - 0.5 * idf(2)) < 1e-9 and abs(w["c0", "apple"] - idf(2)) < 1e-9
    q = spark.createDataFrame([(0, "apple unknown unknown")], "query_id int, text string")
    assert abs(vectors.query_vectors(q, index[1]).first().weight - 0.5 * idf(2)) < 1e-9
    hits = vectors.top_k(index, q, chunks.select(F.col("id").alias("key"), F.col("ord").alias("idx")), 2).orderBy("rank").collect()
    assert [h.key for h in hits] == ["c0", "c3"]
    assert not vectors.needs_rebuild(chunks, chunks).first().stale and vectors.needs_rebuild(chunks, chunks.where("ord > 0")).first().stale
    more = vectors.add_chunks(chunks, spark.createDataFrame([("c4", "new", 4)], "id string, text string, ord long"))
    assert more[0].count() == 5
    nodes, edges = nodes_of(spark, ["apple", "b"]), edges_of(spark, [("apple", "b")])
    found = hybrid("apple > b", index, chunks, nodes, edges).collect()
    assert {r.section for r in found} == {"vector", "path"} and [r.detail for r in found if r.section == "path"] == ["apple --[R]--> b"]


def test_incremental(spark):
    snap = spark.createDataFrame([("a", "1", []), ("b", "2", []), ("c", "3", [])], "path string, hash string, chunk_ids array<string>")
    now = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, hash string")
    diff = incremental.scan(now, snap)
    assert {r.path: r.status for r in diff.collect()} == {"a": "deleted", "b": "unchanged", "c": "modified", "d": "new"}
    assert {r.path for r in incremental.to_process(diff).collect()} == {"c", "d"}


def graph_pages(spark):
    t = triples(spark, [("alpha", "USES", "beta", 0.91), ("alpha", "HAS", "gamma", 0.4), ("beta", "USES", "gamma", 0.77)])
    nodes, edges = graph.build(t)
    return nodes, edges, t, wiki.compile_pages(nodes, edges)


def test_pages_round_trip(spark):
    nodes, edges, t, pages = graph_pages(spark)
    heads, relations = wiki.parse_pages(pages)
    assert {(r.title, r.entity_type, tuple(r.sources)) for r in heads.collect()} == {("alpha", "T", ("d",)), ("beta", "T, U", ("d",)), ("gamma", "U", ("d",))}
    assert relations.count() == 6
    assert wiki.diff_pages(nodes, edges, pages).count() == 0
    text = {r.name: r.content for r in pages.collect()}["alpha"]
    assert text.startswith("---\ntitle: alpha\nsource: d\n---\n\n# alpha\n\n**类型**: T\n\n> alpha is a T entity with 2 outgoing and 0 incoming relations.\n")
    assert "- **USES** → [[beta]] (置信度: 0.91)\n  - *原文: \"text of alpha...\"*" in text and "- 无入向关系" in text
    report = {r.type: r["count"] for r in wiki.lint(nodes, edges, t, pages).collect()}
    assert report == {"low_confidence": 1}


def test_edits(spark):
    nodes, edges, _, pages = graph_pages(spark)
    edit = lambda a, b: pages.where("name = 'alpha'").withColumn("content", F.replace("content", F.lit(a), F.lit(b)))

    def after(p):
        n, e, c = wiki.sync(nodes, edges, p)
        assert wiki.diff_pages(n, e, p).where("direction = 'outgoing'").count() == 0
        return {r.name: r.types for r in n.collect()}, {(r.src, r.dst): (r.relation, r.confidence, r.wiki_updated) for r in e.collect()}, c.collect()

    _, e, c = after(edit("0.91", "0.50"))
    assert [x.action for x in c] == ["updated"] and e["alpha", "beta"] == ("USES", 0.5, True)
    # a relation of another name on the same pair: added first, so the removal finds nothing
    _, e, c = after(edit("**USES**", "**NEEDS**"))
    assert sorted(x.action for x in c) == ["added", "removed"] and e["alpha", "beta"] == ("NEEDS", 0.91, True)
    n, e, c = after(edit("[[beta]]", "[[delta]]"))
    assert n["delta"] == [] and ("alpha", "beta") not in e and e["alpha", "delta"] == ("USES", 0.91, True)
    n, e, c = after(edit("**类型**: T", "**类型**: X, Y"))
    assert n["alpha"] == ["X", "Y"] and [x.action for x in c] == ["type"]
    assert wiki.sync(nodes, edges, edit("0.91", "0.50"), dry_run=True)[1] is edges


def test_store(spark, tmp_path):
    nodes, edges, t, pages = graph_pages(spark)
    s = store.GraphStore(spark, str(tmp_path / "g"))
    assert s.load()[0].count() == 0
    s.save(nodes, edges)
    s.save(nodes, edges.where("confidence > 0.5"))
    assert s.load()[0].count() == 3 and s.load()[1].count() == 2
    for name, write in (("g.graphml", lambda p: store.write_lines(store.graphml(nodes, edges), p)), ("g.json", lambda p: store.write_json_graph(nodes, edges, p))):
        write(str(tmp_path / name))
        n, e = store.load_any(spark, [str(tmp_path / "none.graphml"), str(tmp_path / name)])
        assert {r.name: r.types for r in n.collect()} == {r.name: r.types for r in nodes.collect()}
        assert {(r.src, r.dst, r.relation, r.confidence) for r in e.collect()} == {(r.src, r.dst, r.relation, r.confidence) for r in edges.collect()}
    assert "".join(r.line for r in store.gexf(nodes, edges).orderBy("part", "key").collect()).count("<edge ") == 3
    assert store.cypher(nodes, edges).count() == 6
    store.write_pages(pages, str(tmp_path / "wiki"))
    back = store.read_pages(spark, str(tmp_path / "wiki"))
    assert wiki.diff_pages(nodes, edges, back).count() == 0
    assert wiki.page_of(back, "alpha").count() == 1
    assert "[[alpha|alpha]]" in wiki.index_page(pages).first().content
    stream = tmp_path / "in"
    t.where("triple_ord < 2").write.parquet(str(stream))
    other = store.GraphStore(spark, str(tmp_path / "h"))
    for k in range(2):
        q = follow(spark.readStream.schema(TRIPLES).parquet(str(stream)), other, str(tmp_path / "check"))
        q.awaitTermination()
        t.where("triple_ord = 2").write.mode("append").parquet(str(stream))
    assert other.load()[1].count() == 3


def test_api(spark):
    nodes, edges, _, pages = graph_pages(spark)
    chunks = spark.createDataFrame([("c0", "alpha beta", 0)], "id string, text string, ord long")
    api = Api(nodes, edges, pages, chunks, vectors.build_index(chunks))
    assert api.stats().first().nodes == 3 and api.relations().count() == 2
    detail, page = api.entity("alpha")
    assert detail.first().outgoing == ["USES|beta", "HAS|gamma"] and page.count() == 1
    with pytest.raises(NotFound):
        api.entity("nobody")
    with pytest.raises(BadRequest):
        api.search(" ")
    assert {r.section for r in api.search("alpha").collect()} == {"vector", "graph"}
    assert api.delete("alpha").stats().first().nodes == 2
    assert api.update("alpha", "K").entity("alpha")[0].first().type == "K"
    top, groups = api.insights()
    assert top.count() == 3 and groups.count() >= 1
    assert api.sync_page("alpha")[1].count() == 0 and api.graph_data()[0].count() == 3


def test_extract(spark):
    chunks = spark.createDataFrame([("c0", "Alice met Bob. bob left", 0), ("c1", None, 1)], "id string, text string, ord long")
    got = extract.extract(chunks).collect()
    assert [(r.subject, r.object, r.source_chunk) for r in got] == [("Alice", "Bob", "c0")]

    def failing(text, chunk, contexts, image):
        raise OSError

    assert extract.extract(chunks, failing).count() == 0
    ontology = spark.createDataFrame([("NEAR", "", ["Person"], None)], "type string, label string, valid_subject array<string>, valid_object array<string>")
    assert extract.validate(extract.extract(chunks), ontology).first().problem == "subject type"


def test_pipeline(spark, tmp_path):
    docs = tmp_path / "raw"
    docs.mkdir()
    (docs / "a.md").write_text("Alice met Bob.\n\nBob knows Carol.")
    (docs / "b.md").write_text("Dora met Alice.")
    first = pipeline.run(spark, str(docs), contexts=True, analytics=True)
    assert first.nodes.count() == 4 and first.edges.count() == 3 and first.pages.count() == 4
    assert first.extra["communities"].count() >= 1 and first.extra["centrality"].count() == 4
    (docs / "b.md").write_text("Dora met Erik.")
    (docs / "c.md").write_text("Frank met Alice.")
    again = pipeline.run(spark, str(docs), snapshot=first.snapshot, triples=first.triples, chunks=first.chunks)
    fresh = pipeline.run(spark, str(docs))
    pairs = lambda r: {(x.src, x.dst) for x in r.edges.collect()}
    assert pairs(again) == pairs(fresh) and again.snapshot.count() == 3
    assert spark.createDataFrame([], EDGES).columns == again.edges.columns
