"""Endpoints through a stub transport, and the tasks that use them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import extract, graph, iterate, providers, resolve
from quillgraph.operators.providers import ExtractionBackend, Provider, SearchIndex, build, load_or_build, resolved_contradictions, summaries
from quillgraph.schemas import load_ontology
from quillgraph.sources import store

CHAT = {"llm": {"provider": "lmstudio", "base_url": "http://x/v1/", "model": "m", "vision_model": "see", "api_key": "secret", "temperature": 0.2, "timeout": 9}, "embedding": {"model": "e"}}


class Sent(list):
    """Keeps calls and gives one answer."""

    def __init__(self, answer, failures=0):
        self.answer, self.failures = answer, failures

    def __call__(self, url, body, headers, timeout):
        self.append((url, body, headers, timeout))
        if len(self) <= self.failures:
            raise OSError("not now")
        return self.answer


def with_send(config, send):
    return Provider(**{**Provider.of(config).__dict__, "send": send})


def test_chat():
    send = Sent({"choices": [{"message": {"content": "yes"}}]})
    p = with_send(CHAT, send)
    assert p.complete("hello") == "yes" and p.see("what?", b"abc", "image/png") == "yes"
    (url, body, headers, timeout), (_, seen, _, _) = send
    assert url == "http://x/v1/chat/completions" and headers["Authorization"] == "Bearer secret" and timeout == 9
    assert body["model"] == "m" and body["temperature"] == 0.2 and body["messages"][0]["content"] == "hello"
    assert seen["model"] == "see" and seen["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,YWJj"
    assert "secret" not in repr(p)


def test_generate():
    send = Sent({"response": "no", "embeddings": [[1.0], [2.0]]})
    p = with_send({"llm": {"base_url": "http://y", "model": "m"}}, send)
    assert p.complete("hello") == "no" and p.see("what?", b"abc", "image/png") == "no" and p.embed(["a", "b"]) == [[1.0], [2.0]]
    assert [c[0] for c in send] == ["http://y/api/generate", "http://y/api/generate", "http://y/api/embed"]
    assert send[1][1]["images"] == ["YWJj"] and "Authorization" not in send[0][2] and not p.embeds


def test_embeddings_in_order():
    p = with_send(CHAT, Sent({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}))
    assert p.embeds and p.embed(["a", "b"]) == [[1.0], [2.0]]
    assert Provider.of({"llm": {"base_url": "http://api.openai.example/v1", "model": "m"}}).embeds


def test_tries(monkeypatch):
    slept = []
    monkeypatch.setattr(providers.time, "sleep", slept.append)
    p = with_send(CHAT, Sent({"choices": [{"message": {"content": "late"}}]}, failures=2))
    assert p.complete("x", tries=3) == "late" and slept == [1, 2]
    with pytest.raises(OSError):
        with_send(CHAT, Sent({}, failures=9)).complete("x", tries=3)


def told(url, body, headers, timeout):
    """A stub that workers can take along."""
    content = body["messages"][0]["content"]
    if isinstance(content, list):
        answer = [{"subject": "image", "relation": "SHOWS", "object": "thing", "confidence": 0.9}]
    elif "broken" in content:
        raise OSError("no")
    else:
        answer = [{"subject": "a", "relation": "R", "object": "b", "confidence": 0.8}]
    return {"choices": [{"message": {"content": json.dumps(answer)}}]}


def test_extraction(spark, tmp_path, monkeypatch):
    (tmp_path / "p.png").write_bytes(b"abc")
    chunks = spark.createDataFrame([("c1", "text", None, 0), ("c2", "picture", str(tmp_path / "p.png"), 1)], "id string, text string, image_path string, ord long")
    got = {(r.subject, r.source_chunk) for r in extract.extract(chunks, ExtractionBackend(with_send(CHAT, told), ("A",), ("R",))).collect()}
    assert got == {("a", "c1"), ("image", "c2")}


def answers(prompt):
    if "bad" in prompt:
        raise OSError("no")
    return json.dumps({"selected_relation": "R2", "reason": "so"}) if "JSON" in prompt else f" {prompt.count('- ')} lines "


def test_summaries_and_lint(spark):
    nodes, edges = graph.build(spark.createDataFrame([("good", "T", f"R{k}", f"o{k}", "T", 0.9, "", "c", k) for k in range(7)] + [("bad", "T", "R", "o1", "T", 0.9, "", "c", 9)], "subject string, subject_type string, relation string, object string, object_type string, confidence double, source_text string, source_chunk string, triple_ord long"))
    got = {r.name: r.summary for r in summaries(nodes, edges, answers).collect()}
    assert got["good"] == "5 lines" and got["bad"] == "bad is a T entity connected to 1 other entities." and len(got) == 9
    t = spark.createDataFrame([(s, r, "o", 0.9, k) for k, (s, r) in enumerate([("x", "R1"), ("x", "R2"), ("bad", "R1"), ("bad", "R3")])], "subject string, relation string, object string, confidence double, triple_ord long")
    assert {(r.subject, r.resolution) for r in resolved_contradictions(t, answers).collect()} == {("x", "R2"), ("bad", "UNRESOLVED")}


def vector(url, body, headers, timeout):
    if any("broken" in t for t in body["input"]):
        raise OSError("no")
    return {"data": [{"index": k, "embedding": [float(t.count("a")), float(t.count("b")), 0.1]} for k, t in enumerate(body["input"])]}


def test_index(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "aaa aa", 0), ("c2", "bbb bb", 1)], "id string, text string, ord long")
    asked = spark.createDataFrame([("q", "aaa")], "query_id string, text string")
    dense = build(chunks, with_send(CHAT, vector))
    assert dense.dense is not None and dense.search(asked, 1).first().key == "c1"
    fallen = build(chunks.unionByName(chunks.limit(1).withColumn("text", F.lit("broken"))), with_send(CHAT, vector))
    assert fallen.dense is None and fallen.search(asked, 1).first().key == "c1"
    assert build(chunks).tfidf is not None
    path = str(tmp_path / "index")
    first = load_or_build(chunks, path)
    assert isinstance(first, SearchIndex) and first.search(asked, 1).first().key == "c1"
    terms = {r.term for r in load_or_build(chunks, path).tfidf[1].collect()}
    changed = chunks.withColumn("text", F.concat("text", F.lit(" new")))
    assert {r.term for r in load_or_build(changed, path).tfidf[1].collect()} == terms | {"new"}


def test_asked_in_order(spark):
    names = spark.createDataFrame([(n, k) for k, n in enumerate(["Alpha Beta", "alpha beta!", "AB", "Gamma", "AB two"])], "name string, ord long")
    seen = []

    def ask(name, known):
        seen.append((name, tuple(known)))
        if name == "Gamma":
            raise OSError("no")
        return {"AB": "Alpha Beta", "AB two": "nobody"}.get(name)

    got = {r.name: r.canonical for r in resolve.resolve_names(names, ask=ask).collect()}
    assert got == {"Alpha Beta": "Alpha Beta", "alpha beta!": "Alpha Beta", "AB": "Alpha Beta", "Gamma": "Gamma", "AB two": "AB two"}
    # asked before a name leads, about the leaders of that time, and not about what resembles one
    assert seen == [("AB", ("Alpha Beta",)), ("Gamma", ("Alpha Beta",)), ("AB two", ("Alpha Beta", "Gamma"))]
    # more than twenty leaders: nobody is asked any more, and the rest is as without a backend
    rnd = random.Random(1)
    many = ["".join(rnd.choice("abcdefgh") for _ in range(12)) for _ in range(40)]
    many += [m + "x" for m in many]
    rows = spark.createDataFrame([(n, k) for k, n in enumerate(many)], "name string, ord long")
    seen.clear()
    got = {r.name: r.canonical for r in resolve.resolve_names(rows, ask=lambda n, k: seen.append(len(k))).collect()}
    assert len(seen) == 20 and max(seen) == 20
    assert got == {r.name: r.canonical for r in resolve.resolve_names(rows).collect()}


def test_numbered(spark):
    rows = spark.createDataFrame([(f"p{k % 7}", k) for k in range(500)], "path string, index int").repartition(5)
    for k, df in enumerate((rows, rows.repartition(3))):
        got = [(r.path, r["index"]) for r in iterate.numbered(df, "path", "index", first=10).orderBy("ord").collect()]
        assert got == sorted(got)
        assert [r.ord for r in iterate.numbered(df, "path", "index", first=10).orderBy("ord").collect()] == list(range(10, 510))


def test_ordinals_do_not_meet(spark):
    chunks = spark.createDataFrame([(f"c{k}", "One Two. Three Four. Five Six.") for k in range(50)], "id string, text string")
    a, b = ({(r.source_chunk, r.subject): r.triple_ord for r in extract.extract(chunks.repartition(k)).collect()} for k in (1, 7))
    assert a == b and len(set(a.values())) == len(a) == 150


def test_two_places(spark):
    rnd = random.Random(2)
    values = [k / 1000 for k in range(0, 3000, 5)] + [rnd.random() for _ in range(2000)] + [rnd.uniform(-1e6, 1e6) for _ in range(2000)] + [0.005, 1.005, 2.675, 1e8 + 0.125, -0.001, 12345678.995]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", T.two_places("x").alias("s")).collect()
    assert [r.s for r in got] == [f"{r.x:.2f}" for r in got]


def test_ontology(spark, tmp_path):
    for keys in (("entities", "relations"), ("entity_types", "relation_types")):
        (tmp_path / "o.json").write_text(json.dumps({keys[0]: [{"type": "A", "label": "a", "description": "d"}], keys[1]: [{"type": "R", "label": "r", "valid_subject": ["A"], "valid_object": ["A"]}]}))
        e, r = load_ontology(spark, str(tmp_path / "o.json"))
        assert [x.type for x in e.collect()] == ["A"] and r.first().valid_subject == ["A"]
    (tmp_path / "o.json").write_text("{}")
    with pytest.raises(ValueError):
        load_ontology(spark, str(tmp_path / "o.json"))


def test_broken_candidates(spark, tmp_path):
    nodes, edges = graph.build(spark.createDataFrame([("a<b>&", "T", "R", "c'd", "U, V", 0.5, "x", "f_chunk_0", 0)], "subject string, subject_type string, relation string, object string, object_type string, confidence double, source_text string, source_chunk string, triple_ord long"))
    s = store.GraphStore(spark, str(tmp_path / "g"))
    s.export(nodes, edges)
    (tmp_path / "broken.graphml").write_text("<graphml><node id=")
    for form in ("graphml", "gexf", "json"):
        n, e = store.load_any(spark, [str(tmp_path / "none.json"), str(tmp_path / "broken.graphml"), f"{s.path}/graph.{form}"])
        assert {r.name for r in n.collect()} == {"a<b>&", "c'd"} and e.first().confidence == 0.5 and e.first().relation == "R"
    assert store.load_any(spark, [str(tmp_path / "none.json")])[0].count() == 0
