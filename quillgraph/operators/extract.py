"""Triples from chunks through a backend; the default one is deterministic.

A backend is a callable that takes (text, chunk id, contexts, image path) and returns the raw
answer, a text that holds a JSON array of triples.  Workers call it; a repeated task calls it
again, so a backend must bear that.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import parse_triples
from quillgraph.operators.graph import confident
from quillgraph.operators.iterate import numbered
from quillgraph.schemas import TRIPLES

Backend = Callable[[str, str, list[tuple[str, float]], str | None], str]


def rule_backend(text: str, chunk_id: str, contexts: list[tuple[str, float]], image_path: str | None = None) -> str:
    """Neighbouring capitalised words of a sentence are related; fixed confidences; no network."""
    found = []
    for sentence in re.split(r"[.!?\n]+", text):
        names = re.findall(r"[^\W\d_a-zà-ÿ][\w-]+", sentence)
        for a, b in zip(names, names[1:], strict=False):
            if a != b:
                found.append({"subject": a, "subject_type": "Term", "relation": "NEAR", "object": b, "object_type": "Term", "confidence": 0.8, "source_text": sentence.strip()[:200]})
    return json.dumps(found, ensure_ascii=False)


def build_prompt(text: str, entity_types: list[str], relation_types: list[str], contexts: list[tuple[str, float]]) -> str:
    """vocabulary, text, and three contexts of 500 characters at most."""
    parts = ["List the relations that the text states, as a JSON array of objects with the keys subject, subject_type, relation, object, object_type, confidence and source_text.", "Entity types: " + ", ".join(entity_types), "Relation types: " + ", ".join(relation_types)]
    if contexts:
        parts.append("Related passages:\n" + "\n".join(f"[{score:.2f}] {t[:500]}" for t, score in contexts[:3]))
    return "\n\n".join([*parts, "Text:\n" + text])


def image_message(content: bytes, mime: str, prompt: str) -> list[dict]:
    """A prompt with an image, as chat APIs take it."""
    data = base64.b64encode(content).decode()
    return [{"role": "user", "content": [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:{mime};base64,{data}"}}]}]


def mime_of_path(path: str) -> str:
    ext = path.rsplit(".", 1)[-1].lower()
    return "image/jpeg" if ext in ("jpg", "jpeg") else f"image/{ext}" if ext in ("webp", "bmp", "gif") else "image/png"


def extract(chunks: DataFrame, backend: Backend = rule_backend, threshold: float = 0.7, contexts: DataFrame | None = None, k: int = 3) -> DataFrame:
    """Triples of chunks (id, text, ...), with provenance, above the threshold.

    An answer that cannot be parsed, and a backend's error, give the chunk no triples.
    ``contexts`` (id, text, score, rank) come from retrieval.  ``ord`` numbers the chunks (each
    its own number); where there is none, they are numbered by id.
    """
    rows = chunks.select("id", "text", *(["image_path"] if "image_path" in chunks.columns else [F.lit(None).cast("string").alias("image_path")]), *(["ord"] if "ord" in chunks.columns else []))
    if "ord" not in rows.columns:
        rows = numbered(rows, "id", "text")
    if contexts is not None:
        near = contexts.where(F.col("rank") <= k).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "score"))), lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score"))).alias("contexts"))
        rows = rows.join(near, "id", "left")
    else:
        rows = rows.withColumn("contexts", F.expr("cast(null as array<struct<text:string,score:double>>)"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = []
            for r in pdf.itertuples():
                near = [(x["text"], x["score"]) for x in r.contexts] if r.contexts is not None else []
                try:
                    answers.append(backend(r.text or "", r.id, near, r.image_path))
                except Exception:
                    answers.append("")
            yield pd.DataFrame({"id": pdf.id, "ord": pdf.ord, "raw": answers})

    raw = rows.mapInPandas(run, "id string, ord long, raw string")
    one = raw.select("id", "ord", F.posexplode(parse_triples("raw")).alias("pos", "t")).select("t.*", F.col("id").alias("source_chunk"), F.struct("ord", "id", "pos").alias("_at"))
    # ordinals for first-wins rules: by chunk number, then place in the answer, which an answer
    # of two gigabytes does not exhaust
    out = confident(one, threshold).withColumn("triple_ord", F.shiftleft(F.col("_at.ord"), 24) + F.col("_at.pos")).drop("_at")
    return out.select(*[c.strip().split(" ")[0] for c in TRIPLES.split(",")])


def validate(triples: DataFrame, relation_types: DataFrame) -> DataFrame:
    """Ontology check: triples with a column ``problem`` (null where there is none)."""
    o = F.broadcast(relation_types.select(F.col("type").alias("relation"), "valid_subject", "valid_object", F.lit(True).alias("_known")))
    t = triples.join(o, "relation", "left")
    problem = F.when(F.col("_known").isNull(), "unknown relation").when(~F.coalesce(F.array_contains("valid_subject", F.col("subject_type")), F.lit(True)), "subject type").when(~F.coalesce(F.array_contains("valid_object", F.col("object_type")), F.lit(True)), "object type")
    return t.withColumn("problem", problem).drop("valid_subject", "valid_object", "_known")
