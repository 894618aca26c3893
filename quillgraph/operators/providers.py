"""Chat, vision and embedding endpoints, and the tasks that use them.

A ``Provider`` is a plain value that workers take along.  Two kinds of endpoint are known:
``chat`` (messages under ``/chat/completions``, embeddings under ``/embeddings``) and
``generate`` (``/api/generate``, ``/api/embed``).  ``send`` may be replaced, as tests do.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import vectors, wiki
from quillgraph.operators.extract import build_prompt, image_message, mime_of_path

#: Names that configurations give the two kinds, and parts of addresses of chat endpoints.
CHAT = ("lmstudio", "openai")
CHAT_HOSTS = ("openai", "dashscope")


def post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as f:
        return json.load(f)


@dataclass(frozen=True)
class Provider:
    base: str
    model: str
    kind: str = "generate"
    key: str = field(default="", repr=False)
    temperature: float = 0.0
    timeout: float = 120
    vision_model: str | None = None
    embedding_model: str = "text-embedding-v3"
    send: Callable[[str, dict, dict[str, str], float], dict] = field(default=post, repr=False)

    @staticmethod
    def of(config: dict) -> Provider:
        """From a map with ``llm`` (provider, base_url, model, api_key, temperature, timeout, vision_model) and ``embedding`` (model)."""
        llm, extra = config["llm"], config.get("embedding") or {}
        base = llm["base_url"].rstrip("/")
        chat = llm.get("provider", "ollama") in CHAT
        named = {k: v for k, v in (("temperature", llm.get("temperature")), ("timeout", llm.get("timeout")), ("vision_model", llm.get("vision_model")), ("embedding_model", extra.get("model"))) if v is not None}
        return Provider(base, llm["model"], "chat" if chat else "generate", llm.get("api_key") or "", **named)

    @property
    def embeds(self) -> bool:
        """V2."""
        return self.kind == "chat" or any(h in self.base.lower() for h in CHAT_HOSTS)

    def _call(self, path: str, body: dict, timeout: float | None, tries: int) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for k in range(tries):
            try:
                return self.send(self.base + path, body, headers, timeout or self.timeout)
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(2**k)
        raise ValueError("no tries")

    def _answer(self, model: str, prompt: str, image: tuple[bytes, str] | None, temperature: float | None, timeout: float | None, tries: int) -> str:
        t = self.temperature if temperature is None else temperature
        if self.kind == "chat":
            messages = image_message(*image, prompt) if image else [{"role": "user", "content": prompt}]
            found = self._call("/chat/completions", {"model": model, "messages": messages, "temperature": t, "stream": False}, timeout, tries)
            return found["choices"][0]["message"]["content"]
        pictures = {"images": [base64.b64encode(image[0]).decode()]} if image else {}
        return self._call("/api/generate", {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": t}} | pictures, timeout, tries).get("response", "")

    def complete(self, prompt: str, temperature: float | None = None, timeout: float | None = None, tries: int = 1) -> str:
        """A text for a text."""
        return self._answer(self.model, prompt, None, temperature, timeout, tries)

    def see(self, prompt: str, content: bytes, mime: str, tries: int = 1) -> str:
        """A text for a text and an image."""
        return self._answer(self.vision_model or self.model, prompt, (content, mime), None, None, tries)

    def embed(self, texts: list[str]) -> list[list[float]]:
        """V8: a vector a text, in their order."""
        body = {"model": self.embedding_model, "input": texts}
        if self.embeds:
            return [x["embedding"] for x in sorted(self._call("/embeddings", body, 60, 1)["data"], key=lambda x: x["index"])]
        return self._call("/api/embed", body, 60, 1)["embeddings"]


def read_image(path: str) -> bytes:
    """The bytes of a file that workers reach by its address."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)
    with fs.open_input_stream(at) as f:
        return f.read()


@dataclass(frozen=True)
class ExtractionBackend:
    """X1's backend on a provider: texts by completion, images by vision; three tries, waits of one and two seconds."""

    provider: Provider
    entity_types: tuple[str, ...] = ()
    relation_types: tuple[str, ...] = ()
    tries: int = 3

    def __call__(self, text: str, chunk_id: str, contexts: list[tuple[str, float]], image_path: str | None = None) -> str:
        prompt = build_prompt(text, list(self.entity_types), list(self.relation_types), contexts)
        if image_path:
            return self.provider.see(prompt, read_image(image_path), mime_of_path(image_path), self.tries)
        return self.provider.complete(prompt, tries=self.tries)


# --- summaries and lint


def summaries(nodes: DataFrame, edges: DataFrame, complete: Callable[[str], str], most: int = 5) -> DataFrame:
    """Name, summary.  The prompt has the ``most`` strongest relations each way.

    Where the backend fails the second default sentence stands, which counts all relations.
    """
    near = wiki.neighbours(edges)
    entry = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("k"), "other", F.when(F.col("direction") == "outgoing", F.concat("entity", F.lit(" --["), F.coalesce("relation", F.lit("")), F.lit("]--> "), "other")).otherwise(F.concat("other", F.lit(" --["), F.coalesce("relation", F.lit("")), F.lit("]--> "), "entity")).alias("line"))
    some = lambda d: F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("direction") == d, entry))), 1, most), lambda x: x["line"])
    lists = near.groupBy("entity").agg(F.concat(some("outgoing"), some("incoming")).alias("lines"), F.count(F.lit(1)).alias("n"))
    rows = nodes.where(~wiki.is_junk("name")).join(lists, F.col("name") == F.col("entity"), "left")
    rows = rows.select("name", F.when(F.size("types") > 0, F.array_join("types", ", ")).otherwise("ENTITY").alias("kind"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), F.coalesce("n", F.lit(0)).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in zip(pdf["name"], pdf["kind"], pdf["lines"], pdf["n"], strict=True):
                prompt = f"Summarise the entity {r[0]} (type {r[1]}) in one short paragraph, from these relations alone:\n" + "\n".join(f"- {x}" for x in r[2])
                try:
                    out.append(complete(prompt).strip())
                except Exception:
                    out.append(f"{r[0]} is a {r[1]} entity connected to {r[3]} other entities.")
            yield pd.DataFrame({"name": pdf["name"], "summary": out})

    return rows.mapInPandas(run, "name string, summary string")


def resolved_contradictions(triples: DataFrame, complete: Callable[[str], str], most: int = 5) -> DataFrame:
    """L2: of the first contradictory pairs, what the backend selects, and why; UNRESOLVED where it fails."""
    pairs = wiki.contradictions(triples).orderBy("subject", "object").limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for s, o, relations in zip(pdf.subject, pdf.object, pdf.relations, strict=True):
                prompt = f"Which one relation from {s} to {o} is right: {', '.join(relations)}? Answer as JSON with the keys selected_relation and reason."
                try:
                    answer = json.loads(complete(prompt))
                    found.append((answer.get("selected_relation", ""), answer.get("reason", "")))
                except Exception:
                    found.append(("UNRESOLVED", "no answer"))
            yield pd.DataFrame({"subject": pdf.subject, "object": pdf.object, "relations": pdf.relations, "resolution": [a for a, _ in found], "reason": [b for _, b in found]})

    return pairs.mapInPandas(run, "subject string, object string, relations array<string>, resolution string, reason string")


# --- embeddings, with TF-IDF behind them


def embedded(chunks: DataFrame, provider: Provider, batch: int = 64) -> DataFrame:
    """V8: id and embedding of chunks, by the workers, ``batch`` texts a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                yield pd.DataFrame({"id": part.id, "embedding": provider.embed(part.text.fillna("").tolist())})

    return chunks.select("id", "text").mapInPandas(run, "id string, embedding array<float>")


@dataclass(frozen=True)
class SearchIndex:
    """V1: an index of chunks: dense where a provider embeds them, else TF-IDF."""

    chunks: DataFrame
    tfidf: tuple[DataFrame, DataFrame] | None = None
    dense: DataFrame | None = None
    provider: Provider | None = None

    def search(self, queries: DataFrame, k: int = 5, floor: float = 0.01) -> DataFrame:
        """V4: query_id, key, score, rank, of queries (query_id, text)."""
        if self.dense is None:
            return vectors.top_k(self.tfidf, queries, self.chunks.select(F.col("id").alias("key"), F.col("ord").alias("idx")), k, floor)
        asked = embedded(queries.select(F.col("query_id").cast("string").alias("id"), "text"), self.provider)
        hits = vectors.dense_top_k(self.dense, asked, k, key="id").where(F.col("score") > floor)
        return hits.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))


def build(chunks: DataFrame, provider: Provider | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> SearchIndex:
    """V1 and V2: embeddings if the provider has them; if any call fails, TF-IDF.

    ``keep`` makes the embeddings durable (a checkpoint or a written table), which also shows
    whether all calls went well.
    """
    if provider is not None and provider.embeds:
        from quillgraph.operators.iterate import cut

        try:
            return SearchIndex(chunks, dense=(keep or cut)(embedded(chunks, provider)), provider=provider)
        except Exception:  # any failure of the endpoint
            pass
    return SearchIndex(chunks, tfidf=vectors.build_index(chunks))


def load_or_build(chunks: DataFrame, path: str) -> SearchIndex:
    """V6: the stored TF-IDF index if its chunks are these, else a new one, stored in its place.

    ``path`` holds chunks (id, text, ord), weights and idf.
    """
    from quillgraph.sources.store import read_or_empty

    spark = chunks.sparkSession
    stored = read_or_empty(spark, f"{path}/chunks", "id string, text string, ord bigint")
    mine = chunks.select("id", "text", F.col("ord").cast("long").alias("ord"))
    if stored.isEmpty() or vectors.needs_rebuild(stored, mine).first().stale:
        vectors.save_index(vectors.build_index(chunks), path)
        mine.write.mode("overwrite").parquet(f"{path}/chunks")
    return SearchIndex(chunks, tfidf=vectors.load_index(spark, path))
