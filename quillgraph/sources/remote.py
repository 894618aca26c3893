"""A remote knowledge base as a Python data source: a tree of documents made of blocks."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 50
#: Block kinds of the remote format.
TEXT, HEADING, TABLE, IMAGE, BULLET = (1, 2), 3, 4, 7, 10

BLOCKS = "array<struct<block_type:int,text:string,style:int,image:string>>"


def blocks_to_markdown(blocks: Column | str) -> Column:
    """Lines of the known kinds; others are dropped."""
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    text = lambda x: F.trim(F.coalesce(x["text"], F.lit("")))

    def line(x: Column) -> Column:
        kind = x["block_type"]
        return (
            F.when(kind.isin(*TEXT), text(x))
            .when(kind == HEADING, F.concat(F.repeat(F.lit("#"), F.coalesce(x["style"], F.lit(1))), F.lit(" "), text(x)))
            .when(kind == BULLET, F.concat(F.lit("- "), text(x)))
            .when((kind == IMAGE) & (F.coalesce(x["image"], F.lit("")) != ""), F.concat(F.lit("![image](img_"), x["image"], F.lit(".bin)")))
            .when(kind == TABLE, F.lit("[table]"))
        )

    return F.array_join(F.filter(F.transform(b, line), lambda s: s.isNotNull() & (s != "")), "\n")


def text_of(block: dict) -> str:
    """Text runs or bare strings, joined and trimmed."""
    body = next((block[k] for k in ("text", "heading", "bullet") if k in block), block)
    runs = body.get("elements", body.get("text", [])) if isinstance(body, dict) else body
    if isinstance(runs, str):
        return runs.strip()
    return "".join(r if isinstance(r, str) else r.get("text_run", {}).get("content", "") or r.get("content", "") for r in runs).strip()


class HttpTransport:
    """GET with a cached tenant token; answers with a non-zero code are warnings, not errors."""

    def __init__(self, base: str, app_id: str, app_secret: str):
        self.base, self.app_id, self.app_secret, self.token, self.until = base.rstrip("/"), app_id, app_secret, "", 0.0

    def _token(self) -> str:
        if time.time() > self.until:
            body = json.dumps({"app_id": self.app_id, "app_secret": self.app_secret}).encode()
            with urllib.request.urlopen(urllib.request.Request(f"{self.base}/auth/v3/tenant_access_token/internal", body, {"Content-Type": "application/json"}), timeout=60) as f:
                answer = json.load(f)
            self.token, self.until = answer.get("tenant_access_token", ""), time.time() + answer.get("expire", 3600) - 60
        return self.token

    def __call__(self, path: str, params: dict) -> dict:
        query = "&".join(f"{k}={v}" for k, v in params.items() if v is not None)
        request = urllib.request.Request(f"{self.base}{path}?{query}", headers={"Authorization": f"Bearer {self._token()}"})
        with urllib.request.urlopen(request, timeout=60) as f:
            return json.load(f).get("data", {}) or {}


def walk(get: Callable[[str, dict], dict], space: str, parent: str | None = None) -> Iterator[dict]:
    """Nodes depth first, page by page."""
    token = None
    while True:
        data = get(f"/wiki/v2/spaces/{space}/nodes", {"page_size": PAGE, "parent_node_token": parent, "page_token": token})
        for node in data.get("items", []):
            yield node
            if node.get("has_child"):
                yield from walk(get, space, node.get("node_token"))
        token = data.get("page_token")
        if not data.get("has_more") or not token:
            return


class _Subtree(InputPartition):
    def __init__(self, node: dict):
        super().__init__(None)
        self.node = node


class _Reader(DataSourceReader):
    def __init__(self, options: dict, make: Callable[[dict], Callable[[str, dict], dict]]):
        self.options, self.make = options, make

    def partitions(self):
        """One partition a top node."""
        space, root, token, out = self.options["space"], self.options.get("root"), None, []
        get = self.make(self.options)
        while True:
            data = get(f"/wiki/v2/spaces/{space}/nodes", {"page_size": PAGE, "parent_node_token": root, "page_token": token})
            out += [_Subtree(n) for n in data.get("items", [])]
            token = data.get("page_token")
            if not data.get("has_more") or not token:
                return out

    def read(self, partition):
        get, space = self.make(self.options), self.options["space"]
        nodes = [partition.node]
        if partition.node.get("has_child"):
            nodes += walk(get, space, partition.node.get("node_token"))
        for node in nodes:
            if node.get("obj_type") != "docx":
                continue
            blocks, token = [], None
            try:
                while True:
                    data = get(f"/docx/v1/documents/{node['obj_token']}/blocks", {"page_size": 500, "page_token": token})
                    blocks += data.get("items", [])
                    token = data.get("page_token")
                    if not data.get("has_more") or not token:
                        break
            except Exception:
                continue  # a document that fails is left out
            rows = [(b.get("block_type"), text_of(b), (b.get("heading") or {}).get("style", b.get("style")) if isinstance(b.get("heading"), dict) else b.get("style"), (b.get("image") or {}).get("token") if isinstance(b.get("image"), dict) else None) for b in blocks]
            yield (node["obj_token"], node.get("title", ""), rows)


def data_source(name: str, make: Callable[[dict], Callable[[str, dict], dict]]) -> type[DataSource]:
    """A data source class whose transport ``make(options)`` builds in each worker."""

    class Remote(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"token string, title string, blocks {BLOCKS}"

        def reader(self, schema):
            return _Reader(dict(self.options), make)

    return Remote


def http_transport(options: dict) -> HttpTransport:
    return HttpTransport(options["base"], options["app_id"], options["app_secret"])


def register(spark: SparkSession, name: str = "remote_wiki", make: Callable = http_transport) -> None:
    spark.dataSource.register(data_source(name, make))


def documents(raw: DataFrame) -> DataFrame:
    """token, title, text (title as heading, blank line, body)."""
    return raw.select("token", "title", F.concat(F.lit("# "), "title", F.lit("\n\n"), blocks_to_markdown("blocks")).alias("text"))
