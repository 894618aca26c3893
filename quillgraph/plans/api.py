"""One function a route; each answers from the tables as they are now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import centrality, community, graph, wiki
from quillgraph.plans.search import hybrid


class NotFound(LookupError):
    """404."""


class BadRequest(ValueError):
    """400."""


class Api:
    def __init__(self, nodes: DataFrame, edges: DataFrame, pages: DataFrame | None = None, chunks: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None):
        self.nodes, self.edges, self.pages, self.chunks, self.index = nodes, edges, pages, chunks, index

    def stats(self) -> DataFrame:
        return graph.stats(self.nodes, self.edges)

    def insights(self, k: int = 5) -> tuple[DataFrame, DataFrame]:
        """The first entities by rank, and all communities."""
        return centrality.top_entities(centrality.centrality(self.nodes, self.edges, ordinals=True), k), community.communities(self.nodes, self.edges)

    def entities(self, q: str = "", kind: str = "", page: int = 1, per: int = 50) -> tuple[DataFrame, DataFrame]:
        return graph.entity_list(self.nodes, self.edges, q, kind, page, per)

    def _known(self, name: str) -> None:
        if graph.find_entity(self.nodes, name).isEmpty():
            raise NotFound(name)

    def entity(self, name: str) -> tuple[DataFrame, DataFrame | None]:
        self._known(name)
        return graph.entity_detail(self.nodes, self.edges, name), wiki.page_of(self.pages, name) if self.pages is not None else None

    def update(self, name: str, kind: str | None = None, outgoing: DataFrame | None = None, incoming: DataFrame | None = None) -> Api:
        return Api(*graph.update_entity(self.nodes, self.edges, name, kind, outgoing, incoming), self.pages, self.chunks, self.index)

    def delete(self, name: str) -> Api:
        self._known(name)
        return Api(*graph.delete_entity(self.nodes, self.edges, name), self.pages, self.chunks, self.index)

    def relations(self) -> DataFrame:
        return graph.relation_types(self.edges, blank=True)

    def graph_data(self) -> tuple[DataFrame, DataFrame]:
        return graph.viz_nodes(self.nodes, self.edges), graph.viz_edges(self.edges)

    def search(self, q: str, k: int = 8) -> DataFrame:
        if not q.strip():
            raise BadRequest("empty query")
        return hybrid(q, self.index, self.chunks, self.nodes, self.edges, k).where(F.col("section") != "path")

    def sync_page(self, name: str) -> tuple[Api, DataFrame]:
        nodes, edges, changes = wiki.sync(self.nodes, self.edges, wiki.page_of(self.pages, name))
        return Api(nodes, edges, self.pages, self.chunks, self.index), changes
