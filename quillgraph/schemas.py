"""Schemas of the data model, and the ontology as small DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

RAW_FILES = "path string, modificationTime timestamp, length bigint, content binary"
CHUNKS = "id string, source string, index int, text string, word_count int, image_path string, ord bigint"
TRIPLES = "subject string, subject_type string, relation string, object string, object_type string, confidence double, source_text string, source_chunk string, triple_ord bigint"
NODES = "name string, types array<string>, node_ord bigint"
EDGES = "src string, dst string, relation string, confidence double, source_text string, source_chunk string, wiki_updated boolean"
SNAPSHOT = "path string, hash string, chunk_ids array<string>"
PAGES = "name string, filename string, type string, content string"
CHANGES = "page_ord bigint, entity string, phase int, direction string, action string, relation string, other string, confidence double, old_confidence double, new_type string"
LINT = "type string, severity string, count bigint, message string, samples array<string>"

DEFAULT_RELATION = "RELATED_TO"
DEFAULT_TYPE = "ENTITY"


# The default settings.
@dataclass(frozen=True)
class Settings:
    """Numbers and names that operators take as defaults."""

    strategy: str = "fixed"
    separator: str = "\n\n"
    chunk_size: int = 1500
    overlap: int = 250
    confidence_threshold: float = 0.7
    similarity: float = 0.85
    damping: float = 0.85
    path_depth: int = 3
    neighbour_depth: int = 2
    top_k: int = 5
    context_k: int = 3
    score_floor: float = 0.01


def load_settings(path: str | None = None) -> Settings:
    """Settings from a YAML (or JSON) map; keys that are not known are ignored."""
    if path is None:
        return Settings()
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    try:
        import yaml

        found = yaml.safe_load(raw) or {}
    except ImportError:
        found = json.loads(raw)
    flat = {}
    for k, v in found.items():
        flat |= v if isinstance(v, dict) else {k: v}
    known = Settings.__dataclass_fields__
    return Settings(**{k: v for k, v in flat.items() if k in known and v is not None})


def load_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """entity_types (type, label, description), relation_types (type, label, valid_subject, valid_object).

    The file has lists ``entities`` and ``relations`` (or ``entity_types`` and ``relation_types``);
    one that has neither is an error.
    """
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not {"entities", "relations", "entity_types", "relation_types"} & set(found):
        raise ValueError(f"no ontology in {path}")
    entities = [(e.get("type"), e.get("label"), e.get("description")) for e in found.get("entities", found.get("entity_types", []))]
    relations = [(r.get("type"), r.get("label"), r.get("valid_subject"), r.get("valid_object")) for r in found.get("relations", found.get("relation_types", []))]
    return (
        spark.createDataFrame(entities, "type string, label string, description string"),
        spark.createDataFrame(relations, "type string, label string, valid_subject array<string>, valid_object array<string>"),
    )
