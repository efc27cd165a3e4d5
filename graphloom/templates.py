"""Declarative templates: YAML to a record schema, keys, members and options."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.ids import key_template

# --- fixed values: field types and kinds of template
FIELD_TYPES = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "list": T.ArrayType(T.StringType())}
KINDS = ("model", "list", "set", "graph", "hypergraph", "temporal_graph", "spatial_graph", "spatio_temporal_graph")


@dataclass(frozen=True)
class Template:
    """A compiled template."""

    name: str
    kind: str
    schemas: dict[str, T.StructType]
    keys: dict[str, str] = field(default_factory=dict)
    members: tuple[str, ...] = ()
    strategy: str = "keep_existing"
    labels: dict[str, str] = field(default_factory=dict)
    tags: tuple[str, ...] = ()

    def key(self, part: str, none_text: str | None = None) -> Column:
        return key_template(self.keys[part], none_text)

    def label(self, part: str) -> Column:
        """The display text of a row: the part's label template, else its key."""
        return key_template(self.labels.get(part) or self.keys[part])


def localise(value: object, language: str) -> object:
    """A template's value in one language: {en: …, zh: …} gives that language's, else the first one's."""
    if isinstance(value, dict):
        if value and all(isinstance(k, str) and len(k) == 2 for k in value):
            return localise(value.get(language, next(iter(value.values()))), language)
        return {k: localise(v, language) for k, v in value.items()}
    return [localise(v, language) for v in value] if isinstance(value, list) else value


def schema_of(fields: list[dict]) -> T.StructType:
    """Fields to a schema; `required: false` makes a field nullable."""
    made = []
    for f in fields:
        if f.get("type", "str") not in FIELD_TYPES:
            raise ValueError(f"unknown field type {f.get('type')!r} of {f.get('name')!r}")
        made.append(T.StructField(f["name"], FIELD_TYPES[f.get("type", "str")], not f.get("required", True)))
    return T.StructType(made)


def compile_template(source: dict, language: str = "en") -> Template:
    """A parsed template to a Template; raises for unknown kinds, types and key fields."""
    cfg = localise(source, language)
    kind = cfg["type"]
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    output = cfg["output"]
    parts = {"entities": "nodes", "nodes": "nodes", "relations": "edges", "edges": "edges"}
    schemas = {parts[k]: schema_of(v["fields"]) for k, v in output.items() if k in parts and isinstance(v, dict)}
    if not schemas:
        schemas = {"items": schema_of(output["fields"])}
    ids = cfg.get("identifiers") or {}
    renamed = {"item_id": "items", "entity_id": "nodes", "relation_id": "edges"}
    keys = {renamed[k]: v for k, v in ids.items() if k in renamed and isinstance(v, str)}
    for part, key in keys.items():
        used = re.findall(r"\{(\w+)\}", key) or [key]
        lacking = [f for f in used if part in schemas and f not in schemas[part].names]
        if lacking:
            raise ValueError(f"key of {part} names unknown fields {lacking}")
    members = ids.get("relation_members") or ()
    members = (members,) if isinstance(members, str) else tuple(members.values()) if isinstance(members, dict) else tuple(members)
    options = cfg.get("options") or {}
    display = cfg.get("display") or {}
    labels = {p: display[k] for k, p in (("entity_label", "nodes"), ("relation_label", "edges"), ("label", "items")) if k in display}
    return Template(cfg.get("name", ""), kind, schemas, keys, members, options.get("merge_strategy", "keep_existing"), labels, tuple(cfg.get("tags") or ()))


def load_template(path: str | Path, language: str = "en") -> Template:
    """A YAML file compiled; needs PyYAML."""
    import yaml

    return compile_template(yaml.safe_load(Path(path).read_text(encoding="utf-8")), language)


def catalogue(templates: DataFrame, query: str | None = None, kind: str | None = None, tag: str | None = None, language: str | None = None) -> DataFrame:
    """Templates (name, description, kind, tags, languages) that fit all given conditions."""
    out = templates
    if query:
        hay = F.lower(F.concat_ws(" ", "name", "description"))
        out = out.filter(F.contains(hay, F.lit(query.lower())))
    if kind:
        out = out.filter(F.col("kind") == kind)
    if tag:
        out = out.filter(F.array_contains("tags", tag))
    return out.filter(F.array_contains("languages", language)) if language else out
