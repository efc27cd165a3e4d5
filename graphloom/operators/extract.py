"""Typed records from text: pluggable extractors run in Arrow batches, one- and two-stage graphs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Takes a chunk's text and its context (known names, observation time and place) and returns records,
#: None for nothing. It runs on the executors, so it has to be picklable.
Extractor = Callable[[str, dict[str, object]], "list[dict] | None"]

NODE = "name string, type string, description string"
EDGE = "source string, target string, edge_type string, description string"


def extract(chunks: DataFrame, key: list[str], text: str, extractor: Extractor, schema: str, context: list[str] | None = None) -> DataFrame:
    """(key…, item_no, fields…, error): the records of every chunk, in order.

    Chunks for which the extractor returns None or nothing have no rows. An extractor that raises gives
    one row with the error and null fields, so that a bad chunk costs only itself. context columns are
    handed to the extractor. Null texts are left out.
    """
    context = context or []
    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in key)
    fields = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                place = tuple(row[k] for k in key)
                try:
                    found = extractor(row[text], {c: row[c] for c in context}) or []
                    rows += [(*place, i, *(r.get(f) for f in fields), None) for i, r in enumerate(found)]
                except Exception as failure:  # a record of the failure takes the records' place
                    rows.append((*place, -1, *(None for _ in fields), f"{type(failure).__name__}: {failure}"[:500]))
            yield pd.DataFrame(rows, columns=[*key, "item_no", *fields, "error"])

    wanted = chunks.select(*dict.fromkeys([*key, text, *context])).filter(F.col(text).isNotNull())
    return wanted.mapInPandas(run, f"{kinds}, item_no int, {schema}, error string")


def known_names(nodes: DataFrame, key: list[str], name: str, none_text: str = "No known entities.") -> DataFrame:
    """(key…, known): the distinct names of each chunk as a list for the second stage."""
    rows = nodes.filter(F.col(name).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_set(name)).alias("_n"))
    return rows.select(*key, F.when(F.size("_n") > 0, F.concat(F.lit("- "), F.array_join("_n", "\n- "))).otherwise(F.lit(none_text)).alias("known"))


@dataclass(frozen=True)
class GraphExtractors:
    """Extractors of a graph's nodes and edges."""

    nodes: Extractor
    edges: Extractor


def extract_graph(chunks: DataFrame, key: list[str], text: str, extractors: GraphExtractors, two_stage: bool = True, context: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all chunks, not merged.

    One-stage: both from the text alone. Two-stage: edges are extracted with the chunk's own node names
    as `known`; the names come back to their chunk by one shuffle on its key.
    """
    context = context or []
    nodes = extract(chunks, key, text, extractors.nodes, NODE, context)
    if not two_stage:
        return nodes, extract(chunks, key, text, extractors.edges, EDGE, context)
    informed = chunks.join(known_names(nodes.filter("error is null"), key, "name"), key, "left").fillna({"known": "No known entities."})
    return nodes, extract(informed, key, text, extractors.edges, EDGE, [*context, "known"])


def nodes_of_edges(edges: DataFrame, key: list[str], columns: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Edge-first extraction: the nodes that the edges name."""
    rows = edges.filter("error is null").select(*key, "item_no", F.posexplode(F.array(*columns)).alias("_end", "name"))
    return rows.filter("trim(name) <> ''").select(*key, (F.col("item_no") * len(columns) + F.col("_end")).alias("item_no"), "name")


# ---- deterministic extractors, in place of a model

_TERM = re.compile(r"`([^`\n]{2,60})`|《([^》\n]{2,40})》|\b((?:[A-Z][a-z]+ ){1,4}[A-Z][a-z]+)\b")
_SENTENCE = re.compile(r"(?<=[。！？])|(?<=[.!?])\s+|\n+")


def term_nodes(text: str, context: dict[str, object]) -> list[dict]:
    """Terms in back quotes or book-title marks, and runs of capitalised words, once each."""
    found = dict.fromkeys(next(g for g in m.groups() if g) for m in _TERM.finditer(text))
    return [{"name": t, "type": "term", "description": None} for t in found]


def term_edges(text: str, context: dict[str, object]) -> list[dict]:
    """`related` between neighbouring terms of a sentence, described by the sentence. Where the context has
    `known` names, as in a second stage, only those are linked."""
    known = context.get("known")
    names = {line.removeprefix("- ") for line in str(known).split("\n")} if known is not None else None
    out = []
    for sentence in _SENTENCE.split(text):
        terms = list(dict.fromkeys(next(g for g in m.groups() if g) for m in _TERM.finditer(sentence)))
        terms = [t for t in terms if names is None or t in names]
        out += [{"source": a, "target": b, "edge_type": "related", "description": sentence.strip()} for a, b in zip(terms, terms[1:])]
    return out


TERMS = GraphExtractors(term_nodes, term_edges)


def parse_records(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with `record`, a model's JSON answer as a struct, and `state`: ok, none, truncated, invalid
    or mismatch (JSON of another shape)."""
    from graphloom.functions.text import extract_json

    parsed = rows.withColumn("_j", extract_json(F.col(column)))
    record = F.from_json(F.col("_j.value"), schema, {"mode": "PERMISSIVE"})
    empty = json.loads(T._parse_datatype_string(schema).json())["fields"]
    filled = F.coalesce(*[F.col("record")[f["name"]].cast("string") for f in empty]).isNotNull()
    return parsed.withColumn("record", record).withColumn("state", F.when((F.col("_j.state") == "ok") & ~filled, "mismatch").otherwise(F.col("_j.state"))).drop("_j")
