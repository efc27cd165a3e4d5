"""Registered methods: how each shapes keys, merging and indexes of the graph it builds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from graphloom.containers import Graph


@dataclass(frozen=True)
class Method:
    """A graph preset. edge_key "members" stands for the sorted members of a hyperedge."""

    node_key: str
    edge_key: str
    strategy: str
    node_fields: tuple[str, ...]
    edge_fields: tuple[str, ...]
    hyper: bool = False
    stages: int = 2

    def build(self, nodes: DataFrame, edges: DataFrame) -> Graph:
        return Graph.of(nodes, edges, node_key=self.node_key, edge_key=self.edge_key, strategy=self.strategy, hyper=self.hyper)


_ENTITY = ("name", "type", "description")

#: Fixed presets by method name.
METHODS = {
    "graph_rag": Method("name", "({source},{target})", "rule", _ENTITY, ("description",), stages=1),
    "light_rag": Method("name", "{source}->{target}", "rule", _ENTITY, ("keywords", "description"), stages=1),
    "hyper_rag": Method("name", "members", "rule", _ENTITY, ("keywords", "description"), hyper=True),
    "hypergraph_rag": Method("name", "knowledge_segment", "rule", _ENTITY, ("knowledge_segment",), hyper=True, stages=1),
    "cog_rag": Method("name", "members", "rule", _ENTITY, ("description", "keywords"), hyper=True),
    "kg_gen": Method("name", "{source}|{edge_type}|{target}", "keep_existing", ("name",), ("source", "edge_type", "target")),
    "itext2kg": Method("name", "{source}|{name}|{target}", "rule", ("name", "label"), ("source", "name", "target")),
    "itext2kg_star": Method("name", "{source}|{name}|{target}", "keep_existing", ("name", "label"), ("source", "name", "target"), stages=1),
    "atom": Method("name", "{source}|{name}|{target}", "rule", ("name", "label"), ("source", "name", "target"), stages=1),
    "course_knowledge_graph": Method("name", "{source}|{target}|{edge_type}", "keep_existing", ("name", "summary"), ("description",)),
}


def register(name: str, method: Method) -> None:
    """Adds a method of one's own; a known name is an error."""
    if name in METHODS:
        raise ValueError(f"{name} is registered already")
    METHODS[name] = method
