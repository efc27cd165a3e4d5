"""The eight knowledge containers, each a thin value around DataFrames.

A container is immutable: every change gives a new one, without its index. Rows carry `seq`, a total
order in which they came; merging and `first` and `last` go by it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import edge_key, key_template
from graphloom.functions.vectors import embed, hash_vector
from graphloom.operators import graphs, lists, sets
from graphloom.operators.extract import GraphExtractors, extract_graph
from graphloom.operators.merge import keyed_merge
from graphloom.operators.search import context_text, search
from graphloom.session import cut_lineage


def _index(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, vector): a vector of the named fields of each row as JSON."""
    return rows.select(key, embed(F.to_json(F.struct(*fields))).alias("vector"))


def _nearest(rows: DataFrame, index: DataFrame | None, key: str, query: str, k: int) -> DataFrame:
    if index is None:
        raise ValueError("there is no index; build one first")
    return rows.join(search(index, key, "vector", hash_vector(query), k).select(key, "distance"), key)


@dataclass(frozen=True)
class KeyedSet:
    """Items, one per key. key names a column or is a template of columns."""

    items: DataFrame
    key: str
    strategy: str = "keep_existing"
    index: DataFrame | None = field(default=None, compare=False)

    @classmethod
    def of(cls, rows: DataFrame, key: str, strategy: str = "keep_existing") -> KeyedSet:
        """Rows (with seq) merged by key; rows whose key is null or blank are left out."""
        keyed = rows.withColumn("_key", key_template(key)).filter("trim(_key) <> ''")
        return cls(keyed_merge(keyed, ["_key"], ["seq"], strategy), key, strategy)

    def _with(self, items: DataFrame) -> KeyedSet:
        return replace(self, items=items, index=None)

    def add(self, rows: DataFrame) -> KeyedSet:
        """More rows merged in after those that are there."""
        more = KeyedSet.of(rows, self.key, self.strategy).items
        return self._with(sets.union(self.items, more, ["_key"], self.strategy, "_side"))

    def __or__(self, other: KeyedSet) -> KeyedSet:
        return self._with(sets.union(self.items, other.items, ["_key"], self.strategy, "_side"))

    def __and__(self, other: KeyedSet) -> KeyedSet:
        return self._with(sets.intersection(self.items, other.items, ["_key"]))

    def __sub__(self, other: KeyedSet) -> KeyedSet:
        return self._with(sets.difference(self.items, other.items, ["_key"]))

    def __xor__(self, other: KeyedSet) -> KeyedSet:
        return self._with(sets.symmetric_difference(self.items, other.items, ["_key"]))

    def relation(self, other: KeyedSet) -> dict[str, bool]:
        return sets.relation(self.items, other.items, ["_key"]).first().asDict()

    def discard(self, *keys: str) -> KeyedSet:
        return self._with(self.items.filter(~F.col("_key").isin(*keys)))

    def get(self, key: str) -> DataFrame:
        return self.items.filter(F.col("_key") == key)

    def __contains__(self, key: str) -> bool:
        return bool(self.get(key).take(1))

    def clear(self) -> KeyedSet:
        return self._with(self.items.limit(0))

    def build_index(self, fields: list[str]) -> KeyedSet:
        return replace(self, index=_index(self.items, "_key", fields))

    def search(self, query: str, k: int = 3) -> DataFrame:
        return _nearest(self.items, self.index, "_key", query, k)

    def context(self, query: str, k: int = 3) -> DataFrame:
        columns = [c for c in self.items.columns if c not in ("_key", "seq")]
        return context_text(self.search(query, k), "distance", columns)


@dataclass(frozen=True)
class OrderedList:
    """Items in order of pos."""

    items: DataFrame
    index: DataFrame | None = field(default=None, compare=False)

    @classmethod
    def of(cls, rows: DataFrame, *order: Column) -> OrderedList:
        return cls(lists.renumber(rows, list(order)))

    def __add__(self, other: OrderedList) -> OrderedList:
        difference = lists.schema_difference(self.items, other.items)
        if any(difference.values()):
            raise TypeError(f"schemas differ: {difference}")
        return OrderedList(lists.concat(self.items, other.items))

    def __len__(self) -> int:
        return lists.length(self.items)

    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1) -> OrderedList:
        return OrderedList(lists.slice_(self.items, start, stop, step))

    def insert(self, at: int, rows: DataFrame) -> OrderedList:
        return OrderedList(lists.insert(self.items, at, rows))

    def pop(self, at: int = -1) -> OrderedList:
        return OrderedList(lists.delete(self.items, at))

    def remove(self, item: dict[str, object]) -> OrderedList:
        return OrderedList(lists.remove(self.items, item))

    def position(self, item: dict[str, object]) -> int | None:
        return lists.find(self.items, item)

    def count(self, item: dict[str, object]) -> int:
        return lists.count(self.items, item)

    def reverse(self) -> OrderedList:
        """In reverse; the order of items is no content, so an index stays valid if keyed by item, and is dropped as it is keyed by pos."""
        return OrderedList(lists.reverse(self.items))

    def sort(self, *order: Column) -> OrderedList:
        return OrderedList(lists.renumber(self.items, list(order)))

    def build_index(self, fields: list[str]) -> OrderedList:
        return replace(self, index=_index(self.items, "pos", fields))

    def search(self, query: str, k: int = 3) -> DataFrame:
        return _nearest(self.items, self.index, "pos", query, k)


@dataclass(frozen=True)
class Record:
    """One record per document: its fields merged from the document's chunks."""

    rows: DataFrame
    doc: str

    @classmethod
    def of(cls, rows: DataFrame, doc: str, strategy: str = "merge_field") -> Record:
        return cls(keyed_merge(rows, [doc], ["seq"], strategy), doc)

    def update(self, rows: DataFrame, strategy: str = "merge_field") -> Record:
        both = self.rows.withColumn("_side", F.lit(0)).unionByName(rows.withColumn("_side", F.lit(1)))
        return Record(keyed_merge(both, [self.doc], ["_side", "seq"], strategy).drop("_side"), self.doc)

    def is_empty(self) -> DataFrame:
        """(doc, empty): whether all fields are null, blank or empty."""
        blank = F.lit(True)
        for f in self.rows.schema.fields:
            if f.name in (self.doc, "seq"):
                continue
            c = F.col(f.name)
            kind = f.dataType.typeName()
            none = F.coalesce(F.size(c), F.lit(0)) <= 0 if kind in ("array", "map") else c.isNull() | (F.length(F.trim(c)) == 0 if kind == "string" else F.lit(False))
            blank = blank & none
        return self.rows.select(self.doc, blank.alias("empty"))

    def fields(self) -> DataFrame:
        """(doc, field, value): the filled fields, as rows to index and search."""
        names = [c for c in self.rows.columns if c not in (self.doc, "seq")]
        pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names])
        return self.rows.select(self.doc, F.explode(pairs).alias("_p")).select(self.doc, "_p.*").filter("value is not null")


@dataclass(frozen=True)
class Graph:
    """Nodes by key and edges by key with two ends; or hyperedges, whose `members` are an array.

    time and place name columns of the edges that take part in their keys, which makes the graph a
    temporal, spatial or spatio-temporal one.
    """

    nodes: DataFrame
    edges: DataFrame
    node_key: str = "name"
    edge_key: str = "{source}|{edge_type}|{target}"
    time: str | None = None
    place: str | None = None
    strategy: str = "keep_existing"
    hyper: bool = False
    indexes: tuple[DataFrame | None, DataFrame | None] = field(default=(None, None), compare=False)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, **options: object) -> Graph:
        """Node and edge rows (with seq) merged by key; edges with an unknown end are dropped after that."""
        shell = cls(nodes, edges, **options)  # type: ignore[arg-type]
        return replace(shell, nodes=cut_lineage(shell._merge_nodes(nodes)), edges=shell._merge_edges(edges)).prune()

    def _merge_nodes(self, rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("_key", key_template(self.node_key)).filter("trim(_key) <> ''")
        return keyed_merge(keyed, ["_key"], ["seq"], self.strategy)

    def _merge_edges(self, rows: DataFrame) -> DataFrame:
        raw = F.array_join(F.array_sort("members"), "_") if self.hyper and self.edge_key == "members" else key_template(self.edge_key)
        key = edge_key(raw, F.col(self.time) if self.time else None, F.col(self.place) if self.place else None)
        return keyed_merge(rows.withColumn("_key", key), ["_key"], ["seq"], self.strategy)

    def prune(self) -> Graph:
        """Without edges that name an unknown node."""
        if self.hyper:
            kept = graphs.prune_hyperedges(self.edges, self.nodes, "_key", "_key", "members")
        else:
            kept = graphs.prune_edges(self.edges, self.nodes, "_key")
        return replace(self, edges=cut_lineage(kept), indexes=(None, None))

    def __add__(self, other: Graph) -> Graph:
        both = lambda a, b: a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
        nodes = keyed_merge(both(self.nodes, other.nodes), ["_key"], ["_side", "seq"], self.strategy).drop("_side")
        edges = keyed_merge(both(self.edges, other.edges), ["_key"], ["_side", "seq"], self.strategy).drop("_side")
        return replace(self, nodes=cut_lineage(nodes), edges=edges).prune()

    def feed(self, chunks: DataFrame, key: list[str], text: str, extractors: GraphExtractors, two_stage: bool = True, context: list[str] | None = None) -> Graph:
        """This graph with what the extractors find in more chunks."""
        nodes, edges = extract_graph(chunks, key, text, extractors, two_stage, context)
        # padded, so that text order is number order
        place = F.concat_ws("|", *[F.lpad(F.col(k).cast("string"), 20, "0") for k in key], F.lpad(F.col("item_no").cast("string"), 10, "0"))
        order = lambda rows: rows.filter("error is null").withColumn("seq", place).drop(*key, "item_no", "error")
        more = Graph.of(order(nodes), order(edges), node_key=self.node_key, edge_key=self.edge_key, time=self.time, place=self.place, strategy=self.strategy, hyper=self.hyper)
        return self + more

    def build_index(self, node_fields: list[str], edge_fields: list[str]) -> Graph:
        return replace(self, indexes=(_index(self.nodes, "_key", node_fields), _index(self.edges, "_key", edge_fields)))

    def search(self, query: str, nodes: int = 3, edges: int = 3) -> tuple[DataFrame, DataFrame]:
        """The nearest nodes and edges; a count of 0 asks for none of that side."""
        if nodes <= 0 and edges <= 0:
            raise ValueError("a search needs a positive count")
        a = _nearest(self.nodes, self.indexes[0], "_key", query, nodes) if nodes > 0 else self.nodes.limit(0)
        b = _nearest(self.edges, self.indexes[1], "_key", query, edges) if edges > 0 else self.edges.limit(0)
        return a, b

    def counts(self) -> dict[str, int]:
        return {"nodes": self.nodes.count(), "edges": self.edges.count(), "indexed": int(self.indexes[0] is not None)}


def graph_of_text(spark: SparkSession, chunks: DataFrame, key: list[str], text: str, extractors: GraphExtractors, **options: object) -> Graph:
    """A graph from chunks alone."""
    nodes = spark.createDataFrame([], "name string, type string, description string, seq string")
    edges = spark.createDataFrame([], "source string, target string, edge_type string, description string, seq string")
    return Graph.of(nodes, edges, **options).feed(chunks, key, text, extractors)
