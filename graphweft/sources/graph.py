"""Property graphs as immutable sets of DataFrames.

A node table holds the nodes of exactly one set of labels, an edge table those of one type between two
such sets. Ids are 64-bit: the label's ordinal above 48 bits of key, so they are stable, unique over tables and plain
expressions that Catalyst sees through. Updates give a new graph.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_BITS = 48


def type_of(t: T.DataType):
    """The query language's type of a Spark type."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "localdatetime"
    if isinstance(t, T.ArrayType):
        return ("list", type_of(t.elementType))
    if isinstance(t, T.StructType):
        names = tuple(t.names)
        if names == ("months", "days", "seconds", "nanos"):
            return "duration"
        if names in (("utc", "offset", "zone"), ("utc", "offset"), ("nanos",)):
            return {3: "datetime", 2: "time", 1: "localtime"}[len(names)]
        return ("map", tuple((f.name, type_of(f.dataType)) for f in t.fields))
    return "str"


def stored(column, t: T.DataType):
    """A column in the one width that its type has in queries."""
    kind = type_of(t)
    if kind == "int":
        return column.cast("bigint")
    if kind == "float":
        return column.cast("double")
    if isinstance(t, T.TimestampType):
        return column.cast("timestamp_ntz")
    return column


@dataclass(frozen=True)
class NodeTable:
    labels: frozenset
    df: DataFrame  # _id and one column for each property
    props: tuple  # (name, type)


@dataclass(frozen=True)
class EdgeTable:
    type: str
    df: DataFrame  # _id, _src, _dst and one column for each property
    props: tuple
    src: frozenset | None  # labels of either end; None: any
    dst: frozenset | None
    holds: str | None = None  # "_src" or "_dst": each row is also the whole node at that end, its properties named @name
    held: tuple = ()  # that node's (name, type)


def _props(df: DataFrame, hidden: tuple[str, ...]) -> tuple:
    return tuple((f.name, type_of(f.dataType)) for f in df.schema.fields if f.name not in hidden)


@dataclass(frozen=True)
class Graph:
    """Nodes, edges, index metadata and the ordinals that ids are made of."""

    spark: SparkSession
    nodes: tuple = ()
    edges: tuple = ()
    indexes: tuple = ()
    ordinals: tuple = ()

    def ordinal(self, kind: str, name: str) -> int:
        return self.ordinals.index((kind, name)) + 1

    def _known(self, kind: str, name: str) -> Graph:
        return self if (kind, name) in self.ordinals else replace(self, ordinals=(*self.ordinals, (kind, name)))

    def add_nodes(self, label: str, df: DataFrame, key: str, columns: dict[str, str] | None = None) -> Graph:
        """With the rows of ``df`` as nodes of ``label``; ``key`` is a whole-number column; all columns become properties."""
        g = self._known("node", label)
        names = columns or {c: c for c in df.columns}
        made = df.select((F.lit(g.ordinal("node", label) << ID_BITS) + F.col(key)).cast("bigint").alias("_id"), *(stored(F.col(c), df.schema[c].dataType).alias(n) for c, n in names.items()))
        return replace(g, nodes=(*g.nodes, NodeTable(frozenset([label]), made, _props(made, ("_id",)))))

    def add_edges(self, type_: str, df: DataFrame, src: tuple[str, str], dst: tuple[str, str], props: tuple[str, ...] = (), key: str | None = None, holds: str | None = None) -> Graph:
        """With the rows of ``df`` as edges; ``src`` and ``dst`` are (label, key column). Without ``key``, ids are hashes of the whole row.

        ``holds`` ("_src" or "_dst") says that ``df`` is the very table of that end's nodes (a foreign key in it is the edge), so a
        walk to that end needs no join with its nodes.
        """
        g = self._known("node", src[0])._known("node", dst[0])._known("edge", type_)
        at = sum(1 for e in g.edges if e.type == type_)
        ends = {"_src": src, "_dst": dst}
        owner = next((t for t in g.nodes for e in (holds,) if e and t.labels == frozenset([ends[e][0]])), None)
        whole = [c for c in df.columns if c in {n for n, _ in owner.props}] if owner else []
        low = F.col(key).cast("bigint") if key else F.xxhash64(*df.columns).bitwiseAND((1 << ID_BITS - 4) - 1)
        made = df.select(
            (F.lit((g.ordinal("edge", type_) << ID_BITS) + (at << ID_BITS - 4)) + low).alias("_id"),
            (F.lit(g.ordinal("node", src[0]) << ID_BITS) + F.col(src[1])).cast("bigint").alias("_src"),
            (F.lit(g.ordinal("node", dst[0]) << ID_BITS) + F.col(dst[1])).cast("bigint").alias("_dst"),
            *(stored(F.col(c), df.schema[c].dataType).alias(c) for c in props),
            *(stored(F.col(c), df.schema[c].dataType).alias(f"@{c}") for c in whole),
        )
        edge = EdgeTable(type_, made, tuple(p for p in _props(made, ("_id", "_src", "_dst")) if p[0][0] != "@"), frozenset([src[0]]), frozenset([dst[0]]))
        if owner and len(whole) == len(owner.props):
            edge = replace(edge, holds=holds, held=owner.props)
        return replace(g, edges=(*g.edges, edge))

    def without_held(self) -> Graph:
        """Where nodes or edges are about to change, rows that are both no longer stand for each other."""
        return replace(self, edges=tuple(replace(e, df=e.df.select("_id", "_src", "_dst", *(n for n, _ in e.props)), holds=None, held=()) if e.holds else e for e in self.edges))

    def labels(self) -> list[str]:
        return sorted({x for t in self.nodes for x in t.labels})

    def types(self) -> list[str]:
        return sorted({t.type for t in self.edges})


def empty(spark: SparkSession) -> Graph:
    return Graph(spark)
