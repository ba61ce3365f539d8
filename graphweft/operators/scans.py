"""Scans of nodes and edges, with only the columns that a query reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.library import cast_to, merge_types, sql_type
from graphweft.sources.graph import Graph

SEP = "$"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def property_types(tables, wanted) -> dict:
    """Types of the wanted properties (all, if None) over tables; where tables disagree, the type that holds both."""
    out: dict = {}
    for t in tables:
        for name, kind in t.props:
            if wanted is None or name in wanted:
                out[name] = merge_types(out[name], kind) if name in out else kind
    return out


def _columns(table, types: dict, prefix: str) -> list:
    own = dict(table.props)
    return [(cast_to((F.col(f"`{n}`"), own[n]), t) if n in own and own[n] != t else F.col(f"`{n}`") if n in own else F.lit(None).cast(sql_type(t))).alias(f"{prefix}{SEP}{n}") for n, t in types.items()]


def nodes(graph: Graph, labels, prefix: str, wanted, kinds=None) -> tuple[DataFrame, dict, list]:
    """Nodes that have all ``labels`` (an intersection; an unknown label gives no rows), among ``kinds`` of label sets if given.

    Returns the frame, the properties' types and the label sets that it can hold.
    """
    tables = [t for t in graph.nodes if set(labels) <= t.labels and (kinds is None or t.labels in kinds)]
    types = property_types(tables, wanted)
    if not tables:
        none = graph.spark.range(0).select(F.col("id").alias(f"{prefix}{SEP}_id"), F.array().cast("array<string>").alias(f"{prefix}{SEP}_labels"))
        return none, {}, []
    made = [t.df.select(F.col("_id").alias(f"{prefix}{SEP}_id"), F.array(*(F.lit(x) for x in sorted(t.labels))).cast("array<string>").alias(f"{prefix}{SEP}_labels"), *_columns(t, types, prefix)) for t in tables]
    return _union(made), types, list(dict.fromkeys(t.labels for t in tables))


def _fitting(graph: Graph, types, direction: str, near, far_labels, near_labels) -> list[tuple]:
    """Edge tables that a step can use, each with whether it is walked backwards and the label sets of its near and far ends."""
    found = []
    for t in graph.edges:
        if types and t.type not in types:
            continue
        for flip in {"out": (False,), "in": (True,), "both": (False, True)}[direction]:
            a, b = (t.dst, t.src) if flip else (t.src, t.dst)
            if (near is None or a is None or a in near) and (a is None or set(near_labels) <= a) and (b is None or set(far_labels) <= b):
                found.append((t, flip, a, b))
    return found


def holding(graph: Graph, types, direction: str, near, far_labels=(), near_labels=()):
    """The one edge table that a step can use and the label set of its far end, if its rows hold the far nodes whole; else None."""
    found = _fitting(graph, types, direction, near, far_labels, near_labels)
    if len(found) == 1 and found[0][0].holds == ("_src" if found[0][1] else "_dst"):
        return found[0][0], found[0][3]
    return None


def known(graph: Graph, ends) -> bool:
    """Whether the label sets of a step's ends are known and have nodes, so that the edges alone can stand for nodes of which only the identity is read."""
    return bool(ends) and set(ends) <= {t.labels for t in graph.nodes}


def ends(graph: Graph, types, direction: str, near, far_labels=(), near_labels=()) -> tuple[list, list]:
    """The label sets that a step's near and far ends can have (None: unknown)."""
    found = _fitting(graph, types, direction, near, far_labels, near_labels)
    return list(dict.fromkeys(a for _, _, a, _ in found)), list(dict.fromkeys(b for _, _, _, b in found))


def edges(graph: Graph, types, direction: str, prefix: str, wanted, near=None, far=(), near_labels=(), held=(), labelled=()) -> tuple[DataFrame, dict, list]:
    """Edges of any of ``types`` with ends _a (near) and _b (far) as walked; an undirected walk sees a loop once.

    ``near``: label sets that the near end can have; ``far``: labels that the far end needs. Tables that can't fit are left out.
    ``held``: properties of the far nodes to bring along, where ``holding`` says that they are there.
    ``labelled``: ends ("_a", "_b") of which the label sets come along as columns @_a and @_b.
    Returns the frame, the properties' types and the far ends' label sets (None: unknown).
    """
    kinds = property_types([t for t in graph.edges if not types or t.type in types], wanted)
    made, ends = [], []
    for t, flip, near_kind, far_kind in _fitting(graph, types, direction, near, far, near_labels):
        ends.append(far_kind)
        part = t.df.where("_src <> _dst") if direction == "both" and flip else t.df
        a, b = ("_dst", "_src") if flip else ("_src", "_dst")
        own = {"_a": near_kind, "_b": far_kind}
        made.append(part.select(*(F.col(c).alias(f"{prefix}{SEP}{n}") for c, n in (("_id", "_id"), ("_src", "_src"), ("_dst", "_dst"), (a, "_a"), (b, "_b"))), F.lit(t.type).alias(f"{prefix}{SEP}_type"), *_columns(t, kinds, prefix), *(F.col(f"`@{n}`").alias(f"{prefix}{SEP}@{n}") for n in held), *(F.array(*(F.lit(x) for x in sorted(own[e]))).cast("array<string>").alias(f"{prefix}{SEP}@{e}") for e in labelled)))
    if not made:
        id_ = F.col("id")
        return graph.spark.range(0).select(*(id_.alias(f"{prefix}{SEP}{n}") for n in ("_id", "_src", "_dst", "_a", "_b")), F.lit("").alias(f"{prefix}{SEP}_type")), {}, []
    return _union(made), kinds, list(dict.fromkeys(ends))
