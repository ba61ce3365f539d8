"""Procedures on the catalogue: small tables made from a graph's metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphweft.errors import QueryError
from graphweft.sources.graph import Graph


def _kind(t) -> str:
    return t if isinstance(t, str) else f"list of {t[1]}"


def _node_properties(g: Graph):
    seen = {}
    for t in g.nodes:
        for name, kind in t.props:
            seen.setdefault((":" + ":".join(sorted(t.labels)), name), _kind(kind))
    return [(a, sorted(a[1:].split(":")), b, [k], False) for (a, b), k in sorted(seen.items())]


def _edge_properties(g: Graph):
    seen = {}
    for t in g.edges:
        for name, kind in t.props:
            seen.setdefault((f":`{t.type}`", name), _kind(kind))
    return [(a, b, [k], False) for (a, b), k in sorted(seen.items())]


def _indexes(g: Graph):
    return [(i["name"], i["state"], i["unique"], [i["label"]], list(i["properties"])) for i in g.indexes]


#: name -> (schema, rows of a graph)
PROCEDURES = {
    "db.ping": ("success boolean", lambda g: [(True,)]),
    "db.labels": ("label string", lambda g: [(x,) for x in g.labels()]),
    "db.relationshipTypes": ("relationshipType string", lambda g: [(x,) for x in g.types()]),
    "db.propertyKeys": ("propertyKey string", lambda g: [(x,) for x in sorted({n for t in (*g.nodes, *g.edges) for n, _ in t.props})]),
    "db.indexes": ("name string, state string, unique boolean, labels array<string>, properties array<string>", _indexes),
    "db.schema.nodeTypeProperties": ("nodeType string, nodeLabels array<string>, propertyName string, propertyTypes array<string>, mandatory boolean", _node_properties),
    "db.schema.relTypeProperties": ("relType string, propertyName string, propertyTypes array<string>, mandatory boolean", _edge_properties),
    "db.schema.visualization": ("nodes array<string>, relationships array<string>", lambda g: [(g.labels(), g.types())]),
    "dbms.components": ("name string, versions array<string>, edition string", lambda g: [("graphweft", ["0.1.0"], "spark")]),
    "dbms.info": ("id string, name string, creationDate string", lambda g: [("graphweft", "graphweft", "")]),
    "dbms.clientConfig": ("name string, value string", lambda g: []),
    "dbms.procedures": ("name string", lambda g: [(n,) for n in sorted(PROCEDURES)]),
    "dbms.functions": ("name string", lambda g: [(n,) for n in _functions()]),
}


def _functions():
    from graphweft.functions.library import AGGREGATES, FUNCTIONS

    return sorted({*FUNCTIONS, *AGGREGATES})


def call(name: str, graph: Graph, graphs: list[str]) -> DataFrame:
    found = {k.lower(): v for k, v in PROCEDURES.items()}.get(name.lower())
    if found is None:
        raise QueryError("ProcedureNotFound", name)
    return graph.spark.createDataFrame(found[1](graph), found[0])
