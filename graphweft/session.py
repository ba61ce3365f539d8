"""A session: named graphs, queries as text, results as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.errors import QueryError
from graphweft.functions import library as L
from graphweft.lang.parser import Query, parse
from graphweft.operators import procedures
from graphweft.plans import updates
from graphweft.plans.needs import needs
from graphweft.plans.planner import Planner, Var
from graphweft.sources.graph import Graph, empty

DEFAULT = "default"


class GraphSession:
    """Graphs by name; ``run`` plans a query on the current one and keeps the graph that it leaves."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None):
        self.spark, self.graphs, self.current, self.functions = spark, {DEFAULT: graph or empty(spark)}, DEFAULT, {}

    @property
    def graph(self) -> Graph:
        return self.graphs[self.current]

    def register_function(self, name: str, build) -> None:
        """A scalar function: ``build`` gets (column, type) pairs and returns one."""
        self.functions[name.lower()] = build

    def run(self, text: str, params: dict | None = None) -> DataFrame:
        ddl = self._ddl(text.strip().rstrip(";").strip())
        if ddl is not None:
            return ddl
        query = parse(text)
        df, graph = self._plan(query, params or {})
        if query.explain:
            plan = df._jdf.queryExecution().toString()
            return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "Plan string")
        self.graphs[self.current] = graph
        return df

    def _plan(self, query: Query, params: dict) -> tuple[DataFrame, Graph]:
        out, graph = None, self.graph
        for single in query.singles:
            df, graph = self._single(single, graph, params)
            if out is not None and sorted(out.columns) != sorted(df.columns):
                raise QueryError("DifferentColumnsInUnion", f"{out.columns} and {df.columns}")
            out = df if out is None else out.unionByName(df)
        return (out if query.union_all or len(query.singles) == 1 else out.distinct()), graph

    def _single(self, clauses: tuple, graph: Graph, params: dict) -> tuple[DataFrame, Graph]:
        p = Planner(graph, params, needs(clauses), self.functions)
        last = clauses[-1]
        if last.kind in ("match", "unwind", "with"):
            raise QueryError("InvalidClauseComposition", f"a query can't end with {last.kind.upper()}")
        for c in clauses:
            if c.kind == "match":
                p.match(c)
            elif c.kind == "unwind":
                p.unwind(c)
            elif c.kind in ("with", "return"):
                p.project(c.projection, c.kind == "return")
            elif c.kind == "create":
                updates.create(p, c.parts)
            elif c.kind == "set":
                updates.set_items(p, c.items)
            elif c.kind == "remove":
                updates.remove_items(p, c.items)
            elif c.kind == "delete":
                updates.delete(p, c)
            elif c.kind == "merge":
                updates.merge(p, c)
            elif c.kind == "call":
                self._call(p, c, c is last)
        done = last.kind == "return" or last.kind == "call"
        return (p.rows.df if done else self.spark.range(0).select()), p.graph

    def _call(self, p: Planner, c, last: bool) -> None:
        found = procedures.call(c.name, p.graph, [k for k in self.graphs])
        wanted = [(x, x) for x in found.columns] if c.items is None or any(x == "*" for x, _ in c.items) else list(c.items)
        for column, _ in wanted:
            if column not in found.columns:
                raise QueryError("UndefinedVariable", column)
        made = {name: p.fresh("y") for _, name in wanted}
        frame = found.select(*(F.col(column).alias(made[name]) for column, name in wanted))
        p.rows.df = frame if p.rows.unit else p.rows.df.crossJoin(frame)  # a procedure's rows are catalogue entries
        p.rows.unit = False
        types = dict(found.dtypes)
        for column, name in wanted:
            t = {"string": "str", "bigint": "int", "boolean": "bool", "array<string>": ("list", "str")}[types[column]]
            p.rows.scope[name] = Var(made[name], t)
        if last:
            p.finish({name: p.rows.scope[name] for _, name in wanted})

    # commands on the catalogue
    def _ddl(self, text: str) -> DataFrame | None:
        rows = self.spark.createDataFrame
        if m := re.fullmatch(r"CREATE\s+(UNIQUE\s+)?INDEX\s+(\w+)\s+FOR\s+(?:\((\w+):(\w+)\)|\(\)-\[(\w+):(\w+)\]-\(\))\s+ON\s*\(([^)]*)\)", text, re.I):
            props = [x.strip().split(".")[-1] for x in m[7].split(",")]
            if any(i["name"] == m[2] for i in self.graph.indexes):
                raise QueryError("IndexAlreadyExists", m[2])
            index = {"name": m[2], "label": m[4] or m[6], "properties": props, "unique": bool(m[1]), "state": "PUBLIC"}
            tables = [t for t in self.graph.nodes if m[4] in t.labels] if m[4] else [t for t in self.graph.edges if t.type == m[6]]
            if m[1] and updates.duplicates([t.df.select(*props) for t in tables if set(props) <= {k for k, _ in t.props}], props):
                index["state"] = "ERROR"
            self._indexes((*self.graph.indexes, index))
            return self._show_indexes([index])
        if m := re.fullmatch(r"DROP\s+INDEX\s+(\w+)", text, re.I):
            kept = tuple(i for i in self.graph.indexes if i["name"] != m[1])
            if len(kept) == len(self.graph.indexes):
                raise QueryError("IndexNotFound", m[1])
            self._indexes(kept)
            return self._show_indexes(kept)
        if m := re.fullmatch(r"SHOW\s+INDEX(?:ES)?(?:\s+(\w+))?", text, re.I):
            return self._show_indexes([i for i in self.graph.indexes if not m[1] or i["name"] == m[1]])
        if m := re.fullmatch(r"CREATE\s+DATABASE\s+(\w+)(\s+IF\s+NOT\s+EXISTS)?", text, re.I):
            if m[1] in self.graphs and not m[2]:
                raise QueryError("DatabaseAlreadyExists", m[1])
            self.graphs.setdefault(m[1], empty(self.spark))
            return self._databases()
        if m := re.fullmatch(r"DROP\s+DATABASE\s+(\w+)(\s+IF\s+EXISTS)?", text, re.I):
            if m[1] == DEFAULT or m[1] not in self.graphs and not m[2]:
                raise QueryError("DatabaseNotFound", m[1])
            self.graphs.pop(m[1], None)
            self.current = self.current if self.current in self.graphs else DEFAULT
            return self._databases()
        if re.fullmatch(r"SHOW\s+DATABASES?(\s+\w+)?", text, re.I):
            return self._databases()
        if m := re.fullmatch(r"USE\s+(\w+)", text, re.I):
            if m[1] not in self.graphs:
                raise QueryError("DatabaseNotFound", m[1])
            self.current = m[1]
            return self._databases()
        if re.fullmatch(r"SHOW\s+PROCEDURES", text, re.I):
            return rows([(n,) for n in sorted(procedures.PROCEDURES)], "name string")
        if re.fullmatch(r"SHOW\s+FUNCTIONS", text, re.I):
            return rows([(n,) for n in sorted({*L.FUNCTIONS, *L.AGGREGATES, *self.functions})], "name string")
        if re.fullmatch(r"SHOW\s+CURRENT\s+USER", text, re.I):
            return rows([(self.spark.sparkContext.sparkUser(),)], "user string")
        if re.fullmatch(r"SHOW\s+VECTOR\s+INDEXES", text, re.I):
            return rows([], "name string")
        return None

    def _indexes(self, indexes: tuple) -> None:
        from dataclasses import replace

        self.graphs[self.current] = replace(self.graph, indexes=tuple(indexes))

    def _show_indexes(self, indexes) -> DataFrame:
        return self.spark.createDataFrame([(i["name"], i["label"], ",".join(i["properties"]), i["unique"], i["state"]) for i in indexes], "name string, label string, property string, unique boolean, state string")

    def _databases(self) -> DataFrame:
        return self.spark.createDataFrame([(n, n == self.current) for n in sorted(self.graphs)], "name string, current boolean")


