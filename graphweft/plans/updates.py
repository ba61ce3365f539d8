"""Updating clauses: each gives the rows that follow and a new graph; no table is changed in place."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.errors import QueryError
from graphweft.functions import library as L
from graphweft.lang.parser import Clause, NodePattern, Part
from graphweft.operators.scans import SEP
from graphweft.plans.planner import Planner, Rows, Var, cut, same
from graphweft.sources.graph import ID_BITS, EdgeTable, NodeTable


def _settle(p: Planner) -> None:
    """Fixes the rows, so that ids made from them stay the same wherever they are read again."""
    if p.rows.unit:
        p.rows.df, p.rows.unit = p.graph.spark.createDataFrame([(0,)], "_unit long"), False
    p.rows.df = cut(p.rows.df)
    p.graph = p.graph.without_held()


def _new_ids(p: Planner, kind: str) -> Column:
    name = f"+{sum(1 for k, _ in p.graph.ordinals if k == kind)}"
    p.graph = p.graph._known(kind, name)
    return F.lit(p.graph.ordinal(kind, name) << ID_BITS) + F.monotonically_increasing_id()


def _props(p: Planner, pattern) -> dict:
    if pattern.props is None:
        return {}
    if pattern.props[0] == "param":
        return {k: L.literal(v) for k, v in p.params[pattern.props[1]].items()}
    return {k: p.expr(e) for k, e in pattern.props[1]}


def _storable(name: str, t) -> None:
    if L.kind(t) in ("map", "node", "rel", "path") or L.kind(t) == "list" and L.kind(t[1]) in ("map", "node", "rel", "path", "list"):
        raise QueryError("InvalidPropertyType", name)


def create(p: Planner, parts: tuple[Part, ...]) -> None:
    _settle(p)
    for part in parts:
        for r in part.rels:
            if len(r.types) != 1:
                raise QueryError("NoSingleRelationshipType", str(r.types))
            if r.direction == "both":
                raise QueryError("RequiresDirectedRelationship", r.types[0])
            if r.hops:
                raise QueryError("CreatingVarLength", r.types[0])
            if r.var in p.rows.scope:
                raise QueryError("VariableAlreadyBound", r.var)
        for n in part.nodes:
            if n.var not in p.rows.scope:
                _create(p, n, "node", n.labels, {})
            elif n.labels or n.props or not part.rels:
                raise QueryError("VariableAlreadyBound", n.var)
        for k, r in enumerate(part.rels):
            a, b = part.nodes[k].var, part.nodes[k + 1].var
            src, dst = (a, b) if r.direction == "out" else (b, a)
            ends = {"_src": p.at(p.rows.scope[src], "_id"), "_dst": p.at(p.rows.scope[dst], "_id")}
            _create(p, r, "rel", r.types, ends)
        if part.var:
            pieces = {k: ("one", r.var) for k, r in enumerate(part.rels)}
            p.rows.scope[part.var] = p.add(p._path(part, pieces, 0), "p")


def _create(p: Planner, pattern, kind: str, names: tuple, ends: dict) -> None:
    props = {k: v for k, v in _props(p, pattern).items() if v[1] != "null"}
    for k, (_, t) in props.items():
        _storable(k, t)
    prefix = p.fresh("n")
    columns = {f"{prefix}{SEP}_id": _new_ids(p, "node" if kind == "node" else "edge"), **{f"{prefix}{SEP}{k}": c for k, c in ends.items()}, **{f"{prefix}{SEP}{k}": c for k, (c, _) in props.items()}}
    if kind == "node":
        columns[f"{prefix}{SEP}_labels"] = F.array(*(F.lit(x) for x in sorted(set(names)))).cast("array<string>")
    else:
        columns[f"{prefix}{SEP}_type"] = F.lit(names[0])
    p.rows.df = cut(p.rows.df.withColumns(columns))
    types = tuple((k, t) for k, (_, t) in props.items())
    own = p.rows.df.where(F.col(f"{prefix}{SEP}_id").isNotNull()).select(*(F.col(f"`{prefix}{SEP}{k}`").alias(k) for k in ("_id", *ends, *props)))
    if kind == "node":
        p.graph = replace(p.graph, nodes=(*p.graph.nodes, NodeTable(frozenset(names), own, types)))
        _check_unique(p, names)
    else:
        p.graph = replace(p.graph, edges=(*p.graph.edges, EdgeTable(names[0], own, types, None, None)))
    p.rows.scope[pattern.var] = Var(prefix, (kind, types), True, (frozenset(names),) if kind == "node" else None)


def _check_unique(p: Planner, names) -> None:
    for index in p.graph.indexes:
        if index["unique"] and index["label"] in names:
            tables = [t.df.select(*(F.col(c) if c in t.df.columns else F.lit(None).cast("string").alias(c) for c in index["properties"])) for t in p.graph.nodes if index["label"] in t.labels]
            if duplicates(tables, index["properties"]):
                raise QueryError("ConstraintViolation", index["name"])


def duplicates(tables: list[DataFrame], properties) -> bool:
    """Whether some combination of non-null values stands twice."""
    every = None
    for t in tables:
        t = t.select(*(F.col(c).cast("string").alias(c) for c in properties)).dropna()
        every = t if every is None else every.union(t)
    return every is not None and bool(every.groupBy(*properties).count().where("count > 1").take(1))


def _with_value(df: DataFrame, props: tuple, updates: DataFrame, name: str, t) -> tuple[DataFrame, tuple]:
    """``df`` with property ``name`` as ``updates`` (_u, _v) has it for the ids there."""
    own = dict(props)
    joined = df.join(updates, df["_id"] == updates["_u"], "left")
    if name in own:
        m = L.merge_types(own[name], t)
        value = F.when(F.col("_u").isNotNull(), L.cast_to((F.col("_v"), t), m)).otherwise(L.cast_to((F.col(f"`{name}`"), own[name]), m))
        own[name] = m
    else:
        own[name], value = t, F.col("_v")
    out = joined.select("_id", *(c for c in df.columns if c not in ("_id", name)), value.alias(name))
    return out, tuple(own.items())


def _set_property(p: Planner, var: str, name: str, value) -> None:
    target = p.rows.scope.get(var)
    if target is None:
        raise QueryError("UndefinedVariable", var)
    if not target.flat:
        p._flatten(var)
        target = p.rows.scope[var]
    c, t = value
    own = dict(target.type[1])
    if t == "null":
        if name not in own and not any(name == k for x in (*p.graph.nodes, *p.graph.edges) for k, _ in x.props):
            return
        t = own.get(name, "str")
        c = F.lit(None).cast(L.sql_type(t))
    _storable(name, t)
    column = f"{target.column}{SEP}{name}"
    p.rows.df = cut(p.rows.df.withColumn(column, c))
    p.rows.scope[var] = replace(target, type=(target.type[0], tuple({**own, name: t}.items())))
    updates = cut(p.rows.df.where(p.at(target, "_id").isNotNull()).groupBy(p.at(target, "_id").alias("_u")).agg(F.last(F.col(f"`{column}`")).alias("_v")))
    if target.type[0] == "node":
        p.graph = replace(p.graph, nodes=tuple(replace(x, df=d, props=q) for x in p.graph.nodes for d, q in [_with_value(x.df, x.props, updates, name, t) if not target.kinds or x.labels in target.kinds else (x.df, x.props)]))
        _check_unique(p, p.graph.labels())
    else:
        p.graph = replace(p.graph, edges=tuple(replace(x, df=d, props=q) for x in p.graph.edges for d, q in [_with_value(x.df, x.props, updates, name, t)]))


def _set_labels(p: Planner, var: str, labels: tuple, add: bool) -> None:
    target = p.rows.scope[var]
    if target.type[0] != "node":
        return
    ids = cut(p.rows.df.where(p.at(target, "_id").isNotNull()).select(p.at(target, "_id").alias("_u")).distinct())
    tables, moved = [], set()
    for x in p.graph.nodes:
        to = x.labels | set(labels) if add else x.labels - set(labels)
        if to == x.labels:
            tables.append(x)
            continue
        moved.add(x.labels)
        tables.append(replace(x, df=x.df.join(ids, x.df["_id"] == ids["_u"], "left_anti")))
        tables.append(replace(x, labels=frozenset(to), df=x.df.join(ids, x.df["_id"] == ids["_u"], "left_semi")))
    # an end of which some nodes have other labels now is of no one kind
    p.graph = replace(p.graph, nodes=tuple(tables), edges=tuple(replace(e, src=None if e.src in moved else e.src, dst=None if e.dst in moved else e.dst) for e in p.graph.edges))
    held = p.at(target, "_labels")
    extra = F.array(*(F.lit(v) for v in labels))
    p.rows.df = p.rows.df.withColumn(f"{target.column}{SEP}_labels", F.array_sort(F.array_union(held, extra) if add else F.array_except(held, extra)))
    p.rows.scope[var] = replace(target, kinds=None)


def set_items(p: Planner, items: tuple) -> None:
    _settle(p)
    for item in items:
        kind, var = item[0], item[1]
        if var not in p.rows.scope:
            raise QueryError("UndefinedVariable", var)
        if kind == "prop":
            if item[4] is not None and item[4] not in p.graph.labels():
                raise QueryError("LabelNotFound", item[4])
            _set_property(p, var, item[2], p.expr(item[3]))
        elif kind == "labels":
            _set_labels(p, var, item[2], True)
        else:
            c, t = p.expr(item[2])
            if L.kind(t) not in ("map", "node", "rel"):
                raise QueryError("InvalidArgumentType", "SET needs a map")
            given = {k: (c[k], v) for k, v in t[1]}
            if kind == "replace":
                target = p.rows.scope[var]
                known = {k for k, _ in target.type[1]} | {k for x in (p.graph.nodes if target.type[0] == "node" else p.graph.edges) if not target.kinds or getattr(x, "labels", None) in target.kinds for k, _ in x.props}
                for k in known - set(given):
                    _set_property(p, var, k, (F.lit(None), "null"))
            for k, v in given.items():
                _set_property(p, var, k, v)


def remove_items(p: Planner, items: tuple) -> None:
    _settle(p)
    for item in items:
        if item[1] not in p.rows.scope:
            raise QueryError("UndefinedVariable", item[1])
        if item[0] == "prop":
            _set_property(p, item[1], item[2], (F.lit(None), "null"))
        else:
            _set_labels(p, item[1], item[2], False)


def delete(p: Planner, clause: Clause) -> None:
    _settle(p)
    node_ids, edge_ids = [], []

    def collect(c, t):
        k = L.kind(t)
        if k in ("node", "rel"):
            (node_ids if k == "node" else edge_ids).append(p.rows.df.select(c["_id"].alias("_u")))
        elif k == "path":
            node_ids.append(p.rows.df.select(F.explode(c["nodes"]["_id"]).alias("_u")))
            edge_ids.append(p.rows.df.select(F.explode(c["rels"]["_id"]).alias("_u")))
        elif k == "list" and L.kind(t[1]) in ("node", "rel"):
            (node_ids if t[1][0] == "node" else edge_ids).append(p.rows.df.select(F.explode(c["_id"]).alias("_u")))
        elif t != "null":
            raise QueryError("InvalidArgumentType", "DELETE needs nodes, relationships or paths")

    for e in clause.items:
        var = p.rows.scope.get(e[1]) if e[0] == "var" else None
        if var is not None and var.flat:
            (node_ids if var.type[0] == "node" else edge_ids).append(p.rows.df.select(p.at(var, "_id").alias("_u")))
        else:
            collect(*p.expr(e))

    def ids(frames):
        out = None
        for f in frames:
            out = f if out is None else out.union(f)
        return cut(out.dropna().distinct()) if out is not None else None

    edges, nodes = ids(edge_ids), ids(node_ids)
    tables = p.graph.edges
    if edges is not None:
        tables = tuple(replace(x, df=x.df.join(edges, x.df["_id"] == edges["_u"], "left_anti")) for x in tables)
    if nodes is not None:
        if clause.detach:
            tables = tuple(replace(x, df=x.df.join(nodes, x.df["_src"] == nodes["_u"], "left_anti").join(nodes, F.col("_dst") == nodes["_u"], "left_anti")) for x in tables)
        else:
            for x in tables:
                ends = x.df.select(F.explode(F.array("_src", "_dst")).alias("_end"))
                if ends.join(nodes, ends["_end"] == nodes["_u"], "left_semi").take(1):
                    raise QueryError("DeleteConnectedNode", x.type)
        p.graph = replace(p.graph, nodes=tuple(replace(x, df=x.df.join(nodes, x.df["_id"] == nodes["_u"], "left_anti")) for x in p.graph.nodes))
    p.graph = replace(p.graph, edges=tables)


def merge(p: Planner, clause: Clause) -> None:
    """Matches the pattern, or creates it once for each distinct combination of what it is made from.

    Sets in ON CREATE and ON MATCH run on the rows that made or met the pattern, from their values before the clause.
    """
    part = clause.parts[0]
    _settle(p)
    for x in (*part.nodes, *part.rels):
        if x.props and x.props[0] == "map" and any(e == ("lit", None) for _, e in x.props[1]):
            raise QueryError("MergeReadOwnWrites", "null property")
    if any(r.var in p.rows.scope for r in part.rels) or not part.rels and part.nodes[0].var in p.rows.scope:
        raise QueryError("VariableAlreadyBound", "MERGE")
    old = dict(p.rows.scope)
    # what the pattern reads from the rows
    keys: list[tuple[str, object]] = []
    def literal_props(x):
        if x.props is None:
            return x
        made = []
        for k, (c, t) in _props(p, x).items():
            var = p.add((c, t), "m")
            name = f"__anon_m{var.column}"
            p.rows.scope[name] = var
            keys.append((var.column, t))
            made.append((k, ("var", name)))
        return replace(x, props=("map", tuple(made)))

    part = replace(part, nodes=tuple(literal_props(n) for n in part.nodes), rels=tuple(literal_props(r) for r in part.rels))
    p.rows.df = cut(p.rows.df)
    row = p.fresh("row")
    p.rows.df = cut(p.rows.df.withColumn(row, F.monotonically_increasing_id()))
    before, scope = p.rows.df, dict(p.rows.scope)
    p.match(Clause("match", (part,)))
    met, met_scope = cut(p.rows.df), dict(p.rows.scope)
    if not part.rels:  # one node: a row each
        met = met.dropDuplicates([row])
    missing = cut(before.join(met.select(F.col(row).alias("_r")).distinct(), F.col(row) == F.col("_r"), "left_anti"))
    bound = [n.var for n in part.nodes if n.var in old]
    columns = [f"{scope[v].column}{SEP}_id" for v in bound] + [c for c, _ in keys]
    made_scope, made = dict(met_scope), None
    if missing.take(1):
        p.rows.df, p.rows.scope = (missing.dropDuplicates(columns) if columns else missing.limit(1)), dict(scope)
        directed = replace(part, rels=tuple(replace(r, direction="out") if r.direction == "both" else r for r in part.rels), nodes=tuple(NodePattern(n.var) if n.var in scope else n for n in part.nodes))
        create(p, (directed,))
        new = {v: x for v, x in p.rows.scope.items() if v not in scope}
        made_scope = {**scope, **new}
        fresh = p.rows.df.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(columns)), *(F.col(f"`{c}`") for v in new.values() for c in p._columns(v)))
        on = F.lit(True)
        for i, c in enumerate(columns):
            on = on & same(F.col(f"`{c}`"), F.col(f"_k{i}"))
        made = cut(missing.join(fresh, on).drop(*(f"_k{i}" for i in range(len(columns)))))
    # both kinds of rows under one set of columns
    for rows, own, items in ((met, met_scope, clause.on_match), (made, made_scope, clause.on_create)):
        if rows is not None and items:
            p.rows = Rows(rows, dict(own))
            set_items(p, tuple(items))
            if rows is met:
                met, met_scope = p.rows.df, dict(p.rows.scope)
            else:
                made, made_scope = p.rows.df, dict(p.rows.scope)
    out_scope = {}
    frames = [(met, met_scope)] + ([(made, made_scope)] if made is not None else [])
    names = [v for v in met_scope if not v.startswith("__anon_m")]
    for v in names:
        if v in old and not any(v == i[1] for i in (*clause.on_match, *clause.on_create)):
            out_scope[v] = old[v]
            continue
        if not met_scope[v].flat:
            out_scope[v] = met_scope[v]
            continue
        prefix, types = p.fresh("n"), {}
        for _, s in frames:
            for k, t in s[v].type[1]:
                types[k] = L.merge_types(types.get(k, t), t)
        hidden = ("_id", "_labels") if met_scope[v].type[0] == "node" else ("_id", "_src", "_dst", "_type")
        frames = [
            (f.withColumns({**{f"{prefix}{SEP}{h}": F.col(f"`{s[v].column}{SEP}{h}`") for h in hidden}, **{f"{prefix}{SEP}{k}": (L.cast_to((F.col(f"`{s[v].column}{SEP}{k}`"), dict(s[v].type[1])[k]), t) if k in dict(s[v].type[1]) else F.lit(None).cast(L.sql_type(t))) for k, t in types.items()}}), s)
            for f, s in frames
        ]
        out_scope[v] = Var(prefix, (met_scope[v].type[0], tuple(types.items())), True)
    p.rows = Rows(frames[0][0], out_scope)
    keep = [c for v in out_scope.values() for c in p._columns(v)]
    df = frames[0][0].select(*(F.col(f"`{c}`") for c in keep), F.lit(0).alias("_unit"))
    for f, _ in frames[1:]:
        df = df.union(f.select(*(F.col(f"`{c}`") for c in keep), F.lit(0).alias("_unit")))
    p.rows.df = cut(df)

