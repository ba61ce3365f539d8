"""Clauses to DataFrames: each clause takes the rows so far and gives new ones.

A bound node or relationship is a set of flat columns ``prefix$field``, so that Catalyst prunes what isn't read; it becomes a
struct only where it leaves as a whole. Optional, existential and comprehended patterns are decorrelated: they run once over
the distinct values of what they read from outside and are joined back.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.errors import QueryError
from graphweft.functions import library as L
from graphweft.functions import temporal
from graphweft.lang.parser import Clause, NodePattern, Part, Projection, RelPattern
from graphweft.operators import scans
from graphweft.operators.scans import SEP
from graphweft.plans.needs import ALL, needs
from graphweft.sources.graph import Graph

#: Hops after which an unbounded walk gives up, and hops between two cuts of its lineage.
MOST_HOPS, CUT_EVERY = 1000, 4


@dataclass(frozen=True)
class Var:
    """What a name stands for: flat columns of an entity (``flat``) or one column."""

    column: str
    type: object
    flat: bool = False
    kinds: tuple | None = None  # label sets that a node can have; types of a relationship


@dataclass
class Rows:
    df: DataFrame
    scope: dict[str, Var] = field(default_factory=dict)
    unit: bool = False  # the one empty row that a query starts from


def cut(df: DataFrame) -> DataFrame:
    """Rows computed once, kept in the shared checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise QueryError("NoSharedFolder", "spark.checkpoint.dir isn't set")
            import tempfile

            folder = tempfile.mkdtemp(prefix="graphweft-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


class Planner:
    def __init__(self, graph: Graph, params: dict | None = None, wanted: dict | None = None, functions: dict | None = None):
        self.graph, self.params, self.wanted, self.functions = graph, params or {}, wanted or {}, functions or {}
        self.names = [0]
        self.rows = Rows(graph.spark.range(1).select(), {}, True)
        self.lambdas: list[dict] = []
        self.virtual: str | None = None  # a node bound outside whose rows are the edges of the one step from it

    # names and values
    def fresh(self, base: str = "c") -> str:
        self.names[0] += 1
        return f"_{base}{self.names[0]}"

    def wants(self, name: str):
        """Properties to scan for a variable; None for all."""
        if ALL in self.wanted.get(name, ()) or (ALL in self.wanted and not name.startswith("__anon")):
            return None
        return {p for p in self.wanted.get(name, ()) if p != "_"}

    def value(self, name: str) -> tuple[Column, object]:
        for scope in reversed(self.lambdas):
            if name in scope:
                return scope[name]
        var = self.rows.scope.get(name)
        if var is None:
            raise QueryError("UndefinedVariable", name)
        if not var.flat:
            return F.col(f"`{var.column}`"), var.type
        hidden = ("_id", "_labels") if var.type[0] == "node" else ("_id", "_src", "_dst", "_type")
        made = F.struct(*(self.at(var, h).alias(h) for h in hidden), *(self.at(var, p).alias(p) for p, _ in var.type[1]))
        return F.when(self.at(var, "_id").isNotNull(), made), var.type

    @staticmethod
    def at(var: Var, name: str) -> Column:
        return F.col(f"`{var.column}{SEP}{name}`")

    def add(self, value: tuple[Column, object], base: str = "c") -> Var:
        column = self.fresh(base)
        c, t = value
        self.rows.df = self.rows.df.withColumn(column, c.cast("string") if t == "null" else c)
        return Var(column, t)

    # expressions
    def expr(self, e: tuple) -> tuple[Column, object]:
        return getattr(self, f"_{e[0]}")(*e[1:])

    def boolean(self, e: tuple) -> Column:
        c, t = self.expr(e)
        if t == "null":
            return F.lit(None).cast("boolean")
        if t not in ("bool", "any"):
            raise QueryError("InvalidArgumentType", f"a condition, not {L.kind(t)}")
        return L.of_kind((c, t), "bool")

    def _lit(self, v):
        return L.literal(v)

    def _param(self, name):
        if name not in self.params:
            raise QueryError("MissingParameter", name)
        return L.literal(self.params[name])

    def _var(self, name):
        return self.value(name)

    def _column(self, column, t):
        return F.col(f"`{column}`"), t

    def _and(self, a, b):
        return self.boolean(a) & self.boolean(b), "bool"

    def _or(self, a, b):
        return self.boolean(a) | self.boolean(b), "bool"

    def _xor(self, a, b):
        return self.boolean(a) != self.boolean(b), "bool"

    def _not(self, a):
        return ~self.boolean(a), "bool"

    def _cmp(self, op, a, b):
        return L.compare(op, self.expr(a), self.expr(b))

    def _bin(self, op, a, b):
        return L.arithmetic(op, self.expr(a), self.expr(b))

    def _neg(self, a):
        c, t = self.expr(a)
        if t == "duration":
            return L.arithmetic("*", (c, t), L.literal(-1))
        return -c, t

    def _starts(self, a, b):
        return self._match_text(a, b, Column.startswith)

    def _ends(self, a, b):
        return self._match_text(a, b, Column.endswith)

    def _contains(self, a, b):
        return self._match_text(a, b, Column.contains)

    def _match_text(self, a, b, test):
        (x, s), (y, t) = self.expr(a), self.expr(b)
        if s not in ("str", "any") or t not in ("str", "any"):
            return F.lit(None).cast("boolean"), "bool"
        return test(L.of_kind((x, s), "str"), L.of_kind((y, t), "str")), "bool"

    def _in(self, a, b):
        return L.in_list(self.expr(a), self.expr(b))

    def _isnull(self, a):
        return self._present(a).isNull(), "bool"

    def _notnull(self, a):
        return self._present(a).isNotNull(), "bool"

    def _present(self, a) -> Column:
        var = self.rows.scope.get(a[1]) if a[0] == "var" and not any(a[1] in s for s in self.lambdas) else None
        return self.at(var, "_id") if var is not None and var.flat else self.expr(a)[0]

    def _prop(self, a, name):
        if a[0] == "call" and a[1] in ("startnode", "endnode") and len(a[2]) == 1:
            return self.field(self._end(a[1], a[2], {name}), name)
        if a[0] == "var" and not any(a[1] in s for s in self.lambdas):
            var = self.rows.scope.get(a[1])
            if var is not None and var.flat:
                types = dict(var.type[1])
                return (self.at(var, name), types[name]) if name in types else (F.lit(None), "null")
        return self.field(self.expr(a), name)

    def field(self, value, name):
        c, t = value
        if L.kind(t) in ("node", "rel", "map"):
            types = dict(t[1])
            return (c[name], types[name]) if name in types else (F.lit(None), "null")
        if t in (*temporal.KINDS, "duration"):
            return temporal.accessor(value, name)
        if t in ("null", "any"):
            return F.lit(None), "null"
        raise QueryError("InvalidArgumentType", f"{L.kind(t)} has no properties")

    def _index(self, a, i):
        value = self.expr(a)
        if L.kind(value[1]) in ("node", "rel", "map"):
            if i[0] == "lit" and isinstance(i[1], str) or i[0] == "param":
                return self._prop(a, i[1] if i[0] == "lit" else self.params[i[1]])
            key, _ = self.expr(i)
            props = dict(value[1][1])
            t = "null"
            for k in props.values():
                t = L.merge_types(t, k)
            out = F.lit(None)
            for k, kind in props.items():
                out = F.when(key == k, L.cast_to((value[0][k], kind), t)).otherwise(out)
            return out, t
        return L.index(value, self.expr(i))

    def _slice(self, a, low, high):
        return L.cut_list(self.expr(a), self.expr(low) if low else None, self.expr(high) if high else None)

    def _list(self, items):
        return L.make_list([self.expr(i) for i in items])

    def _map(self, items):
        return L.make_map({k: self.expr(v) for k, v in items})

    def _cast(self, a, label):
        c, t = self.expr(a)
        if L.kind(t) != "node":
            raise QueryError("InvalidArgumentType", "a label cast needs a node")
        if label not in self.graph.labels():
            raise QueryError("LabelNotFound", label)
        own = {n for x in self.graph.nodes if label in x.labels for n, _ in x.props}
        kept = [(n, k) for n, k in t[1] if n in own]
        return F.when(F.array_contains(c["_labels"], label), L.make_map({n: (c[n], k) for n, k in kept})[0]), ("map", tuple(kept))

    def _haslabels(self, a, labels):
        c, t = self.expr(a) if a[0] != "var" or a[1] not in self.rows.scope or not self.rows.scope[a[1]].flat else (None, self.rows.scope[a[1]].type)
        if L.kind(t) == "rel":
            kind = c["_type"] if c is not None else self.at(self.rows.scope[a[1]], "_type")
            return (kind == labels[0]) if len(set(labels)) == 1 else F.lit(False), "bool"
        held = c["_labels"] if c is not None else self.at(self.rows.scope[a[1]], "_labels")
        out = F.lit(True)
        for x in labels:
            out = out & F.array_contains(held, x)
        return F.when(held.isNotNull(), out), "bool"

    def _case(self, subject, whens, other):
        given = self.expr(subject) if subject else None
        made = [(L.equal(given, self.expr(w))[0] if given else self.boolean(w), self.expr(v)) for w, v in whens]
        last = self.expr(other) if other else (F.lit(None), "null")
        t = last[1]
        for _, v in made:
            t = L.merge_types(t, v[1])
        out = L.cast_to(last, t)
        for w, v in reversed(made):
            out = F.when(F.coalesce(w, F.lit(False)), L.cast_to(v, t)).otherwise(out)
        return out, t

    def _over(self, var, item_type, tree):
        """A function of a list's item."""

        def run(e):
            self.lambdas.append({var: (e, item_type)})
            try:
                return self.expr(tree)
            finally:
                self.lambdas.pop()

        return run

    def _items(self, source):
        c, t = self.expr(source)
        if t == "null":
            return F.array().cast("array<string>"), "null"
        if L.kind(t) != "list":
            raise QueryError("InvalidArgumentType", "a list is needed")
        return F.coalesce(c, F.array().cast(L.sql_type(t)) if L.kind(t[1]) not in ("node", "rel", "path", "map") else F.filter(c, lambda e: F.lit(False))), t[1]

    def _listcomp(self, var, source, where, out):
        lists, t = self._items(source)
        if where is not None:
            lists = F.filter(lists, lambda e: F.coalesce(self._over(var, t, where)(e)[0].cast("boolean"), F.lit(False)))
        if out is None:
            return lists, ("list", t)
        kinds = []

        def each(e):
            c, k = self._over(var, t, out)(e)
            kinds.append(k)
            return c.cast("string") if k == "null" else c

        made = F.transform(lists, each)
        return made, ("list", kinds[0])

    def _quant(self, name, var, source, where):
        lists, t = self._items(source)
        return L.quantifier(name, lambda e: self._over(var, t, where)(e)[0].cast("boolean"), lists), "bool"

    def _call(self, name, args, distinct, star):
        if name in L.AGGREGATES:
            raise QueryError("InvalidAggregation", name)
        if name in self.functions:
            return self.functions[name](*(self.expr(a) for a in args))
        if name in ("startnode", "endnode"):
            return self._end(name, args)
        if name.endswith(".truncate") and args and args[0][0] == "lit":
            return temporal.truncate(args[0][1], self.expr(args[1]), name.split(".")[0], self.expr(args[2]) if len(args) > 2 else None)
        if name == "id" and args and args[0][0] == "var" and args[0][1] in self.rows.scope and self.rows.scope[args[0][1]].flat:
            return self.at(self.rows.scope[args[0][1]], "_id"), "int"
        if name in ("type", "labels") and args and args[0][0] == "var" and args[0][1] in self.rows.scope and self.rows.scope[args[0][1]].flat:
            var = self.rows.scope[args[0][1]]
            if var.type[0] == "rel":
                return (self.at(var, "_type"), "str") if name == "type" else (F.array(self.at(var, "_type")), ("list", "str"))
            if name == "labels":
                return self.at(var, "_labels"), ("list", "str")
        return L.call(name, [self.expr(a) for a in args])

    def _end(self, name, args, wanted=None):
        """The node at an end of a relationship, joined in by its id from the tables that hold such ends, with the properties ``wanted`` (None: all)."""
        var = self.rows.scope.get(args[0][1]) if args[0][0] == "var" and not any(args[0][1] in s for s in self.lambdas) else None
        side, kinds = "_src" if name == "startnode" else "_dst", None
        if var is not None and var.flat and var.type[0] == "rel":
            at = self.at(var, side)
            ends = [t.src if side == "_src" else t.dst for t in self.graph.edges if not var.kinds or t.type in var.kinds]
            kinds = set(ends) if None not in ends else None
        else:
            c, t = self.expr(args[0])
            if L.kind(t) != "rel":
                raise QueryError("InvalidArgumentType", name)
            at = c[side]
        end = self.add((at, "int"))
        prefix = self.fresh("n")
        found, types, held = scans.nodes(self.graph, (), prefix, wanted, kinds)
        self.rows.df = self.rows.df.join(found, F.col(end.column) == F.col(f"{prefix}{SEP}_id"), "left")
        hold = self.fresh("h")
        self.rows.scope[hold] = Var(prefix, ("node", tuple(types.items())), True, tuple(held))
        out = self.value(hold)
        del self.rows.scope[hold]
        return out

    # subqueries
    def _one_step(self, part: Part, used: tuple) -> tuple[Planner, list[str]] | None:
        """For a pattern of one step from a bound node of which nothing but its identity is read: a planner over all edges, to be joined by
        the node's id, so that the rows outside are planned once. None for other patterns."""
        if len(part.rels) != 1 or part.var or part.rels[0].hops is not None or part.rels[0].var in self.rows.scope:
            return None
        bound = [k for k in (0, 1) if part.nodes[k].var in self.rows.scope]
        if len(bound) != 1:
            return None
        near = part.nodes[bound[0]]
        var = self.rows.scope[near.var]
        read = needs((part.rels[0], part.nodes[1 - bound[0]], *used))
        if not var.flat or near.labels or near.props or any(n in self.rows.scope for n in read):
            return None
        inner = Planner(self.graph, self.params, read, self.functions)
        inner.names = self.names
        inner.rows = Rows(self.rows.df, {near.var: replace(var, type=("node", ()))}, True)
        inner.virtual = near.var
        return inner, [f"{var.column}{SEP}_id"]

    def _inner(self, tree) -> tuple[Planner, list[str]]:
        """A planner over the distinct values of what ``tree`` reads from outside."""
        inside = needs(tree)
        keys, scope = [], {}
        for name, props in inside.items():
            var = self.rows.scope.get(name)
            if var is None:
                continue
            if not var.flat:
                keys.append(var.column)
                scope[name] = var
                continue
            kept = tuple((p, t) for p, t in var.type[1] if ALL in props or p in props)
            keys += [f"{var.column}{SEP}{h}" for h in (("_id", "_labels") if var.type[0] == "node" else ("_id", "_src", "_dst", "_type"))] + [f"{var.column}{SEP}{p}" for p, _ in kept]
            scope[name] = replace(var, type=(var.type[0], kept))
        inner = Planner(self.graph, self.params, {**inside}, self.functions)
        inner.names = self.names
        if keys:
            inner.rows = Rows(self.rows.df.select(*(F.col(f"`{k}`") for k in keys)).distinct(), scope)
        return inner, keys

    def _back(self, found: DataFrame, keys: list[str], how: str) -> None:
        """Joins rows found for ``keys`` to the rows outside; their key columns go."""
        renamed = {k: self.fresh("k") for k in keys}
        found = found.select(*(F.col(f"`{c}`").alias(renamed.get(c, c)) for c in found.columns))
        on = F.lit(True)
        for k, r in renamed.items():
            here, there = F.col(f"`{k}`"), F.col(r)
            on = on & (here == there if len(keys) == 1 and k.endswith(f"{SEP}_id") else same(here, there))  # a node's id alone is never null there
        self.rows.df = self.rows.df.join(found, on, how).drop(*renamed.values())

    def _exists(self, clause, bare):
        flag = self.fresh("x")
        found, keys = self._found(clause, bare)
        found = found.select(*(F.col(f"`{k}`") for k in keys)).distinct() if keys else found.limit(1).select()
        self._back(found.withColumn(flag, F.lit(True)), keys, "left")
        return F.coalesce(F.col(flag), F.lit(False)), "bool"

    def _found(self, clause, bare=False) -> tuple[DataFrame, list[str]]:
        first = clause if isinstance(clause, Clause) else clause[0]
        if bare:
            for part in first.parts:
                for x in (*part.nodes, *part.rels):
                    if x.var and not x.var.startswith("__anon") and x.var not in self.rows.scope:
                        raise QueryError("UndefinedVariable", x.var)
        alone = isinstance(clause, Clause) and len(first.parts) == 1
        inner, keys = (alone and self._one_step(first.parts[0], (first.where,) if first.where else ())) or self._inner(clause)
        inner.match(first)
        if isinstance(clause, tuple):
            for c in clause[1:]:
                if c.kind == "match":
                    inner.match(c)
                elif c.kind == "with":
                    hold = {n: v for n, v in inner.rows.scope.items()}
                    inner.project(c.projection, False, keep=keys)
                    inner.rows.scope = {**hold, **inner.rows.scope}
        return inner.rows.df, keys

    def _patcomp(self, part, where, out):
        inner, keys = self._one_step(part, tuple(x for x in (where, out) if x)) or self._inner(("patcomp", part, where, out))
        inner.match(Clause("match", (part,), where))
        c, t = inner.expr(out)
        item, made = self.fresh("i"), self.fresh("l")
        rows = inner.rows.df.withColumn(item, F.struct((c.cast("string") if t == "null" else c).alias("v")))
        found = (rows.groupBy(*(F.col(f"`{k}`") for k in keys)) if keys else rows.groupBy()).agg(F.transform(F.collect_list(item), lambda s: s["v"]).alias(made))
        self._back(found, keys, "left")
        none = F.filter(F.col(made), lambda e: F.lit(False)) if L.kind(t) in ("node", "rel", "path", "map") else F.array().cast(L.sql_type(("list", t)))
        return F.coalesce(F.col(made), none), ("list", t)

    # matching
    def filter(self, e: tuple) -> None:
        """Keeps rows where ``e`` is true; (not) EXISTS among its conjuncts becomes a semi or anti join."""
        if e[0] == "and":
            self.filter(e[1])
            self.filter(e[2])
            return
        inverse, sub = e[0] == "not", e[1] if e[0] == "not" else e
        if sub[0] == "exists":
            found, keys = self._found(sub[1], sub[2])
            if keys:
                self._back(found.select(*(F.col(f"`{k}`") for k in keys)), keys, "left_anti" if inverse else "left_semi")
                return
        if self._has_aggregate(e):
            raise QueryError("InvalidAggregation", "in WHERE")
        # only true rows stay, so null and false needn't be told apart, and the scan can take the comparison
        condition = L.holds(e[1], self.expr(e[2]), self.expr(e[3])) if e[0] == "cmp" else self.boolean(e)
        self.rows.df = self.rows.df.filter(condition)

    def match(self, clause: Clause) -> None:
        if clause.optional:
            return self.optional(clause)
        before = set(self.rows.scope)
        rels: list[tuple[str, bool, frozenset]] = []
        waiting = list(clause.parts)
        while waiting:  # parts that share a variable with what is bound come first, and of those the ones that stay near the size of their tables
            shares = [p for p in waiting if any(n.var in self.rows.scope for n in p.nodes)]
            part = min(shares or waiting, key=self._hubs)
            waiting.remove(part)
            self._part(part, rels)
        for i, (a, long_a, kinds_a) in enumerate(rels):
            for b, long_b, kinds_b in rels[:i]:
                if not kinds_a & kinds_b or (a in before and b in before):
                    continue
                x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
                self.rows.df = self.rows.df.filter(~F.arrays_overlap(x, y) if long_a and long_b else ~F.array_contains(x, y) if long_a else ~F.array_contains(y, x) if long_b else x != y)
        if clause.where is not None:
            self.filter(clause.where)

    def optional(self, clause: Clause) -> None:
        step = self._one_step(clause.parts[0], (clause.where,) if clause.where else ()) if len(clause.parts) == 1 else None
        inner, keys = step or self._inner((clause.parts, clause.where or ()))
        inner.wanted = {k: self.wanted.get(k, set()) | v for k, v in {**{k: set() for k in self.wanted}, **inner.wanted}.items()}
        known = dict(inner.rows.scope)
        inner.match(replace(clause, optional=False))
        new = {n: v for n, v in inner.rows.scope.items() if n not in known}
        columns = [c for v in new.values() for c in inner.rows.df.columns if (c.startswith(v.column + SEP) if v.flat else c == v.column)]
        self._back(inner.rows.df.select(*(F.col(f"`{c}`") for c in (*keys, *columns))), keys, "left")
        self.rows.scope.update(new)
        self.rows.unit = False

    def _scan(self, p: NodePattern, kinds=None) -> tuple[DataFrame, Var]:
        prefix = self.fresh("n")
        df, types, found = scans.nodes(self.graph, p.labels, prefix, self.wants(p.var), kinds)
        return df, Var(prefix, ("node", tuple(types.items())), True, tuple(found))

    def _part(self, part: Part, rels: list) -> None:
        bound = [k for k, n in enumerate(part.nodes) if n.var in self.rows.scope]
        start = bound[0] if bound else max(range(len(part.nodes)), key=lambda k: (bool(part.nodes[k].props), self._held_steps(part, k), bool(part.nodes[k].labels), -k))
        p = part.nodes[start]
        if p.var == self.virtual:
            pass
        elif p.var in self.rows.scope:
            self._bound_node(p)
        elif ends := self._unread_start(part, start):
            self.virtual = p.var
            self.rows.scope[p.var] = Var(self.fresh("n"), ("node", ()), True, tuple(ends))
        else:
            df, var = self._scan(p)
            self.rows.df = df if self.rows.unit else self.rows.df.crossJoin(df)
            self.rows.unit = False
            self.rows.scope[p.var] = var
        self._inline(p)
        pieces: dict[int, tuple] = {}
        for k in range(start, len(part.rels)):
            pieces[k] = self._expand(part.nodes[k], part.rels[k], part.nodes[k + 1], False, rels, part.var is not None)
        for k in range(start - 1, -1, -1):
            pieces[k] = self._expand(part.nodes[k + 1], part.rels[k], part.nodes[k], True, rels, part.var is not None)
        if part.var:
            if part.var in self.rows.scope:
                raise QueryError("VariableAlreadyBound", part.var)
            self.rows.scope[part.var] = self.add(self._path(part, pieces, start), "p")

    def _unread_start(self, part: Part, start: int) -> list | None:
        """The label sets of a start of which only the identity is read, where the edges of its first step name it; else None."""
        p = part.nodes[start]
        if not part.rels or p.props is not None or self.wants(p.var) != set():
            return None
        onward = start < len(part.rels)
        r, far = (part.rels[start], part.nodes[start + 1]) if onward else (part.rels[start - 1], part.nodes[start - 1])
        if r.hops is not None or r.var in self.rows.scope or far.var == p.var:
            return None
        direction = r.direction if onward else {"out": "in", "in": "out"}.get(r.direction, r.direction)
        near = [t.labels for t in self.graph.nodes if set(p.labels) <= t.labels]
        ends, _ = scans.ends(self.graph, r.types, direction, near, far.labels, p.labels)
        return ends if scans.known(self.graph, ends) else None

    def _held_steps(self, part: Part, start: int) -> int:
        """Steps away from ``start`` whose edge rows are the nodes that they lead to."""
        n = 0
        for k, r in enumerate(part.rels):
            a, b = (part.nodes[k], part.nodes[k + 1]) if k >= start else (part.nodes[k + 1], part.nodes[k])
            direction = r.direction if k >= start else {"out": "in", "in": "out"}.get(r.direction, r.direction)
            n += r.hops is None and b.var not in self.rows.scope and scans.holding(self.graph, r.types, direction, None, b.labels, a.labels) is not None
        return n

    def _hubs(self, part: Part) -> int:
        """Nodes of a part, not bound yet, that many rows point to from either side: as many rows as the product meet there."""
        n = 0
        for k in range(1, len(part.rels)):
            here = part.nodes[k]
            if here.var in self.rows.scope:
                continue
            many = 0
            for r, far, turned in ((part.rels[k - 1], part.nodes[k - 1], True), (part.rels[k], part.nodes[k + 1], False)):
                direction = {"out": "in", "in": "out"}.get(r.direction, r.direction) if turned else r.direction
                many += far.var not in self.rows.scope and r.hops is None and scans.holding(self.graph, r.types, direction, None, far.labels, here.labels) is not None
            n += many == 2
        return n

    def _bound_node(self, p: NodePattern) -> None:
        var = self.rows.scope[p.var]
        if L.kind(var.type) != "node":
            raise QueryError("VariableTypeConflict", p.var)
        if not var.flat:
            self._flatten(p.var)
        if p.labels:
            self.rows.df = self.rows.df.filter(self._haslabels(("var", p.var), p.labels)[0])

    def _flatten(self, name: str) -> None:
        """A node or relationship held as a struct, as flat columns again."""
        var = self.rows.scope[name]
        prefix = self.fresh("n")
        hidden = ("_id", "_labels") if var.type[0] == "node" else ("_id", "_src", "_dst", "_type")
        whole = F.col(f"`{var.column}`")
        self.rows.df = self.rows.df.withColumns({f"{prefix}{SEP}{f}": whole[f] for f in (*hidden, *(k for k, _ in var.type[1]))})
        self.rows.scope[name] = Var(prefix, var.type, True)

    def _inline(self, p: NodePattern | RelPattern) -> None:
        if p.props is None:
            return
        if p.props[0] == "param":
            raise QueryError("InvalidParameterUse", p.props[1])
        for key, e in p.props[1]:
            test = L.equal(self._prop(("var", p.var), key), self.expr(e))[0]
            self.rows.df = self.rows.df.filter(test)

    def _expand(self, a: NodePattern, r: RelPattern, b: NodePattern, backwards: bool, rels: list, whole: bool) -> tuple:
        direction = {"out": "in", "in": "out"}.get(r.direction, r.direction) if backwards else r.direction
        here = self.rows.scope[a.var]
        target = self.rows.scope.get(b.var)
        if r.hops is not None:
            return self._walk(a, r, b, direction, rels, whole)
        if r.var in self.rows.scope and r.var not in {x for x, *_ in rels}:
            return self._bound_rel(here, r, b, direction)
        prefix = self.fresh("r")
        whole_rows = scans.holding(self.graph, r.types, direction, here.kinds, b.labels, a.labels) if target is None else None
        wanted = self.wants(b.var)
        held = [(n, t) for n, t in whole_rows[0].held if wanted is None or n in wanted] if whole_rows else []
        near, far = scans.ends(self.graph, r.types, direction, here.kinds, b.labels, a.labels)
        labelled = [e for e, unread, kinds in (("_a", a.var == self.virtual, near), ("_b", target is None and not whole_rows and wanted == set(), far)) if unread and scans.known(self.graph, kinds)]
        df, types, ends = scans.edges(self.graph, r.types, direction, prefix, self.wants(r.var), here.kinds, b.labels, a.labels, [n for n, _ in held], labelled)
        on = self.at(here, "_id") == F.col(f"{prefix}{SEP}_a")
        if target is not None:
            if not target.flat:
                self._bound_node(b)
                target = self.rows.scope[b.var]
            on = on & (self.at(target, "_id") == F.col(f"{prefix}{SEP}_b"))
        if a.var == self.virtual:
            near_id = F.col(f"{prefix}{SEP}_a")
            df = df.where(near_id.isNotNull()).withColumns({f"{here.column}{SEP}_id": near_id, **({f"{here.column}{SEP}_labels": F.col(f"`{prefix}{SEP}@_a`")} if "_a" in labelled else {})})
            self.rows.df = df if self.rows.unit else self.rows.df.crossJoin(df)
            self.rows.unit, self.virtual = False, None
        else:
            self.rows.df = self.rows.df.join(df, on)
        self.rows.scope[r.var] = Var(prefix, ("rel", tuple(types.items())), True, tuple(r.types))
        rels.append((f"{prefix}{SEP}_id", False, frozenset(r.types or self.graph.types())))
        self._inline(r)
        if whole_rows:
            node = self.fresh("n")
            labels = F.array(*(F.lit(x) for x in sorted(whole_rows[1]))).cast("array<string>")
            self.rows.df = self.rows.df.withColumns({f"{node}{SEP}_id": F.col(f"{prefix}{SEP}_b"), f"{node}{SEP}_labels": labels, **{f"{node}{SEP}{n}": F.col(f"`{prefix}{SEP}@{n}`") for n, _ in held}})
            self.rows.scope[b.var] = Var(node, ("node", tuple(held)), True, (whole_rows[1],))
            self._inline(b)
        else:
            self._arrive(b, f"{prefix}{SEP}_b", ends, F.col(f"`{prefix}{SEP}@_b`") if "_b" in labelled else None)
        return ("one", r.var)

    def _bound_rel(self, here: Var, r: RelPattern, b: NodePattern, direction: str) -> tuple:
        """A relationship that is bound already: its ends are what the nodes have to be."""
        if not self.rows.scope[r.var].flat:
            self._flatten(r.var)
        var = self.rows.scope[r.var]
        src, dst = self.at(var, "_src"), self.at(var, "_dst")
        if r.types:
            self.rows.df = self.rows.df.filter(self.at(var, "_type").isin(*r.types))
        far = self.fresh("b")
        near, other = (src, dst) if direction == "out" else (dst, src)
        me = self.at(here, "_id")
        if direction == "both":
            self.rows.df = self.rows.df.filter((me == src) | (me == dst)).withColumn(far, F.when(me == src, dst).otherwise(src))
        else:
            self.rows.df = self.rows.df.filter(me == near).withColumn(far, other)
        self._arrive(b, far, None)
        return ("one", r.var)

    def _arrive(self, b: NodePattern, column: str, ends, labels: Column | None = None) -> None:
        """Binds the node at the end of a step, or checks it; no join where only its id is read and its labels are known (of several kinds, ``labels`` has each row's)."""
        far = F.col(f"`{column}`")
        if b.var in self.rows.scope:
            self._bound_node(b)
            self.rows.df = self.rows.df.filter(self.at(self.rows.scope[b.var], "_id") == far)
        elif ends and None not in ends and len(ends) == 1 and set(b.labels) <= ends[0] and self.wants(b.var) == set():
            prefix = self.fresh("n")
            labels = F.array(*(F.lit(x) for x in sorted(ends[0]))).cast("array<string>")
            self.rows.df = self.rows.df.withColumns({f"{prefix}{SEP}_id": far, f"{prefix}{SEP}_labels": labels})
            self.rows.scope[b.var] = Var(prefix, ("node", ()), True, tuple(ends))
        elif labels is not None:
            prefix = self.fresh("n")
            self.rows.df = self.rows.df.where(far.isNotNull()).withColumns({f"{prefix}{SEP}_id": far, f"{prefix}{SEP}_labels": labels})
            self.rows.scope[b.var] = Var(prefix, ("node", ()), True, tuple(ends))
        else:
            df, var = self._scan(b, None if ends is None or None in ends else set(ends))
            self.rows.df = self.rows.df.join(df, far == F.col(f"{var.column}{SEP}_id"))
            self.rows.scope[b.var] = var
        self._inline(b)

    def _walk(self, a, r, b, direction, rels, whole) -> tuple:
        """Trails of ``hops`` edges: one join for each hop, no edge twice; unbounded ones go on until no trail is left."""
        low, high = r.hops
        here = self.rows.scope[a.var]
        listed = whole or (not r.var.startswith("__anon") and (self.wanted.get(r.var) or ALL in self.wanted))
        prefix = self.fresh("r")
        df, types, ends = scans.edges(self.graph, r.types, direction, prefix, None if listed else {k for k, _ in (r.props[1] if r.props else ())})
        ends = None if None in ends else ends
        for key, e in r.props[1] if r.props else ():
            if e[0] not in ("lit", "param"):
                raise QueryError("InvalidArgumentType", "only literals on relationships of variable length")
            if key not in types:
                raise QueryError("PropertyNotFound", key)
            df = df.filter(L.equal((F.col(f"{prefix}{SEP}{key}"), types[key]), self.expr(e))[0])
        rel = F.struct(*(F.col(f"{prefix}{SEP}{h}").alias(h) for h in ("_id", "_src", "_dst", "_type")), *(F.col(f"{prefix}{SEP}{p}").alias(p) for p in types))
        steps = df.select(F.col(f"{prefix}{SEP}_a").alias("_a"), F.col(f"{prefix}{SEP}_b").alias("_b"), F.col(f"{prefix}{SEP}_id").alias("_e"), *([rel.alias("_rel")] if listed else []))
        if whole:
            p2 = self.fresh("n")
            every, ntypes, _ = scans.nodes(self.graph, (), p2, None, None if ends is None else set(ends))
            node = F.struct(*(F.col(f"{p2}{SEP}{f}").alias(f) for f in ("_id", "_labels", *ntypes)))
            steps = steps.join(every.select(F.col(f"{p2}{SEP}_id").alias("_n"), node.alias("_node")), F.col("_b") == F.col("_n")).drop("_n")
        cur, ids, lists, nodes = self.fresh("cur"), self.fresh("ids"), self.fresh("rels"), self.fresh("nodes")
        columns = {cur: self.at(here, "_id"), ids: F.array().cast("array<bigint>")}
        if listed:
            columns[lists] = F.array().cast(f"array<{steps.schema['_rel'].dataType.simpleString()}>")
        if whole:
            columns[nodes] = F.array().cast(f"array<{steps.schema['_node'].dataType.simpleString()}>")
        outer = self.rows.df.columns
        front, out, hop = self.rows.df.withColumns(columns), [], 0
        if low == 0:
            out.append(front)
        while high < 0 or hop < high:
            hop += 1
            nxt = front.join(steps, (F.col(cur) == F.col("_a")) & ~F.array_contains(F.col(ids), F.col("_e")))
            new = {cur: F.col("_b"), ids: F.array_append(F.col(ids), F.col("_e"))}
            if listed:
                new[lists] = F.array_append(F.col(lists), F.col("_rel"))
            if whole:
                new[nodes] = F.array_append(F.col(nodes), F.col("_node"))
            front = nxt.select(*(F.col(f"`{c}`") for c in outer), *(c.alias(n) for n, c in new.items()))
            if high < 0 and hop % CUT_EVERY == 0 or high > 8 and hop % 8 == 0:
                front = cut(front)
                if not front.take(1):
                    break
                if hop >= MOST_HOPS:
                    raise QueryError("PathTooLong", f"over {MOST_HOPS} hops")
            if hop >= low:
                out.append(front)
        self.rows.df = scans._union(out) if out else front.filter(F.lit(False))
        rels.append((ids, True, frozenset(r.types or self.graph.types())))
        if listed and not r.var.startswith("__anon"):
            self.rows.scope[r.var] = Var(lists, ("list", ("rel", tuple(types.items()))))
        if low == 0 and ends is not None:  # the walk may end where it began
            ends = None if here.kinds is None else list(dict.fromkeys([*ends, *here.kinds]))
        self._arrive(b, cur, ends)
        return ("many", lists, tuple(types.items()), nodes if whole else None, tuple(ntypes.items()) if whole else ())

    def _path(self, part: Part, pieces: dict[int, tuple], start: int) -> tuple[Column, object]:
        """The path's nodes and relationships in the pattern's order, with the properties of all of them."""
        node_types: dict = {}
        rel_types: dict = {}
        for n in part.nodes:
            for k, t in self.rows.scope[n.var].type[1]:
                node_types[k] = L.merge_types(node_types.get(k, t), t)
        for piece in pieces.values():
            for k, t in self.rows.scope[piece[1]].type[1] if piece[0] == "one" else piece[2]:
                rel_types[k] = L.merge_types(rel_types.get(k, t), t)
            for k, t in piece[4] if piece[0] == "many" else ():
                node_types[k] = L.merge_types(node_types.get(k, t), t)

        def shaped(c, have, want, hidden):
            have = dict(have)
            return F.struct(*(c[h].alias(h) for h in hidden), *(L.cast_to((c[k], have[k]), t).alias(k) if k in have else F.lit(None).cast(L.sql_type(t)).alias(k) for k, t in want.items()))

        node = lambda c, have: shaped(c, have, node_types, ("_id", "_labels"))
        rel = lambda c, have: shaped(c, have, rel_types, ("_id", "_src", "_dst", "_type"))
        alone = lambda v: node(self.value(v)[0], self.rows.scope[v].type[1])
        each = lambda column, shape, have: F.transform(F.col(column), lambda e: shape(e, have))
        nodes, edges = [F.array(alone(part.nodes[0].var))], []
        for k in range(len(part.rels)):
            piece = pieces[k]
            if piece[0] == "one":
                edges.append(F.array(rel(*self._rel(piece[1]))))
                nodes.append(F.array(alone(part.nodes[k + 1].var)))
                continue
            _, lists, types, held, ntypes = piece
            walked, between = each(lists, rel, types), each(held, node, ntypes)
            if k < start:  # walked from the far end
                walked = F.reverse(walked)
                inner = F.reverse(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))))
                nodes.append(F.when(F.size(between) > 0, F.concat(inner, F.array(alone(part.nodes[k + 1].var)))).otherwise(inner))
            else:
                nodes.append(between)
            edges.append(walked)
        ids = F.array().cast("array<string>")
        all_nodes, all_edges = F.concat(*nodes), F.concat(*edges) if edges else ids
        made = F.struct(all_nodes.alias("nodes"), all_edges.alias("rels"))
        present = self.at(self.rows.scope[part.nodes[0].var], "_id").isNotNull()
        return F.when(present, made), ("path", ("node", tuple(node_types.items())), ("rel", tuple(rel_types.items())))

    def _rel(self, name):
        return self.value(name)[0], self.rows.scope[name].type[1]

    # projections
    def _has_aggregate(self, e) -> bool:
        if isinstance(e, tuple):
            if e and e[0] == "call" and len(e) == 5 and e[1] in L.AGGREGATES:
                return True
            if e and e[0] in ("exists",):
                return False
            return any(self._has_aggregate(x) for x in e)
        return False

    def project(self, p: Projection, last: bool, keep: list[str] = ()) -> None:
        rows = self.rows
        items = [(i.name, i.expr, i.aliased) for i in p.items]
        if p.star:
            shown = sorted(n for n in rows.scope if not n.startswith("__anon"))
            if not shown:
                raise QueryError("NoVariablesInScope", "*")
            items = [(n, ("var", n), False) for n in shown] + items
        if len({n for n, *_ in items}) < len(items):
            raise QueryError("ColumnNameConflict", ", ".join(n for n, *_ in items))
        if any(self._has_aggregate(e) for _, e, _ in items):
            made = self._aggregate(items, keep)
        else:
            made = {}
            for name, e, _ in items:
                if e[0] == "var" and e[1] in rows.scope:
                    made[name] = rows.scope[e[1]]
                else:
                    made[name] = self.add(self.expr(e))
        grouped = any(self._has_aggregate(e) for _, e, _ in items)
        known = {e: n for n, e, _ in items}
        if p.distinct:
            self._select(made, keep)
            self.rows.df = self.rows.df.distinct()
        if p.distinct or grouped:
            rows.scope = dict(made)
        else:
            rows.scope = {**rows.scope, **made}
        keys = []
        for e, down in p.order:
            e = self._renamed(e, known) if p.distinct or grouped else e
            if self._has_aggregate(e):
                raise QueryError("InvalidAggregation", "in ORDER BY")
            keys += L.order_key(self.expr(e), down)
        if keys:
            self.rows.df = self.rows.df.orderBy(*keys)
        if p.skip is not None:
            self.rows.df = self.rows.df.offset(self.constant(p.skip))
        if p.limit is not None:
            self.rows.df = self.rows.df.limit(self.constant(p.limit))
        if p.where is not None and not (p.distinct or grouped or p.order or p.skip or p.limit):
            self.filter(p.where)
            rows.scope = dict(made)
        else:
            rows.scope = dict(made)
            if p.where is not None:
                self.filter(p.where)
        if last:
            self.finish(made)
        else:
            self._select(made, keep)
        self.rows.unit = False

    def _renamed(self, e, known):
        """An expression over a projection's results: parts that it projects are its columns."""
        if e in known:
            return ("var", known[e])
        return tuple(self._renamed(x, known) if isinstance(x, tuple) else x for x in e) if isinstance(e, tuple) else e

    def _columns(self, var: Var) -> list[str]:
        return [c for c in self.rows.df.columns if (c.startswith(var.column + SEP) and c.split(SEP)[-1] not in ("_a", "_b") and not c.split(SEP)[-1].startswith("@") if var.flat else c == var.column)]

    def _select(self, made: dict[str, Var], keep=()) -> None:
        columns = dict.fromkeys([*keep, *(c for v in made.values() for c in self._columns(v))])
        self.rows.df = self.rows.df.select(*(F.col(f"`{c}`") for c in columns))

    def finish(self, made: dict[str, Var]) -> None:
        """The result: one column for each name, entities as structs."""
        self.rows.scope = made
        self.rows.df = self.rows.df.select(*(L.shown(self.value(n))[0].alias(n) for n in made))
        self.rows.scope = {n: Var(n, v.type) for n, v in made.items()}

    def constant(self, e: tuple) -> int:
        if e[0] == "lit":
            value = e[1]
        elif e[0] == "param":
            value = self.params.get(e[1])
        elif e[0] == "bin":
            a, b = self.constant(e[2]), self.constant(e[3])
            value = {"+": a + b, "-": a - b, "*": a * b, "/": a // b if b else None, "%": a % b if b else None}.get(e[1])
        elif e[0] == "call" and e[1] in ("tointeger",) and e[2]:
            value = int(self.constant(e[2][0]))
        elif e[0] in ("var", "prop"):
            raise QueryError("NonConstantExpression", "SKIP and LIMIT")
        else:
            value = None
        if isinstance(value, bool) or not isinstance(value, int):
            raise QueryError("InvalidArgumentType", "a whole number is needed")
        if value < 0:
            raise QueryError("NegativeIntegerArgument", str(value))
        return value

    def _aggregate(self, items, keep) -> dict[str, Var]:
        """Implicit grouping: items without an aggregate are the keys; what surrounds aggregates is computed after."""
        made: dict[str, Var] = {}
        keys: dict[tuple, str] = {}
        for name, e, _ in items:
            if not self._has_aggregate(e):
                made[name] = self.rows.scope[e[1]] if e[0] == "var" and e[1] in self.rows.scope else self.add(self.expr(e))
                keys[e] = name
        aggregates: list[tuple[Column, str, object]] = []
        for name, e, _ in items:
            if e[0] != "var":
                self._check_nested(e)
        after = {name: self._pull(e, keys, aggregates) for name, e, _ in items if name not in made}
        columns = list(dict.fromkeys([*keep, *(c for v in made.values() for c in self._columns(v))]))
        grouped = self.rows.df.groupBy(*(F.col(f"`{c}`") for c in columns)) if columns else self.rows.df.groupBy()
        self.rows.df = grouped.agg(*(c.alias(n) for c, n, _ in aggregates))
        self.rows.scope = dict(made)
        for name, e in after.items():
            made[name] = Var(e[1], e[2]) if e[0] == "column" else self.add(self.expr(e))
        return {name: made[name] for name, *_ in items}

    def _check_nested(self, e, inside=False) -> None:
        if isinstance(e, tuple):
            agg = e and e[0] == "call" and len(e) == 5 and e[1] in L.AGGREGATES
            if agg and inside:
                raise QueryError("NestedAggregation", e[1])
            if inside and e and e[0] == "call" and e[1] == "rand":
                raise QueryError("NonConstantExpression", "rand() in an aggregate")
            for x in e:
                self._check_nested(x, inside or bool(agg))

    def _pull(self, e, keys, out):
        if e in keys and e[0] != "lit":
            return ("var", keys[e])
        if not isinstance(e, tuple) or not e:
            return e
        if e[0] == "call" and len(e) == 5 and e[1] in L.AGGREGATES:
            name = self.fresh("g")
            if e[1] in ("percentiledisc", "percentilecont"):
                share = e[2][1][1] if e[2][1][0] == "lit" else self.params.get(e[2][1][1]) if e[2][1][0] == "param" else None
                if share is None:
                    value = F.max(F.lit(None).cast("double")), "float"
                else:
                    of = self.expr(e[2][0])
                    if L.kind(of[1]) not in (*L.NUMBERS, "null", "any"):
                        raise QueryError("InvalidArgumentType", f"{e[1]} of {L.kind(of[1])}")
                    of = (L.of_kind(of, "float"), "float") if of[1] in ("any", "null") else of
                    held = self.add((of[0].cast(L.sql_type(of[1])), of[1]))
                    value = L.percentile(e[1], (F.col(held.column), of[1]), float(share), e[3], held.column)
            else:
                value = L.aggregate(e[1], [self.expr(a) if not (e[1] == "count" and self._is_flat(a)) else (self._present(a), "int") for a in e[2]], e[3], e[4])
            out.append((value[0], name, value[1]))
            return ("column", name, value[1])
        if e[0] == "var" and not any(e[1] in s for s in self.lambdas) and e[1] in self.rows.scope:
            raise QueryError("AmbiguousAggregationExpression", e[1])
        return tuple(self._pull(x, keys, out) if isinstance(x, tuple) else x for x in e)

    def _is_flat(self, a) -> bool:
        return a[0] == "var" and a[1] in self.rows.scope and self.rows.scope[a[1]].flat

    # other reading clauses
    def unwind(self, clause: Clause) -> None:
        if clause.var in self.rows.scope:
            raise QueryError("VariableAlreadyBound", clause.var)
        c, t = self.expr(clause.expr)
        column = self.fresh("u")
        if L.kind(t) != "list":
            self.rows.df = self.rows.df.filter(F.lit(False)).withColumn(column, F.lit(None).cast("string"))
            self.rows.scope[clause.var] = Var(column, "null")
        else:
            self.rows.df = self.rows.df.withColumn(column, F.explode(c))
            self.rows.scope[clause.var] = Var(column, t[1])
        self.rows.unit = False
