"""Scalar functions and operators as Spark columns with the query language's semantics.

A value is (column, type). Types are names ('int', 'float', 'str', 'bool', 'date', 'localdatetime', 'duration', 'null', 'any')
or tuples: ('list', item), ('map', ((key, type), ...)), ('node', props), ('rel', props), ('path', node, rel).
Where values of unlike kinds meet in one column ('any'), each is a struct of its kind's rank, its number, its text and, for whole
numbers, the exact one: in the struct's own order, kinds come in the order of the language and values of a kind in theirs.
Nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphweft.errors import QueryError

NUMBERS = ("int", "float")
ENTITIES = ("node", "rel")
#: The Spark type of each scalar.
SQL_TYPES = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "date": "date", "localdatetime": "timestamp_ntz", "datetime": "struct<utc:bigint,offset:int,zone:string>", "time": "struct<utc:bigint,offset:int>", "localtime": "struct<nanos:bigint>", "null": "void", "any": "struct<rank:int,num:double,str:string,whole:bigint>", "duration": "struct<months:bigint,days:bigint,seconds:bigint,nanos:bigint>"}


#: Fixed by the language: the order of kinds, from the least.
RANKS = {"map": 1, "node": 2, "rel": 3, "list": 4, "path": 5, "datetime": 6, "localdatetime": 7, "date": 8, "time": 9, "localtime": 10, "duration": 11, "str": 12, "bool": 13, "int": 14, "float": 14}


#: What a result shows as text.
TEXT = ("any", "datetime", "time", "localtime")


def kind(t) -> str:
    return t if isinstance(t, str) else t[0]


def sql_type(t) -> str:
    if kind(t) == "list":
        return f"array<{sql_type(t[1])}>"
    if kind(t) == "map":
        return "struct<" + ",".join(f"`{k}`:{sql_type(v)}" for k, v in t[1]) + ">"
    return SQL_TYPES.get(t, "string")


def merge_types(a, b):
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if kind(a) in NUMBERS and kind(b) in NUMBERS:
        return "float"
    if kind(a) == kind(b) == "list":
        return ("list", merge_types(a[1], b[1]))
    return "any"


def tagged(value) -> Column:
    """A value with its kind beside it."""
    x, t = value
    if t == "any":
        return x
    none = F.lit(None)
    if t == "null":
        return none.cast(SQL_TYPES["any"])
    number = x.cast("double") if t in (*NUMBERS, "bool") else none.cast("double")
    text = none.cast("string") if t in (*NUMBERS, "bool") else x if t == "str" else F.to_json(x) if kind(t) in ("list", "map", "path", *ENTITIES) else to_string(value)[0]
    made = F.struct(F.lit(RANKS.get(kind(t), 0)).cast("int").alias("rank"), number.alias("num"), text.alias("str"), (x if t == "int" else none.cast("bigint")).alias("whole"))
    return F.when(x.isNotNull(), made)


def of_kind(value, wanted: str) -> Column:
    """What a value of unknown kind holds as a number, text or truth; null for other kinds."""
    x, t = value
    if t != "any":
        return x
    if wanted == "str":
        return F.when(x["rank"] == RANKS["str"], x["str"])
    if wanted == "bool":
        return F.when(x["rank"] == RANKS["bool"], x["num"] == 1)
    return F.when(x["rank"] == RANKS["int"], x["num"])


def cast_to(value, t) -> Column:
    column, have = value
    if have == t or kind(t) in (*ENTITIES, "path"):
        return column
    if t == "any":
        return tagged(value)
    if kind(t) == "list" and kind(have) == "list" and have[1] != "null":
        return F.transform(column, lambda e: cast_to((e, have[1]), t[1]))
    return column.cast(sql_type(t))


def equal(a, b) -> tuple[Column, str]:
    """Three-valued equality: unlike kinds differ, NaN equals nothing, lists compare item by item."""
    (x, s), (y, t) = a, b
    if kind(s) in ENTITIES and kind(t) in ENTITIES:
        return x["_id"] == y["_id"], "bool"
    if "null" in (s, t):
        return F.lit(None).cast("boolean"), "bool"
    if "any" in (s, t):
        x, y = tagged(a), tagged(b)
        alike = F.when(x["rank"] != y["rank"], False).when(x["num"].isNotNull(), F.when(F.isnan(x["num"]) | F.isnan(y["num"]), False).otherwise(x["num"] == y["num"]) & F.coalesce(x["whole"] == y["whole"], F.lit(True))).otherwise(x["str"] == y["str"])
        return F.when(x.isNotNull() & y.isNotNull(), alike), "bool"
    if kind(s) in NUMBERS and kind(t) in NUMBERS:
        same = x == y
        for c, k in ((x, s), (y, t)):
            if k == "float":
                same = same & ~F.isnan(c)
        return same, "bool"
    if kind(s) == kind(t) == "list":
        m = merge_types(s, t)
        pairs = F.zip_with(cast_to(a, m), cast_to(b, m), lambda p, q: equal((p, m[1]), (q, m[1]))[0])
        return F.when(x.isNull() | y.isNull(), None).when(F.size(x) != F.size(y), False).when(F.exists(pairs, lambda p: ~p), False).when(F.exists(pairs, lambda p: p.isNull()), None).otherwise(True), "bool"
    if kind(s) == kind(t) == "map":
        if {k for k, _ in s[1]} != {k for k, _ in t[1]}:
            return F.when(x.isNotNull() & y.isNotNull(), False), "bool"
        out, types = F.lit(True), dict(t[1])
        for k, v in s[1]:
            out = out & equal((x[k], v), (y[k], types[k]))[0]
        return out, "bool"
    if kind(s) != kind(t):
        return F.when(x.isNotNull() & y.isNotNull(), False), "bool"
    return (x["utc"] == y["utc"] if s in ("datetime", "time") else x == y), "bool"


def compare(op: str, a, b) -> tuple[Column, str]:
    if op in ("=", "<>"):
        same = equal(a, b)[0]
        if op == "=":
            return same, "bool"
        out = ~same
        if "float" in (a[1], b[1]) and {a[1], b[1]} <= {"int", "float"}:
            out = F.when(a[0].isNotNull() & b[0].isNotNull(), ~F.coalesce(same, F.lit(False)))
        return out, "bool"
    (x, s), (y, t) = a, b
    if kind(s) == kind(t) == "list" and kind(s[1]) == kind(t[1]):
        n = F.least(F.size(x), F.size(y))
        at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & (F.get(x, i) != F.get(y, i)))
        less = F.when(F.size(at) > 0, compare(op, (F.get(x, F.get(at, 0)), s[1]), (F.get(y, F.get(at, 0)), t[1]))[0]).otherwise(_ordered(op, F.size(x), F.size(y)))
        return F.when(x.isNull() | y.isNull() | F.exists(F.slice(x, 1, n), lambda e: e.isNull()) | F.exists(F.slice(y, 1, n), lambda e: e.isNull()), None).otherwise(less), "bool"
    if "any" in (s, t) and "null" not in (s, t):
        x, y = tagged(a), tagged(b)
        both = x["rank"] == y["rank"]
        number = F.when(both & ~F.isnan(x["num"]) & ~F.isnan(y["num"]), _ordered(op, x["num"], y["num"]))
        return F.coalesce(number, F.when(both & x["num"].isNull(), _ordered(op, x["str"], y["str"]))), "bool"
    alike = kind(s) == kind(t) or {kind(s), kind(t)} <= set(NUMBERS)
    if not alike or kind(s) in (*ENTITIES, "map", "path"):
        return F.lit(None).cast("boolean"), "bool"
    out = _ordered(op, x["utc"], y["utc"]) if s in ("datetime", "time") else _ordered(op, x, y)
    for c, k in ((x, s), (y, t)):
        if k == "float":
            out = F.when(F.isnan(c), None).otherwise(out)
    return out, "bool"


def holds(op: str, a, b) -> Column:
    """A comparison where only its truth counts: numbers compare bare, NaN apart."""
    (x, s), (y, t) = a, b
    if op in ("=", "<>") or not {kind(s), kind(t)} <= set(NUMBERS):
        return compare(op, a, b)[0]
    out = _ordered(op, x, y)
    for c, k in ((x, s), (y, t)):
        if k == "float":
            out = out & ~F.isnan(c)
    return out


def _ordered(op: str, x: Column, y: Column) -> Column:
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def arithmetic(op: str, a, b) -> tuple[Column, object]:
    (x, s), (y, t) = a, b
    if op == "+" and ("list" in (kind(s), kind(t))):
        if kind(s) == kind(t):
            m = merge_types(s, t)
            return F.concat(cast_to(a, m), cast_to(b, m)), m
        side, other, lists = (a, b, s) if kind(s) == "list" else (b, a, t)
        m = ("list", merge_types(lists[1], other[1]))
        one = F.array(cast_to(other, m[1]))
        whole = cast_to(side, m)
        return (F.concat(whole, one) if kind(s) == "list" else F.concat(one, whole)), m
    if "any" in (s, t) and {kind(s), kind(t)} <= {"str", "bool", "any", *NUMBERS}:
        return _mixed_arithmetic(op, a, b)
    if op == "+" and "str" in (s, t) and {s, t} <= {"str", "int", "float", "null", "bool"}:
        return F.concat(to_string(a)[0], to_string(b)[0]), "str"
    temporal = {"date", "localdatetime", "datetime", "time", "localtime", "duration"} & {kind(s), kind(t)}
    if temporal:
        from graphweft.functions import temporal as tm

        return tm.arithmetic(op, a, b)
    if "null" in (s, t):
        return F.lit(None).cast("double" if "float" in (s, t) else "bigint"), "float" if "float" in (s, t) else "int"
    if not {kind(s), kind(t)} <= set(NUMBERS):
        raise QueryError("InvalidArgumentType", f"{kind(s)} {op} {kind(t)}")
    if op == "^":
        return F.pow(x.cast("double"), y.cast("double")), "float"
    whole = s == t == "int"
    if op in "+-*":
        x, y = (x, y) if whole else (x.cast("double"), y.cast("double"))
        return {"+": x + y, "-": x - y, "*": x * y}[op], "int" if whole else "float"
    if whole:  # towards zero; by zero: null
        safe = F.nullif(y, F.lit(0).cast("bigint"))
        return F.call_function("div", x, safe) if op == "/" else x % safe, "int"
    x, y = x.cast("double"), y.cast("double")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    if op == "/":
        return F.when(y == 0, F.when(F.isnan(x) | (x == 0), nan).when(x > 0, inf).when(x < 0, -inf)).otherwise(x / F.when(y != 0, y)), "float"
    return F.when(y == 0, F.when(x.isNotNull(), nan)).otherwise(x % F.when(y != 0, y)), "float"


def _mixed_arithmetic(op: str, a, b) -> tuple[Column, str]:
    """Numbers as numbers (whole ones as such), text joined by +; null where the kinds don't go together."""
    x, y = tagged(a), tagged(b)
    whole = arithmetic(op, (x["whole"], "int"), (y["whole"], "int"))
    number = arithmetic(op, (of_kind((x, "any"), "float"), "float"), (of_kind((y, "any"), "float"), "float"))
    out = F.when(x["whole"].isNotNull() & y["whole"].isNotNull(), tagged(whole)).when((x["rank"] == RANKS["int"]) & (y["rank"] == RANKS["int"]), tagged(number))
    if op == "+":
        text = F.concat(to_string((x, "any"))[0], to_string((y, "any"))[0])
        out = out.when((x["rank"] == RANKS["str"]) | (y["rank"] == RANKS["str"]), tagged((text, "str")))
    return out, "any"


def in_list(a, b) -> tuple[Column, str]:
    (x, s), (y, t) = a, b
    if t == "null":
        return F.lit(None).cast("boolean"), "bool"
    if kind(t) != "list":
        raise QueryError("InvalidArgumentType", "IN needs a list")
    if s == "null":
        return F.when(F.size(y) == 0, False), "bool"
    return F.when(F.size(y) == 0, False).otherwise(F.exists(y, lambda e: equal((x, s), (e, t[1]))[0])), "bool"


def index(a, b) -> tuple[Column, object]:
    (x, s), (y, t) = a, b
    if kind(s) == "list":
        if t not in ("int", "null", "any"):
            raise QueryError("InvalidArgumentType", "list index")
        y = y.cast("int")
        return F.get(x, F.when(y < 0, y + F.size(x)).otherwise(y)), s[1]
    if s == "null":
        return F.lit(None), "null"
    raise QueryError("InvalidArgumentType", f"{kind(s)} can't be indexed")


def cut_list(a, low, high) -> tuple[Column, object]:
    x, s = a
    n = F.size(x)
    place = lambda v, other: other if v is None else F.least(F.greatest(F.when(v[0] < 0, v[0] + n).otherwise(v[0]), F.lit(0)), n)
    i, j = place(low, F.lit(0)), place(high, n)
    return F.when(i.isNotNull() & j.isNotNull(), F.slice(x, (i + 1).cast("int"), F.greatest(j - i, F.lit(0)).cast("int"))), s


def to_string(a) -> tuple[Column, str]:
    x, t = a
    if t == "any":
        whole = F.when(x["whole"].isNotNull(), x["whole"].cast("string")).otherwise(x["num"].cast("string"))
        return F.when(x["rank"] == RANKS["int"], whole).when(x["rank"] == RANKS["bool"], (x["num"] == 1).cast("string")).otherwise(x["str"]), "str"
    if t in ("duration", "localdatetime", "datetime", "time", "localtime"):
        from graphweft.functions import temporal as tm

        return tm.text(a), "str"
    return x.cast("string"), "str"


WHITE = " \\t\\n\\r\\f\\x0b"


def _needs(args, n, name):
    if len(args) not in (n if isinstance(n, tuple) else (n,)):
        raise QueryError("InvalidNumberOfArguments", name)


def _text(args) -> bool:
    return kind(args[0][1]) in ("str", "any", "null")


def call(name: str, args: list) -> tuple[Column, object]:
    """A scalar function by its lower-case name."""
    if name.split(".")[0] in ("date", "localdatetime", "datetime", "localtime", "time", "duration") or name in ("timestamp",):
        from graphweft.functions import temporal as tm

        return tm.call(name, args)
    found = FUNCTIONS.get(name)
    if not found:
        raise QueryError("UnknownFunction", name)
    n, build = found
    if n is not None:
        _needs(args, n, name)
    return build(args)


def _math(build, out=None):
    def run(args):
        x, t = args[0]
        if t == "null":
            return F.lit(None).cast("double"), out or "float"
        if kind(t) not in (*NUMBERS, "any"):
            raise QueryError("InvalidArgumentType", "a number is needed")
        return build(of_kind(args[0], "float")), out or ("float" if t == "any" else t)

    return run


def _string(build, out="str"):
    def run(args):
        if not _text(args):
            return F.lit(None).cast(sql_type(out)), out
        return build(of_kind(args[0], "str"), *(of_kind(a, "str") if a[1] == "any" else a[0] for a in args[1:])), out

    return run


def _size(args):
    x, t = args[0]
    if kind(t) == "list":
        return F.size(x).cast("bigint"), "int"
    if kind(t) == "path":
        raise QueryError("InvalidArgumentType", "size of a path")
    return F.length(of_kind(args[0], "str").cast("string")).cast("bigint"), "int"


def _reverse(args):
    return (F.reverse(of_kind(args[0], "str")), "str") if args[0][1] == "any" else (F.reverse(args[0][0]), args[0][1])


def _list(build, item=True):
    def run(args):
        x, t = args[0]
        if t == "null":
            return F.lit(None), "null"
        if kind(t) != "list":
            raise QueryError("InvalidArgumentType", "a list is needed")
        return build(x), t[1] if item else t

    return run


def _range(args):
    a, b = args[0][0], args[1][0]
    step = args[2][0] if len(args) > 2 else F.lit(1).cast("bigint")
    ok = ((step > 0) & (a <= b)) | ((step < 0) & (a >= b))
    run = F.sequence(F.when(ok, a).otherwise(0).cast("bigint"), F.when(ok, b).otherwise(0).cast("bigint"), F.when(ok, step).otherwise(1).cast("bigint"))
    bad = F.raise_error(F.lit("NumberOutOfRange: step 0"))
    return F.when(step == 0, bad.cast("array<bigint>")).when(ok, run).when(a.isNotNull() & b.isNotNull() & step.isNotNull(), F.array().cast("array<bigint>")), ("list", "int")


def _coalesce(args):
    t = args[0][1]
    for a in args[1:]:
        t = merge_types(t, a[1])
    return F.coalesce(*(cast_to(a, t) for a in args)), t


def _to_integer(args):
    x, t = args[0]
    if t == "any":
        number, text = of_kind(args[0], "float"), of_kind(args[0], "str")
        return F.coalesce(x["whole"], *(_to_integer([v])[0] for v in ((number, "float"), (text, "str"), (of_kind(args[0], "bool"), "bool")))), "int"
    if t == "bool":
        return x.cast("bigint"), "int"
    if kind(t) in ("list", "map", "node", "rel", "path"):
        raise QueryError("TypeError", "toInteger")
    if t == "int":
        return x, "int"
    whole = F.expr("0D").cast("double") if t == "null" else x.try_cast("double")
    return F.when(whole.between(-9.3e18, 9.2e18), whole).cast("bigint") if t != "str" else F.coalesce(x.try_cast("bigint"), F.when(whole.between(-9.2e18, 9.2e18), whole).cast("bigint")), "int"


def _to_float(args):
    x, t = args[0]
    if t == "any":
        return F.coalesce(of_kind(args[0], "float"), of_kind(args[0], "str").try_cast("double")), "float"
    if kind(t) in ("bool", "list", "map", "node", "rel", "path"):
        raise QueryError("TypeError", "toFloat")
    return x.try_cast("double"), "float"


def _to_boolean(args):
    x, t = args[0]
    if t == "any":
        return F.coalesce(of_kind(args[0], "bool"), *(_to_boolean([v])[0] for v in ((x["whole"], "int"), (of_kind(args[0], "str"), "str")))), "bool"
    if t == "bool":
        return x, t
    if t == "int":
        return x != 0, "bool"
    if kind(t) not in ("str", "null", "any"):
        raise QueryError("TypeError", "toBoolean")
    return F.when(x == "true", True).when(x == "false", False), "bool"


def _keys(args):
    x, t = args[0]
    if kind(t) in ENTITIES or kind(t) == "map":
        present = F.array_compact(F.array(*(F.when(x[k].isNotNull(), F.lit(k)) for k, _ in t[1]))) if t[1] else F.array().cast("array<string>")
        return F.when(x.isNotNull(), present), ("list", "str")
    if t == "null":
        return F.lit(None).cast("array<string>"), ("list", "str")
    raise QueryError("InvalidArgumentType", "keys")


def _properties(args):
    x, t = args[0]
    if kind(t) in (*ENTITIES, "map"):
        return F.when(x.isNotNull(), F.struct(*(x[k].alias(k) for k, _ in t[1])) if t[1] else F.struct(F.lit(None).cast("string").alias("_"))), ("map", t[1])
    raise QueryError("InvalidArgumentType", "properties")


def _of_entity(field, wanted, out):
    def run(args):
        x, t = args[0]
        if t == "null":
            return F.lit(None).cast(sql_type(out)), out
        if kind(t) not in wanted:
            raise QueryError("InvalidArgumentType", f"{kind(t)}")
        return x[field], out

    return run


def _labels(args):
    x, t = args[0]
    if kind(t) == "rel":
        return F.array(x["_type"]), ("list", "str")
    return _of_entity("_labels", ("node",), ("list", "str"))(args)


def _path(field):
    def run(args):
        x, t = args[0]
        if t == "null":
            return F.lit(None), "null"
        if kind(t) != "path":
            raise QueryError("InvalidArgumentType", field)
        return x[field], ("list", t[1] if field == "nodes" else t[2])

    return run


def _length(args):
    x, t = args[0]
    if kind(t) == "path":
        return F.size(x["rels"]).cast("bigint"), "int"
    raise QueryError("InvalidArgumentType", "length")


def _substring(args):
    if not _text(args):
        return F.lit(None).cast("string"), "str"
    x, at = of_kind(args[0], "str"), args[1][0].cast("int")
    n = args[2][0].cast("int") if len(args) > 2 else F.length(x)
    return F.when((at >= 0) & (n >= 0), F.substring(x, at + 1, n)), "str"


def _split(s, sep):
    literal = F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(sep != "", F.split(s, literal, -1))


FUNCTIONS = {
    "abs": (1, _math(F.abs)),
    "ceil": (1, _math(lambda x: F.ceil(x).cast("double"), "float")),
    "sign": (1, _math(lambda x: F.signum(x.cast("double")).cast("bigint"), "int")),
    "sqrt": (1, _math(lambda x: F.sqrt(x.cast("double")), "float")),
    "rand": (0, lambda args: (F.rand(), "float")),
    "trim": (1, _string(lambda s: F.regexp_replace(s, f"^[{WHITE}]+|[{WHITE}]+$", ""))),
    "ltrim": (1, _string(lambda s: F.regexp_replace(s, f"^[{WHITE}]+", ""))),
    "rtrim": (1, _string(lambda s: F.regexp_replace(s, f"[{WHITE}]+$", ""))),
    "split": (2, _string(_split, ("list", "str"))),
    "replace": (3, _string(lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b)))),
    "substring": ((2, 3), _substring),
    "left": (2, _string(lambda s, n: F.left(s, F.greatest(n, F.lit(0)).cast("int")))),
    "right": (2, _string(lambda s, n: F.right(s, F.greatest(n, F.lit(0)).cast("int")))),
    "toupper": (1, _string(F.upper)),
    "tolower": (1, _string(F.lower)),
    "reverse": (1, _reverse),
    "size": (1, _size),
    "head": (1, _list(lambda x: F.get(x, F.lit(0)))),
    "last": (1, _list(lambda x: F.get(x, F.size(x) - 1))),
    "tail": (1, _list(lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), False)),
    "range": ((2, 3), _range),
    "coalesce": (None, _coalesce),
    "tointeger": (1, _to_integer),
    "tofloat": (1, _to_float),
    "toboolean": (1, _to_boolean),
    "tostring": (1, lambda args: to_string(args[0])),
    "id": (1, _of_entity("_id", ENTITIES, "int")),
    "type": (1, _of_entity("_type", ("rel",), "str")),
    "labels": (1, _labels),
    "keys": (1, _keys),
    "properties": (1, _properties),
    "nodes": (1, _path("nodes")),
    "relationships": (1, _path("rels")),
    "length": (1, _length),
}

#: Fixed by the language: aggregating functions and their numbers of arguments.
AGGREGATES = {"count": 1, "sum": 1, "avg": 1, "min": 1, "max": 1, "collect": 1, "percentiledisc": 2, "percentilecont": 2}


def aggregate(name: str, args: list, distinct: bool, star: bool) -> tuple[Column, object]:
    if star:
        return F.count(F.lit(1)), "int"
    _needs(args, AGGREGATES[name], name)
    x, t = args[0]
    if name == "count":
        x = x["_id"] if kind(t) in ENTITIES else x
        return (F.count_distinct(x) if distinct else F.count(x)), "int"
    if name == "collect":
        return (F.collect_set(x) if distinct else F.collect_list(x)), ("list", t)
    if name in ("min", "max"):
        return (F.min(x) if name == "min" else F.max(x)), t
    if kind(t) not in (*NUMBERS, "null", "any", "duration"):
        raise QueryError("InvalidArgumentType", f"{name} of {kind(t)}")
    if t == "any":
        x, t = of_kind(args[0], "float"), "float"
    if name == "sum":
        out = t if t in NUMBERS else "int"
        return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0)).cast(sql_type(out)), out
    if name == "avg":
        return (F.call_function("avg", x.cast("double")) if not distinct else F.sum_distinct(x.cast("double")) / F.count_distinct(x)), "float"
    raise QueryError("UnknownFunction", name)


def percentile(name: str, value, share: float, distinct: bool, column: str) -> tuple[Column, object]:
    """percentileDisc: rank ceil(share * n), at least 1; percentileCont: interpolated at share * (n - 1). ``column`` is a name for the value's column.

    Groups are counts by value, merged before and after the shuffle, not lists of rows.
    """
    if not 0 <= share <= 1:
        raise QueryError("NumberOutOfRange", str(share))
    x, t = value
    if not distinct:
        if name == "percentilecont":
            return F.percentile(x.cast("double"), share), "float"
        if t in NUMBERS:
            return F.expr(f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY `{column}`)").cast(sql_type(t)), t
    items = F.array_sort(F.collect_set(x) if distinct else F.collect_list(x))
    if name == "percentiledisc":
        return F.get(items, F.greatest(F.ceil(F.size(items) * F.lit(share)), F.lit(1)).cast("int") - 1), t
    at = (F.size(items) - 1) * F.lit(share)
    low, high = (F.get(items, f(at).cast("int")).cast("double") for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at)), "float"


def quantifier(name: str, holds, lists: Column) -> Column:
    """all, any, none, single over ``holds`` (item -> condition); a null list counts as an empty one."""
    if name == "all":
        return F.forall(lists, holds)
    if name == "any":
        return F.exists(lists, holds)
    if name == "none":
        return ~F.exists(lists, holds)
    sure = F.size(F.filter(lists, holds))
    unsure = F.exists(lists, lambda e: holds(e).isNull())
    return F.when(sure > 1, False).when(unsure, None).otherwise(sure == 1)


def literal(value) -> tuple[Column, object]:
    if value is None:
        return F.lit(None), "null"
    if isinstance(value, bool):
        return F.lit(value), "bool"
    if isinstance(value, int):
        return F.lit(value).cast("bigint"), "int"
    if isinstance(value, float):
        return F.lit(value), "float"
    if isinstance(value, str):
        return F.lit(value), "str"
    if isinstance(value, (list, tuple)):
        return make_list([literal(v) for v in value])
    if isinstance(value, dict):
        made = {k: literal(v) for k, v in value.items()}
        return make_map(made)
    raise QueryError("InvalidArgumentType", type(value).__name__)


def make_list(items: list) -> tuple[Column, object]:
    t = "null"
    for i in items:
        t = merge_types(t, i[1])
    if not items:
        return F.array().cast("array<string>"), ("list", "null")
    return F.array(*(cast_to(i, t) for i in items)), ("list", t)


def make_map(items: dict) -> tuple[Column, object]:
    if not items:
        return F.struct(F.lit(None).cast("string").alias("_")), ("map", ())
    return F.struct(*(v[0].alias(k) for k, v in items.items())), ("map", tuple((k, v[1]) for k, v in items.items()))


def order_key(value, down: bool) -> list:
    """Sort columns of a value; null is the largest."""
    x, t = value
    x = x["_id"] if kind(t) in ENTITIES else x
    return [x.desc_nulls_first() if down else x.asc_nulls_last()]



def shown(value) -> tuple[Column, object]:
    """As a result has it: values of unlike kinds in one column, and what Spark has no type for, are text there."""
    x, t = value
    if t in TEXT:
        return to_string(value)
    if kind(t) == "list" and t[1] in TEXT:
        return F.transform(x, lambda e: to_string((e, t[1]))[0]), ("list", "str")
    return value
