"""Small graphs, queries as text, rows by hand."""

import pytest
from pyspark.sql import Row

from graphweft.errors import QueryError
from graphweft.session import GraphSession
from graphweft.sources.graph import empty


def rows(df):
    def plain(v):
        if isinstance(v, Row):
            return {k: plain(x) for k, x in v.asDict().items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return [tuple(plain(v) for v in r) for r in df.collect()]


def people(spark, edges, n=5):
    g = empty(spark).add_nodes("Person", spark.createDataFrame([(i, f"name{i}", 20 + i) for i in range(1, n + 1)], "id long, name string, age long"), "id")
    g = g.add_nodes("City", spark.createDataFrame([(9, "x")], "id long, name string"), "id")
    for t in sorted({e[2] for e in edges}):
        g = g.add_edges(t, spark.createDataFrame([(k, a, b, k * 10) for k, (a, b, x) in enumerate(edges, 1) if x == t], "k long, a long, b long, w long"), ("Person", "a"), ("Person", "b"), ("w",), "k")
    return GraphSession(spark, g)


MIXED = [(1, 2, "KNOWS"), (1, 3, "KNOWS"), (1, 4, "LIVES_IN"), (1, 5, "LIVES_IN")]
TRIANGLE = [(1, 2, "KNOWS"), (2, 3, "KNOWS"), (3, 1, "KNOWS")]
DIAMOND = [(1, 2, "KNOWS"), (2, 4, "KNOWS"), (1, 3, "KNOWS"), (3, 4, "KNOWS")]


@pytest.fixture(scope="module")
def mixed(spark):
    return people(spark, MIXED)


CASES = [
    ("RETURN 1 IN ['1', 2] AS a, '1' IN ['1', 2] AS b, 3 IN [1, null, 'x'] AS c, [1, 'a'] = ['1', 'a'] AS d, [1, 'a'] = [1, 'a'] AS e", [(False, True, None, False, True)]),
    ("UNWIND [10, 9, 'z', true, 2.5, null] AS x RETURN x ORDER BY x", [("z",), ("true",), ("2.5",), ("9",), ("10",), (None,)]),
    ("UNWIND [1, 'a', 2] AS x RETURN max(x) AS a, min(x) AS b", [("2", "a")]),
    ("RETURN [1, 'a'][0] + 1 AS a, [1, 'a'][1] + 1 AS b, toInteger(['7', 2][0]) AS c, size(['abc', 2][0]) AS d", [("2", "a1", 7, 3)]),
    ("UNWIND [1, 1, 1, 1, 5, 9] AS x RETURN percentileDisc(x, 0.5) AS a, percentileDisc(DISTINCT x, 0.5) AS b, percentileCont(DISTINCT x, 0.5) AS c", [(1, 5, 5.0)]),
    ("MATCH (a:Person)-[:KNOWS]->(b) WHERE EXISTS { (a)-[:LIVES_IN]->(c) WHERE c.id > b.id } RETURN b.id AS b ORDER BY b", [(2,), (3,)]),
    ("MATCH (a:Person {id: 2}) OPTIONAL MATCH (a)-[:LIVES_IN]->(b) OPTIONAL MATCH (b)<-[:KNOWS]-(c) RETURN a.id AS a, b.id AS b, c.id AS c", [(2, None, None)]),
    ("MATCH (a)-[:KNOWS*1..2]->(b:City) RETURN b.id AS b", []),
    ("RETURN toString(localtime('12:31:14.645876123')) AS a, toString(time('12:31:14-0130')) AS b, time('10:00+01:00') = time('09:00Z') AS c, toString(localtime('23:00') + duration('PT2H')) AS d", [("12:31:14.645876123", "12:31:14-01:30", True, "01:00")]),
    ("RETURN toString(datetime('2015-07-21T21:40:32.142+0100')) AS a, toString(datetime('2015-07-21T21:40[Europe/Stockholm]')) AS b, toString(date.truncate('month', date('2020-05-20'), {day: 5})) AS c", [("2015-07-21T21:40:32.142+01:00", "2015-07-21T21:40+02:00[Europe/Stockholm]", "2020-05-05")]),
    ("MATCH (a:Person)-[:KNOWS]->(b) RETURN b.name AS n ORDER BY n", [("name2",), ("name3",)]),
    ("MATCH (a)-[r]->(b) RETURN type(r) AS t, count(*) AS n ORDER BY t", [("KNOWS", 2), ("LIVES_IN", 2)]),
    ("MATCH (a {id: 2})--(b) RETURN b.id AS b", [(1,)]),
    ("MATCH (n) RETURN count(n) AS n", [(6,)]),
    ("MATCH (n:Person:City) RETURN n.name AS n", []),
    ("MATCH (n:Nope) RETURN count(*) AS n, sum(n.x) AS s, collect(n.x) AS c", [(0, 0, [])]),
    ("MATCH (a)-[r1]->(b), (a)-[r2]->(c) RETURN count(*) AS n", [(12,)]),
    ("MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE b.id > 2 RETURN a.id AS a, b.id AS b ORDER BY a", [(1, 3), (2, None), (3, None), (4, None), (5, None)]),
    ("MATCH (a:Person) WHERE (a)-[:KNOWS]->() RETURN a.id AS a", [(1,)]),
    ("MATCH (a:Person) WHERE NOT EXISTS { (a)<-[:KNOWS]-(b) } RETURN count(*) AS n", [(3,)]),
    ("MATCH (a:Person) WHERE EXISTS { MATCH (a)<-[:KNOWS]-(b) WHERE b.age < 30 RETURN b } OR a.id = 5 RETURN a.id AS a ORDER BY a", [(2,), (3,), (5,)]),
    ("MATCH (a:Person) RETURN a.id AS a, size([(a)-[:KNOWS]->(b) | b.name]) AS n ORDER BY n DESC, a LIMIT 2", [(1, 2), (2, 0)]),
    ("MATCH (a:Person {id: 1}) RETURN [(a)-[:KNOWS]->(b) WHERE b.id = 3 | b.name] AS l", [(["name3"],)]),
    ("MATCH (a:Person) WITH a.age AS age WHERE age > 22 RETURN min(age) AS lo, max(age) AS hi, avg(age) AS m, count(DISTINCT age) AS n", [(23, 25, 24.0, 3)]),
    ("UNWIND [1, 2, null] AS x RETURN x, x IS NULL AS z ORDER BY x", [(1, False), (2, False), (None, True)]),
    ("UNWIND [3, 1, null] AS x RETURN x ORDER BY x DESC", [(None,), (3,), (1,)]),
    ("UNWIND [] AS x RETURN x", []),
    ("UNWIND [true, false, null] AS a UNWIND [true, null] AS b RETURN a XOR b AS x, a AND b AS y, a OR b AS z", [(False, True, True), (None, None, True), (True, False, True), (None, False, None), (None, None, True), (None, None, None)]),
    ("RETURN 7 / 2 AS a, -7 / 2 AS b, 7 % -3 AS c, 1 / 0 AS d, 2 ^ 3 AS e, 7.0 / 2 AS f", [(3, -3, 1, None, 8.0, 3.5)]),
    ("RETURN 1 IN [1, null] AS a, 2 IN [1, null] AS b, null IN [] AS c, 1 < 2 < 3 AS d, 'a' < 1 AS e", [(True, None, False, True, None)]),
    ("RETURN [1, 2] + 3 AS a, 0 + [1] AS b, [1, 2, 3][-1] AS c, [1, 2, 3][5] AS d, [1, 2, 3][0..2] AS e, [1, 2, 3][..-1] AS f", [([1, 2, 3], [0, 1], 3, None, [1, 2], [1, 2])]),
    ("RETURN [x IN range(1, 5) WHERE x % 2 = 1 | x * 10] AS a, [x IN null | x] AS b, all(x IN [] WHERE x > 1) AS c, single(x IN [1, 2] WHERE x = 1) AS d, none(x IN [1] WHERE x = 1) AS e, any(x IN [null] WHERE x = 1) AS f", [([10, 30, 50], [], True, True, False, None)]),
    ("RETURN CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS a, CASE WHEN null THEN 1 ELSE 0 END AS b", [("b", 0)]),
    ("RETURN toInteger('1.7') AS a, toFloat('x') AS b, toBoolean('true') AS c, toString(12) AS d, coalesce(null, 3) AS e, toInteger(true) AS f", [(1, None, True, "12", 3, 1)]),
    ("RETURN substring('hello', 1, 2) AS a, split('a.b', '.') AS b, replace('aaa', 'a', 'b') AS c, left('abc', 2) AS d, trim(' x ') AS e, reverse('ab') AS f, toUpper('x') AS g, size('abc') AS h", [("el", ["a", "b"], "bbb", "ab", "x", "ba", "X", 3)]),
    ("RETURN head([1, 2]) AS a, last([1, 2]) AS b, tail([1, 2]) AS c, range(5, 1) AS d, range(5, 1, -2) AS e, abs(-2) AS f, sign(-3.5) AS g, sqrt(4) AS h, ceil(1.2) AS i", [(1, 2, [2], [], [5, 3, 1], 2, -1, 2.0, 2.0)]),
    ("RETURN {a: 1, b: 'x'}.a AS a, {a: 1}['a'] AS b, keys({a: 1, b: null}) AS c, 0x1F AS d, 0o17 AS e, 1_000 AS f", [(1, 1, ["a"], 31, 15, 1000)]),
    ("WITH 1 AS a UNION WITH 1 AS a RETURN a", QueryError),
    ("RETURN 1 AS a UNION ALL RETURN 1 AS a", [(1,), (1,)]),
    ("RETURN 1 AS a UNION RETURN 1 AS a", [(1,)]),
    ("MATCH (a:Person) RETURN DISTINCT a.age > 23 AS old ORDER BY old", [(False,), (True,)]),
    ("MATCH (a:Person) RETURN a.id AS i ORDER BY a.age DESC SKIP 1 LIMIT 2", [(4,), (3,)]),
    ("MATCH (a:Person)-[:KNOWS]->(b) RETURN a.name AS n, count(b) + 3 AS c, size(collect(b.id)) AS s", [("name1", 5, 2)]),
    ("MATCH (a:Person) RETURN percentileDisc(a.age, 0.5) AS d, percentileCont(a.age, 0.25) AS c", [(23, 22.0)]),
    ("MATCH p = (a {id: 1})-[:KNOWS]->(b {id: 2}) RETURN length(p) AS n, [x IN nodes(p) | x.id] AS ids, [r IN relationships(p) | r.w] AS w", [(1, [1, 2], [10])]),
    ("MATCH (a {id: 1})-[r:KNOWS]->(b {id: 2}) RETURN startNode(r).id AS s, endNode(r).name AS e, labels(b) AS l, keys(r) AS k, r.w AS w", [(1, "name2", ["Person"], ["w"], 10)]),
    ("MATCH (a:Person)-[r]->(b) WITH a, collect(b) AS bs UNWIND bs AS b WITH b WHERE b:Person RETURN count(b.name) AS n", [(4,)]),
    ("RETURN date('2024-01-31') + duration('P1M') AS a, date({year: 2020, month: 2}).ordinalDay AS b, duration.between(date('2020-01-01'), date('2021-03-04')).months AS c, toString(duration('P1Y2M3DT4H')) AS d", None),
]


@pytest.mark.parametrize("text,want", CASES, ids=[c[0][:60] for c in CASES])
def test_query(mixed, text, want):
    if want is QueryError:
        with pytest.raises(QueryError):
            mixed.run(text)
        return
    got = rows(mixed.run(text))
    if want is None:
        assert len(got) == 1
    elif "ORDER BY" in text:
        assert got == want
    else:
        assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(
    "edges,pattern,n",
    [([(1, 1, "KNOWS")], "*1", 1), (TRIANGLE, "*1..3", 9), (TRIANGLE, "*4", 0), (TRIANGLE, "*", 9), (TRIANGLE, "*0..1", 9 - 1), (DIAMOND, "*1..2", 6)],
)
def test_walks(spark, edges, pattern, n):
    assert rows(people(spark, edges).run(f"MATCH (a)-[:KNOWS{pattern}]->(b) WHERE a:Person AND b:Person RETURN count(*) AS n")) == [(n if pattern != "*0..1" else 3 + 5,)]


def test_walk_paths_and_lists(spark):
    s = people(spark, DIAMOND)
    got = rows(s.run("MATCH p = (a {id: 1})-[e:KNOWS*2]->(b {id: 4}) RETURN [x IN nodes(p) | x.id] AS n, [x IN e | x.w] AS w"))
    assert sorted(got) == [([1, 2, 4], [10, 20]), ([1, 3, 4], [30, 40])]
    got = rows(s.run("MATCH p = (a)-[:KNOWS*1..2 {w: 10}]->(b) RETURN [x IN nodes(p) | x.id] AS n"))
    assert got == [([1, 2],)]
    got = rows(s.run("MATCH (b {id: 4}) MATCH p = (a {id: 1})-[:KNOWS*2]->(b) RETURN [x IN nodes(p) | x.id] AS n, length(p) AS l"))
    assert sorted(got) == [([1, 2, 4], 2), ([1, 3, 4], 2)]


@pytest.mark.parametrize(
    "text,code",
    [
        ("RETURN x", "UndefinedVariable"), ("RETURN 1 AS a, 2 AS a", "ColumnNameConflict"), ("MATCH (n) WITH n.name RETURN 1", "NoExpressionAlias"), ("RETURN 1 LIMIT -1", "NegativeIntegerArgument"),
        ("RETURN foo(1)", "UnknownFunction"), ("MATCH (n) WHERE count(n) > 1 RETURN n", "InvalidAggregation"), ("RETURN count(count(1))", "NestedAggregation"), ("RETURN 1 AS a UNION RETURN 2 AS b", "DifferentColumnsInUnion"),
        ("RETURN *", "NoVariablesInScope"), ("MATCH (n", "SyntaxError"), ("CALL nope()", "ProcedureNotFound"), ("MATCH (a) WHERE (a)-->(zz) RETURN a", "UndefinedVariable"), ("RETURN 1 AND true", "InvalidArgumentType"), ("CREATE ()-[:A]-()", "RequiresDirectedRelationship"), ("MATCH (n:Person) DELETE n", "DeleteConnectedNode"),
    ],
)
def test_errors(mixed, text, code):
    with pytest.raises(QueryError) as e:
        mixed.run(text)
    assert e.value.code == code


def test_updates(spark):
    s = people(spark, MIXED)
    assert rows(s.run("CREATE (a:Dog {name: 'rex'})-[:BITES {hard: true}]->(b:Cat {lives: 9}) RETURN a.name AS n, b.lives AS l")) == [("rex", 9)]
    assert rows(s.run("MATCH (:Dog)-[r:BITES]->(c:Cat) RETURN r.hard AS h, c.lives AS l")) == [(True, 9)]
    s.run("MATCH (p:Person) WHERE p.id < 3 SET p.seen = true, p.age = p.age + 1, p:Seen")
    assert rows(s.run("MATCH (p:Seen) RETURN p.id AS i, p.age AS a, p.seen AS s ORDER BY i")) == [(1, 22, True), (2, 23, True)]
    s.run("MATCH (p:Seen {id: 1}) REMOVE p.age, p:Seen")
    assert rows(s.run("MATCH (p:Person {id: 1}) RETURN p.age AS a, labels(p) AS l")) == [(None, ["Person"])]
    s.run("MATCH (p:Person {id: 2}) SET p = {id: 2, x: 'y'}")
    assert rows(s.run("MATCH (p:Person {id: 2}) RETURN p.name AS n, p.x AS x")) == [(None, "y")]
    got = rows(s.run("UNWIND [1, 1, 2] AS k MERGE (t:Tag {k: k}) ON CREATE SET t.new = true RETURN t.k AS k"))
    assert sorted(got) == [(1,), (1,), (2,)]
    assert rows(s.run("MERGE (t:Tag {k: 1}) ON MATCH SET t.met = 5 RETURN t.met AS m")) == [(5,)]
    assert rows(s.run("MATCH (t:Tag) RETURN count(*) AS n, count(t.new) AS c")) == [(2, 2)]
    s.run("MATCH (a:Person), (t:Tag {k: 2}) WHERE a.id > 3 MERGE (a)-[:HAS]->(t)")
    s.run("MATCH (a:Person), (t:Tag {k: 2}) WHERE a.id > 2 MERGE (a)-[:HAS]->(t)")
    assert rows(s.run("MATCH (a)-[:HAS]->(t) RETURN count(*) AS n")) == [(3,)]
    s.run("MATCH (p:Person {id: 1})-[r:LIVES_IN]->() DELETE r")
    assert rows(s.run("MATCH ()-[r:LIVES_IN]->() RETURN count(r) AS n")) == [(0,)]
    s.run("MATCH (p:Person {id: 1}) DETACH DELETE p")
    assert rows(s.run("MATCH (p:Person) RETURN count(*) AS n")) == [(4,)]
    assert rows(s.run("MATCH ()-[r:KNOWS]->() RETURN count(r) AS n")) == [(0,)]


KINDS = [
    ("MATCH (a:Person)-[r:KNOWS|IN]->(x) RETURN type(r) AS t, labels(x)[0] AS l, count(*) AS n, count(a) AS c, count(DISTINCT x) AS d", [("IN", "City", 2, 2, 1), ("KNOWS", "Person", 2, 2, 2)]),
    ("MATCH (a)-[r]->(x) RETURN labels(x) AS x, labels(a) AS a, count(*) AS n", [(["City"], ["Person"], 2), (["Person"], ["Person"], 2)]),
    ("MATCH (x)-[r]-(a) RETURN labels(x)[0] AS x, labels(a)[0] AS a, count(DISTINCT id(x)) AS n", [("City", "Person", 1), ("Person", "City", 2), ("Person", "Person", 3)]),
    ("MATCH (a)-[:KNOWS]->(b)-[:KNOWS|IN]->(x) RETURN labels(x)[0] AS l, count(*) AS n", [("City", 1), ("Person", 1)]),
    ("MATCH (a)-[:KNOWS|IN]->(x) WHERE x:City RETURN count(a) AS n", [(2,)]),
    ("MATCH (a)-[:KNOWS|IN]->(x) WHERE EXISTS { (x)-[:IN]->(:City) } RETURN count(*) AS n", [(1,)]),
    ("MATCH (c:City) MATCH (a)-[:KNOWS|IN]->(x) RETURN c.id AS c, labels(x)[0] AS l, count(*) AS n", [(8, "City", 2), (8, "Person", 2), (9, "City", 2), (9, "Person", 2)]),
    ("MATCH (a)-[:KNOWS|IN]->(a) RETURN count(*) AS n", [(0,)]),
    ("MATCH (a:City)-[r:KNOWS]->(x) RETURN count(*) AS n", [(0,)]),
]


@pytest.mark.parametrize("text,want", KINDS)
def test_ends_of_several_kinds(spark, text, want):
    """Ends of which only the identity is read come from the edges, each row with its own labels; an edge without one matches nothing."""
    g = empty(spark).add_nodes("Person", spark.createDataFrame([(1,), (2,), (3,)], "id long"), "id").add_nodes("City", spark.createDataFrame([(8,), (9,)], "id long"), "id")
    g = g.add_edges("KNOWS", spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, None, 3), (4, 3, None)], "k long, a long, b long"), ("Person", "a"), ("Person", "b"), key="k")
    g = g.add_edges("IN", spark.createDataFrame([(1, 1, 9), (2, 2, 9), (3, None, 9)], "k long, a long, b long"), ("Person", "a"), ("City", "b"), key="k")
    assert sorted(rows(GraphSession(spark, g).run(text)), key=repr) == sorted(want, key=repr)


def test_ends_after_labels_change(spark):
    """Once some nodes of a kind have other labels, edges to that kind no longer say which labels an end has."""
    s = people(spark, MIXED)
    s.run("MATCH (p:Person {id: 2}) SET p:Seen")
    s.run("MATCH (p:Person {id: 4}) REMOVE p:Person")
    assert sorted(rows(s.run("MATCH (a)-[:KNOWS]->(x) RETURN labels(x) AS l, count(*) AS n"))) == [(["Person"], 1), (["Person", "Seen"], 1)]
    assert rows(s.run("MATCH (a:Person)-[:LIVES_IN]->(x:Person) RETURN count(*) AS n")) == [(1,)]
    assert rows(s.run("MATCH (x:Person)<-[:LIVES_IN]-(a) RETURN count(*) AS n")) == [(1,)]


def test_catalogue(mixed):
    assert rows(mixed.run("CALL db.labels() YIELD label AS l RETURN l ORDER BY l")) == [("City",), ("Person",)]
    assert ("age",) in rows(mixed.run("CALL db.propertyKeys()"))
    assert rows(mixed.run("CREATE UNIQUE INDEX pid FOR (p:Person) ON (p.id)")) == [("pid", "Person", "id", True, "PUBLIC")]
    assert len(rows(mixed.run("SHOW INDEXES"))) == 1
    mixed.run("DROP INDEX pid")
    mixed.run("CREATE DATABASE other")
    mixed.run("USE other")
    assert rows(mixed.run("MATCH (n) RETURN count(*) AS n")) == [(0,)]
    mixed.run("USE default")
    assert any("Join" in r[0] or "Scan" in r[0] or "Filter" in r[0] for r in rows(mixed.run("EXPLAIN MATCH (a)-[:KNOWS]->(b) WHERE a.age > 1 RETURN b.name")))
    assert rows(mixed.run("MATCH (n:Person {id: $i}) RETURN n.name AS n", {"i": 2})) == [("name2",)]
