"""Registered graph queries over the driver's tables, with their SQL twins.

``CASES`` maps a name to (query text, SQL); the graph over the tables is declared in ``star_graph``. Queries that the SQL check
can't express have None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.session import GraphSession
from graphweft.sources.graph import Graph, empty

FLAGSHIP = "flagship"


def star_graph(spark: SparkSession, d: str) -> Graph:
    """The tables of folder ``d`` as one property graph; nothing is read until a query needs it."""
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")}
    talk = t["conversations"].withColumn("m_id", F.col("conv_id") * 1000 + F.col("turn")).withColumn("m_next", F.col("m_id") + 1)
    g = empty(spark)
    for label, name, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Event", "events", "event_id")):
        g = g.add_nodes(label, t[name], key)
    g = g.add_nodes("User", t["events"].select("user_id").distinct(), "user_id")
    g = g.add_nodes("Message", talk.select("m_id", "conv_id", "turn", "role", "text"), "m_id")
    docs = t["documents"].select("doc_id", "lang", "source", "n_chars").join(t["labels"].select(F.col("doc_id").alias("l_doc"), "quality", "toxic"), F.col("doc_id") == F.col("l_doc"), "left").drop("l_doc")
    g = g.add_nodes("Document", docs, "doc_id")
    g = g.add_edges("IN_REGION", t["nation"], ("Nation", "n_nationkey"), ("Region", "n_regionkey"), key="n_nationkey", holds="_src")
    g = g.add_edges("FROM", t["customer"], ("Customer", "c_custkey"), ("Nation", "c_nationkey"), key="c_custkey", holds="_src")
    g = g.add_edges("FROM", t["supplier"], ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), key="s_suppkey", holds="_src")
    g = g.add_edges("PLACED", t["orders"], ("Customer", "o_custkey"), ("Order", "o_orderkey"), key="o_orderkey", holds="_dst")
    line = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    g = g.add_edges("CONTAINS", t["lineitem"], ("Order", "l_orderkey"), ("Part", "l_partkey"), line)
    g = g.add_edges("SHIPPED_BY", t["lineitem"], ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), line)
    g = g.add_edges("DID", t["events"], ("User", "user_id"), ("Event", "event_id"), key="event_id", holds="_dst")
    nxt = talk.select("m_id", "m_next").join(talk.select(F.col("m_id").alias("to")), F.col("m_next") == F.col("to"))
    g = g.add_edges("NEXT", nxt, ("Message", "m_id"), ("Message", "m_next"), key="m_id")
    n = t["customer"].agg(F.count(F.lit(1)).alias("n"))  # one row
    refer = t["customer"].select(F.col("c_custkey").alias("a")).crossJoin(F.broadcast(n)).select("a", ((F.col("a") * 7 + 1) % F.col("n")).alias("b"))
    return g.add_edges("REFERRED", refer, ("Customer", "a"), ("Customer", "b"), key="a")


LINES = "SELECT DISTINCT * FROM lineitem"
NEXT = "next(a, b) AS (SELECT x.conv_id * 1000 + x.turn, y.conv_id * 1000 + y.turn FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"
WALK = "WITH RECURSIVE " + NEXT + ", w(a, b, n) AS (SELECT a, b, 1 FROM next UNION ALL SELECT w.a, next.b, n + 1 FROM w JOIN next ON w.b = next.a WHERE n < {most})"

REFERRED = "e(a, b) AS (SELECT c_custkey, (c_custkey * 7 + 1) % (SELECT count(*) FROM customer) FROM customer)"

CASES: dict[str, tuple[str, str | None]] = {
    "flagship": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS seg, count(*) AS n ORDER BY n DESC, seg LIMIT 5",
        "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY n DESC, seg LIMIT 5",
    ),
    "scan_label": ("MATCH (c:Customer) RETURN c.c_name AS name, c.c_acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer"),
    "scan_all_count": ("MATCH (n) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM conversations) + (SELECT count(*) FROM documents) AS n"),
    "scan_multi_label": ("MATCH (n:Customer:Supplier) RETURN count(*) AS n", "SELECT 0::BIGINT AS n"),
    "index_range_scan": ("MATCH (o:Order) WHERE o.o_orderkey >= 100 AND o.o_orderkey < 200 RETURN o.o_orderkey AS k, o.o_totalprice AS p", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200"),
    "edge_index_scan": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.l_quantity >= 49 RETURN count(*) AS n, sum(r.l_extendedprice) AS s", f"SELECT count(*) AS n, sum(l_extendedprice) AS s FROM ({LINES}) WHERE l_quantity >= 49"),
    "filter_compound": ("MATCH (o:Order) WHERE o.o_totalprice > 1e5 AND o.o_orderstatus IN ['F', 'O'] RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 1e5 AND o_orderstatus IN ('F', 'O')"),
    "string_preds": ("MATCH (p:Part) WHERE p.p_name STARTS WITH 'p' OR p.p_type ENDS WITH 'L' OR p.p_brand CONTAINS '3' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE starts_with(p_name, 'p') OR ends_with(p_type, 'L') OR contains(p_brand, '3')"),
    "null_logic": ("UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS x, a OR b AS y, a XOR b AS z, NOT a AS na", "SELECT a, b, a AND b AS x, a OR b AS y, xor(a::INT, b::INT)::BOOLEAN AS z, NOT a AS na FROM (VALUES (true), (false), (null)) p(a), (VALUES (true), (false), (null)) q(b)"),
    "case_simple": ("MATCH (p:Part) RETURN p.p_partkey AS k, CASE p.p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS s", "SELECT p_partkey AS k, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS s FROM part"),
    "case_searched": ("MATCH (p:Part) RETURN p.p_partkey AS k, CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'medium' END AS s", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS s FROM part"),
    "expand_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_name AS name, o.o_orderkey AS k", "SELECT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey"),
    "expand_in": ("MATCH (n:Nation)<-[:FROM]-(s:Supplier) RETURN n.n_name AS name, s.s_name AS s", "SELECT n_name AS name, s_name AS s FROM nation JOIN supplier ON n_nationkey = s_nationkey"),
    "expand_both": ("MATCH (a:Customer)-[:REFERRED]-(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", f"WITH {REFERRED} SELECT a, b FROM e JOIN customer y ON b = y.c_custkey UNION ALL SELECT b, a FROM e JOIN customer y ON b = y.c_custkey WHERE a <> b"),
    "expand_multi_type": ("MATCH (o:Order)-[r:CONTAINS|SHIPPED_BY]->(x) RETURN type(r) AS t, labels(x)[0] AS l, count(*) AS n", f"SELECT 'CONTAINS' AS t, 'Part' AS l, count(*) AS n FROM ({LINES}) UNION ALL SELECT 'SHIPPED_BY', 'Supplier', count(*) FROM ({LINES})"),
    "three_hop": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:FROM]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, count(*) AS n, max(o.o_totalprice) AS top", "SELECT r_name AS region, count(*) AS n, max(o_totalprice) AS top FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "multi_part_match": ("MATCH (c:Customer)-[:PLACED]->(o:Order), (c)-[:FROM]->(n:Nation) RETURN n.n_name AS name, count(o) AS n", "SELECT n_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "cross_product": ("MATCH (a:Region), (b:Nation) RETURN a.r_name AS a, b.n_name AS b", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "expand_into": ("MATCH (c:Customer)-[:FROM]->(n:Nation)<-[:FROM]-(s:Supplier), (c)-[:PLACED]->(o:Order)-[:SHIPPED_BY]->(s) RETURN count(*) AS n", f"SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN orders ON o_custkey = c_custkey JOIN ({LINES}) ON l_orderkey = o_orderkey AND l_suppkey = s_suppkey"),
    "rel_uniqueness": ("MATCH (p1:Part)<-[r1:CONTAINS]-(o:Order)-[r2:CONTAINS]->(p2:Part) RETURN o.o_orderkey AS k, count(*) AS n", f"WITH l AS ({LINES}), c AS (SELECT l_orderkey AS k, count(*) AS m FROM l GROUP BY 1) SELECT k, m * (m - 1) AS n FROM c WHERE m > 1"),
    "varlen_bounded": ("MATCH (m:Message)-[:NEXT*1..3]->(k:Message) RETURN m.conv_id AS c, m.turn AS t, k.turn AS u", WALK.format(most=3) + " SELECT a // 1000 AS c, a % 1000 AS t, b % 1000 AS u FROM w"),
    "varlen_zero": ("MATCH (m:Message)-[:NEXT*0..1]->(k:Message) RETURN m.conv_id AS c, m.turn AS t, k.turn AS u", WALK.format(most=1) + " SELECT a // 1000 AS c, a % 1000 AS t, b % 1000 AS u FROM w UNION ALL SELECT conv_id, turn, turn FROM conversations"),
    "varlen_exact": ("MATCH (m:Message)-[:NEXT*2]->(k:Message) RETURN m.conv_id AS c, m.turn AS t, k.role AS r", WALK.format(most=2) + " SELECT a // 1000 AS c, a % 1000 AS t, role AS r FROM w JOIN conversations ON conv_id * 1000 + turn = b WHERE n = 2"),
    "varlen_unbounded": ("MATCH (m:Message)-[:NEXT*]->(k:Message) RETURN m.conv_id AS c, count(*) AS n", WALK.format(most=100) + " SELECT a // 1000 AS c, count(*) AS n FROM w GROUP BY 1"),
    "varlen_cycle_trail": ("MATCH (c:Customer)-[:REFERRED*1..4]->(d:Customer) RETURN c.c_custkey AS c, d.c_custkey AS d", f"WITH RECURSIVE {REFERRED}, w(s, b, used) AS (SELECT a, b, [a] FROM e UNION ALL SELECT s, e.b, list_append(used, e.a) FROM w JOIN e ON w.b = e.a WHERE len(used) < 4 AND NOT list_contains(used, e.a)) SELECT s AS c, b AS d FROM w JOIN customer ON c_custkey = b"),
    "path_functions": ("MATCH p = (m:Message)-[:NEXT*1..2]->(k:Message) RETURN m.conv_id AS c, m.turn AS t, length(p) AS n, size([x IN nodes(p) WHERE x.role = 'user']) AS u", "SELECT * FROM (" + WALK.format(most=2) + " SELECT a // 1000 AS c, a % 1000 AS t, n, (SELECT count(*) FROM conversations v WHERE v.conv_id = a // 1000 AND v.turn BETWEEN a % 1000 AND b % 1000 AND v.role = 'user') AS u FROM w)"),
    "path_quantifiers": ("MATCH p = (m:Message)-[:NEXT*2]->(k:Message) RETURN m.conv_id AS c, m.turn AS t, all(x IN nodes(p) WHERE x.turn >= 1) AS a, any(x IN nodes(p) WHERE x.role = 'user') AS b, none(x IN nodes(p) WHERE x.turn = 2) AS d, single(x IN nodes(p) WHERE x.role = 'user') AS e", "SELECT c, t, t >= 1 AS a, u > 0 AS b, NOT (2 BETWEEN t AND t + 2) AS d, u = 1 AS e FROM (" + WALK.format(most=2) + " SELECT a // 1000 AS c, a % 1000 AS t, (SELECT count(*) FROM conversations v WHERE v.conv_id = a // 1000 AND v.turn BETWEEN a % 1000 AND b % 1000 AND v.role = 'user') AS u FROM w WHERE n = 2)"),
    "optional_match": ("MATCH (o:Order) OPTIONAL MATCH (o)-[:CONTAINS]->(p:Part) RETURN o.o_orderkey AS k, count(p) AS n", f"SELECT o_orderkey AS k, count(l_partkey) AS n FROM orders LEFT JOIN ({LINES}) ON l_orderkey = o_orderkey GROUP BY 1"),
    "optional_where": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 RETURN c.c_custkey AS c, o.o_orderkey AS k", "SELECT c_custkey AS c, o_orderkey AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000"),
    "exists_semi": ("MATCH (o:Order) WHERE EXISTS { (o)-[r:CONTAINS]->(:Part) WHERE r.l_quantity > 45 } RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"),
    "not_exists_anti": ("MATCH (o:Order) WHERE NOT EXISTS { (o)-[:CONTAINS]->() } RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "exists_or": ("MATCH (o:Order) WHERE NOT EXISTS { (o)-[:CONTAINS]->() } OR EXISTS { (o)<-[:PLACED]-(c:Customer) WHERE c.c_acctbal < 0 } RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)"),
    "exists_full": ("MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > c.c_acctbal * 40 RETURN o } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)"),
    "pattern_predicate": ("MATCH (c:Customer) WHERE (c)-[:PLACED]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "pattern_comprehension": ("MATCH (c:Customer) RETURN c.c_custkey AS c, size([(c)-[:PLACED]->(o) WHERE o.o_totalprice > 100000 | o.o_orderkey]) AS n", "SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS n FROM customer"),
    "correlated_match": ("MATCH (n:Nation) WHERE n.n_nationkey < 5 WITH n MATCH (n)<-[:FROM]-(c:Customer) RETURN n.n_name AS name, count(*) AS n", "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey < 5 GROUP BY 1"),
    "group_agg": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) AS n, min(o.o_totalprice) AS lo, max(o.o_totalprice) AS hi, round_(avg(o.o_totalprice)) AS m", "SELECT o_orderstatus AS s, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS m FROM orders GROUP BY 1"),
    "global_agg_empty": ("MATCH (n:Missing) RETURN count(*) AS n, sum(n.x) AS s, avg(n.x) AS a, size(collect(n.x)) AS c", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, NULL::DOUBLE AS a, 0::BIGINT AS c"),
    "agg_distinct": ("MATCH (e:Event) RETURN e.event_type AS t, count(DISTINCT e.user_id) AS u", "SELECT event_type AS t, count(DISTINCT user_id) AS u FROM events GROUP BY 1"),
    "agg_expr": ("MATCH (e:Event) RETURN e.event_type AS t, count(*) + 3 AS n, size(collect(e.event_id)) AS s", "SELECT event_type AS t, count(*) + 3 AS n, count(*) AS s FROM events GROUP BY 1"),
    "percentile_disc": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, percentileDisc(o.o_orderkey, 0.5) AS p", "SELECT o_orderstatus AS s, quantile_disc(o_orderkey, 0.5) AS p FROM orders GROUP BY 1"),
    "percentile_cont": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, round_(percentileCont(o.o_totalprice, 0.25)) AS p", "SELECT o_orderstatus AS s, round(quantile_cont(o_totalprice, 0.25), 4) AS p FROM orders GROUP BY 1"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c.c_custkey AS c, count(o) AS n WHERE n > 12 RETURN c, n", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "with_chain": ("MATCH (o:Order) WITH o.o_custkey AS c, count(*) AS n WITH n, count(*) AS f RETURN n, f", "SELECT n, count(*) AS f FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n"),
    "distinct": ("MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS s, c.c_nationkey AS n", "SELECT DISTINCT c_mktsegment AS s, c_nationkey::BIGINT AS n FROM customer"),
    "order_skip_limit": ("MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY c.c_name DESC SKIP 5 LIMIT 10", "SELECT c_custkey AS k FROM customer ORDER BY c_name DESC LIMIT 10 OFFSET 5"),
    "topk": ("MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice DESC, k LIMIT 10", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, k LIMIT 10"),
    "null_order": ("MATCH (d:Document) RETURN d.doc_id AS k ORDER BY d.quality, k DESC LIMIT 20", "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality NULLS LAST, k DESC LIMIT 20"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "unwind_nested": ("UNWIND range(1, 5) AS x UNWIND range(x, 5) AS y RETURN x, y, x * y AS z", "SELECT x, y, x * y AS z FROM range(1, 6) p(x), range(1, 6) q(y) WHERE y >= x"),
    "collect_unwind": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, collect(o.o_orderkey) AS ks UNWIND ks AS k RETURN c.c_custkey AS c, k", "SELECT o_custkey AS c, o_orderkey AS k FROM orders"),
    "list_ops": ("UNWIND range(0, 4) AS i WITH i, [1, 2, 3] AS l RETURN i, l[i] AS a, size(l[i..]) AS b, i IN l AS c, size(l + i) AS d, head(tail(l)) AS e, last(reverse(l)) AS f", "SELECT i, CASE WHEN i < 3 THEN i + 1 END AS a, greatest(3 - i, 0) AS b, i IN (1, 2, 3) AS c, 4::BIGINT AS d, 2::BIGINT AS e, 1::BIGINT AS f FROM range(0, 5) t(i)"),
    "list_comprehension": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, size([x IN range(1, n.n_nationkey) WHERE x % 3 = 0 | x * 2]) AS s, all(x IN range(1, 3) WHERE x > 0) AS a", "SELECT n_nationkey::BIGINT AS k, (n_nationkey // 3)::BIGINT AS s, true AS a FROM nation"),
    "math_fns": ("MATCH (c:Customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a, ceil(c.c_acctbal) AS b, sign(c.c_acctbal) AS s, c.c_custkey / 7 AS d, c.c_custkey % 7 AS m, c.c_custkey / 0 AS z", "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, sign(c_acctbal)::BIGINT AS s, c_custkey // 7 AS d, c_custkey % 7 AS m, NULL::BIGINT AS z FROM customer"),
    "string_fns": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, toLower(n.n_name) AS a, substring(n.n_name, 1, 3) AS b, left(n.n_name, 2) AS c, right(n.n_name, 2) AS d, reverse(n.n_name) AS e, replace(n.n_name, 'A', 'x') AS f, size(split(n.n_name, 'A')) AS g, size(n.n_name) AS h", "SELECT n_nationkey::BIGINT AS k, lower(n_name) AS a, substr(n_name, 2, 3) AS b, left(n_name, 2) AS c, right(n_name, 2) AS d, reverse(n_name) AS e, replace(n_name, 'A', 'x') AS f, len(string_split(n_name, 'A'))::BIGINT AS g, length(n_name)::BIGINT AS h FROM nation"),
    "conv_fns": ("MATCH (c:Customer) RETURN c.c_custkey AS k, toInteger(c.c_acctbal) AS a, toFloat(c.c_custkey) AS b, toString(c.c_custkey) AS s, toInteger('x') AS x, coalesce(null, c.c_custkey) AS y", "SELECT c_custkey AS k, trunc(c_acctbal)::BIGINT AS a, c_custkey::DOUBLE AS b, c_custkey::VARCHAR AS s, NULL::BIGINT AS x, c_custkey AS y FROM customer"),
    "graph_fns": ("MATCH (c:Customer)-[r:PLACED]->(o:Order) RETURN type(r) AS t, labels(c)[0] AS l, startNode(r).c_custkey AS s, endNode(r).o_orderkey AS e, size(keys(c)) AS k", "SELECT 'PLACED' AS t, 'Customer' AS l, o_custkey AS s, o_orderkey AS e, 5::BIGINT AS k FROM orders"),
    "date_fields": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_orderdate.year AS y, o.o_orderdate.month AS m, o.o_orderdate.day AS d, o.o_orderdate.quarter AS q, o.o_orderdate.week AS w, o.o_orderdate.ordinalDay AS n, o.o_orderdate.weekDay AS wd", "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, weekofyear(o_orderdate) AS w, dayofyear(o_orderdate) AS n, isodow(o_orderdate) AS wd FROM orders"),
    "date_trunc": ("MATCH (o:Order) RETURN date.truncate('month', o.o_orderdate).day AS d, date.truncate('quarter', o.o_orderdate).month AS m, count(*) AS n", "SELECT 1::BIGINT AS d, month(date_trunc('quarter', o_orderdate)) AS m, count(*) AS n FROM orders GROUP BY 2"),
    "duration_add": ("MATCH (o:Order) RETURN o.o_orderkey AS k, toString(date(o.o_orderdate) + duration({months: 1, days: 3})) AS d, toString(date(o.o_orderdate) - duration('P1Y')) AS e", "SELECT o_orderkey AS k, (o_orderdate::DATE + INTERVAL 1 MONTH + INTERVAL 3 DAY)::DATE::VARCHAR AS d, (o_orderdate::DATE - INTERVAL 1 YEAR)::DATE::VARCHAR AS e FROM orders"),
    "duration_between": ("MATCH (o:Order) RETURN o.o_orderkey AS k, duration.inDays(o.o_orderdate, localdatetime('2000-01-01T00:00:00')).days AS d, duration.between(date('1990-01-01'), date(o.o_orderdate)).months AS m", "SELECT o_orderkey AS k, trunc((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate)) / 86400000000)::BIGINT AS d, datesub('month', DATE '1990-01-01', o_orderdate::DATE) AS m FROM orders"),
    "label_predicate": ("MATCH (x)-[:FROM]->(n:Nation) WHERE x:Supplier RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier"),
    "label_cast": ("MATCH (s:Supplier) RETURN s::Supplier.s_name AS n", "SELECT s_name AS n FROM supplier"),
    "params": ("MATCH (o:Order) WHERE o.o_totalprice > $least RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 150000"),
    "return_star": ("MATCH (r:Region) WITH r.r_name AS name, r.r_regionkey AS k RETURN *", "SELECT r_name AS name, r_regionkey::BIGINT AS k FROM region"),
    "proc_labels": ("CALL db.labels()", "SELECT unnest(['Customer', 'Document', 'Event', 'Message', 'Nation', 'Order', 'Part', 'Region', 'Supplier', 'User']) AS label"),
    "proc_types": ("CALL db.relationshipTypes()", "SELECT unnest(['CONTAINS', 'DID', 'FROM', 'IN_REGION', 'NEXT', 'PLACED', 'REFERRED', 'SHIPPED_BY']) AS \"relationshipType\""),
    "proc_property_keys": ("CALL db.propertyKeys() YIELD propertyKey RETURN count(*) > 20 AS ok", "SELECT true AS ok"),
    "map_ops": ("UNWIND range(1, 3) AS i WITH i, {a: i, b: 'x', c: null} AS m RETURN i, m.a AS a, m['b'] AS b, size(keys(m)) AS k, m.c IS NULL AS n", "SELECT i, i AS a, 'x' AS b, 2::BIGINT AS k, true AS n FROM range(1, 4) t(i)"),
    "list_compare": ("UNWIND range(0, 3) AS i RETURN i, [1, i] < [1, 2] AS a, [i] = [1] AS b, i IN [] AS c, [1, 2] + i = [1, 2, 3] AS d", "SELECT i, i < 2 AS a, i = 1 AS b, false AS c, i = 3 AS d FROM range(0, 4) t(i)"),
    "agg_sum_distinct": ("MATCH (p:Part) RETURN p.p_brand AS b, sum(DISTINCT p.p_size) AS s, count(p) AS n", "SELECT p_brand AS b, sum(DISTINCT p_size)::BIGINT AS s, count(*) AS n FROM part GROUP BY 1"),
    "epoch_fns": ("UNWIND range(0, 5) AS i WITH datetime.fromepoch(i * 86400 * 100) AS d, i RETURN i, d.year AS y, d.ordinalDay AS n, d.epochSeconds AS e", "SELECT i, year(epoch_ms(i * 8640000000)) AS y, dayofyear(epoch_ms(i * 8640000000)) AS n, i * 8640000 AS e FROM range(0, 6) t(i)"),
    "duration_math": ("UNWIND range(1, 4) AS i RETURN i, toString(duration({hours: i}) * 2 + duration('P1D')) AS d, duration('P1Y2M').months AS m", "SELECT i, 'P1DT' || (2 * i) || 'H' AS d, 14::BIGINT AS m FROM range(1, 5) t(i)"),
    "date_forms": ("RETURN toString(date({year: 2015, week: 1})) AS a, toString(date('2015-W30-2')) AS b, toString(date({year: 1984, ordinalDay: 202})) AS c, toString(date({year: 1984, quarter: 3, dayOfQuarter: 45})) AS d", "SELECT '2014-12-29' AS a, '2015-07-21' AS b, '1984-07-20' AS c, '1984-08-14' AS d"),
    "varlen_rel_list": ("MATCH (m:Message)-[e:NEXT*2]->(k:Message) RETURN m.conv_id AS c, m.turn AS t, size(e) AS n", WALK.format(most=2) + " SELECT a // 1000 AS c, a % 1000 AS t, n::BIGINT AS n FROM w WHERE n = 2"),
    "varlen_in": ("MATCH (k:Message)<-[:NEXT*1..2]-(m:Message) RETURN k.conv_id AS c, k.turn AS t, m.turn AS u", WALK.format(most=2) + " SELECT b // 1000 AS c, b % 1000 AS t, a % 1000 AS u FROM w"),
    "optional_chain": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:FROM]-(s:Supplier) WHERE s.s_acctbal < 0 OPTIONAL MATCH (s)<-[:SHIPPED_BY]-(o:Order) RETURN n.n_name AS n, count(DISTINCT s) AS s, count(o) AS o", f"SELECT n_name AS n, count(DISTINCT s_suppkey) AS s, count(l_orderkey) AS o FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 LEFT JOIN ({LINES}) ON l_suppkey = s_suppkey GROUP BY 1"),
    "exists_in_return": ("MATCH (c:Customer) RETURN c.c_custkey AS c, EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'P' } AS e", "SELECT c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS e FROM customer"),
    "with_order_limit": ("MATCH (o:Order) WITH o ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 5 MATCH (o)<-[:PLACED]-(c:Customer) RETURN o.o_orderkey AS k, c.c_name AS n", "SELECT o_orderkey AS k, c_name AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) JOIN customer ON c_custkey = o_custkey"),
    "with_distinct_where": ("MATCH (o:Order) WITH DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p WHERE s <> 'F' RETURN s, count(*) AS n", "SELECT s, count(*) AS n FROM (SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders) WHERE s <> 'F' GROUP BY 1"),
    "nested_collect": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect(n.n_nationkey) AS ks RETURN r.r_name AS r, size([k IN ks WHERE k % 2 = 0]) AS even, any(k IN ks WHERE k = 7) AS seven", "SELECT r_name AS r, count(*) FILTER (n_nationkey % 2 = 0) AS even, bool_or(n_nationkey = 7) AS seven FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "show_databases": ("SHOW DATABASES", "SELECT 'default' AS name, true AS current"),
    "show_indexes": ("SHOW INDEXES", "SELECT '' AS name, '' AS label, '' AS property, true AS \"unique\", '' AS state WHERE false"),
    "mixed_in": ("UNWIND range(0, 3) AS i RETURN i, i IN ['1', 2] AS a, '1' IN ['1', 2] AS b, i IN ['x', null] AS c", "SELECT i, i = 2 AS a, true AS b, NULL::BOOLEAN AS c FROM range(0, 4) t(i)"),
    "mixed_order": ("UNWIND [10, 9, 'z', true, 2.5, null] AS x RETURN x ORDER BY x SKIP 1 LIMIT 3", "SELECT unnest(['true', '2.5', '9']) AS x"),
    "mixed_minmax": ("MATCH (n:Nation) WITH CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_nationkey ELSE n.n_name END AS v RETURN max(v) AS hi, min(v) AS lo, count(DISTINCT v) AS n", "SELECT max(n_nationkey) FILTER (n_nationkey % 2 = 0)::VARCHAR AS hi, min(n_name) FILTER (n_nationkey % 2 = 1) AS lo, count(*) AS n FROM nation"),
    "mixed_compare": ("MATCH (c:Customer) WITH CASE WHEN c.c_custkey % 3 = 0 THEN c.c_custkey ELSE c.c_name END AS v WHERE v > 100 RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 100"),
    "mixed_add": ("UNWIND [1, 'a', 2.5] AS x RETURN x + 1 AS s, toInteger(x) AS i, [x] = [1] AS e", "SELECT * FROM (VALUES ('2', 1::BIGINT, true), ('a1', NULL, false), ('3.5', 2, false)) t(s, i, e)"),
    "percentile_distinct": ("MATCH (p:Part) RETURN p.p_brand AS b, percentileDisc(DISTINCT p.p_size, 0.5) AS d, percentileCont(DISTINCT p.p_size, 0.25) AS c", "SELECT b, quantile_disc(x, 0.5) AS d, quantile_cont(x::DOUBLE, 0.25) AS c FROM (SELECT DISTINCT p_brand AS b, p_size::BIGINT AS x FROM part) GROUP BY b"),
    "inline_props": ("MATCH (o:Order {o_orderstatus: 'F'})-[:CONTAINS {l_quantity: 1.0}]->(p:Part) RETURN count(*) AS n", f"SELECT count(*) AS n FROM ({LINES}) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_quantity = 1"),
    "patcomp_in_listcomp": ("MATCH (r:Region) RETURN r.r_name AS r, size([x IN [(r)<-[:IN_REGION]-(n) | n.n_nationkey] WHERE x > 10]) AS n", "SELECT r_name AS r, count(*) FILTER (n_nationkey > 10) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "power_fns": ("MATCH (p:Part) RETURN p.p_partkey AS k, round_(sqrt(p.p_size)) AS s, p.p_size ^ 2 AS q, -p.p_size AS m, +p.p_size AS u, rand() < 1.0 AS r, 0x1F + 0o17 AS h", "SELECT p_partkey AS k, round(sqrt(p_size), 4) AS s, pow(p_size, 2) AS q, -p_size::BIGINT AS m, p_size::BIGINT AS u, true AS r, 46::BIGINT AS h FROM part"),
    "trim_fns": ("UNWIND range(1, 3) AS i RETURN i, trim('  a ') AS a, ltrim('  a ') AS b, rtrim(' a  ') AS c, toUpper('ab') AS d, toBoolean('true') AS e, toBoolean('x') AS f, 'a' + i + 'b' AS g", "SELECT i, 'a' AS a, 'a ' AS b, ' a' AS c, 'AB' AS d, true AS e, NULL::BOOLEAN AS f, 'a' || i || 'b' AS g FROM range(1, 4) t(i)"),
    "entity_fns": ("MATCH (c:Customer)-[r:FROM]->(n:Nation) RETURN properties(n).n_name AS name, count(DISTINCT id(c)) AS c, count(DISTINCT id(r)) AS r", "SELECT n_name AS name, count(*) AS c, count(*) AS r FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "localtime_fns": ("MATCH (o:Order) WITH o, localtime({hour: o.o_orderkey % 24, minute: o.o_custkey % 60, second: 5}) AS t RETURN o.o_orderkey AS k, t.hour AS h, toString(t) AS s, toString(t + duration('PT90M')) AS u, toString(localtime.truncate('hour', t)) AS v", "SELECT o_orderkey AS k, o_orderkey % 24 AS h, strftime(t, '%H:%M:%S') AS s, strftime(t + INTERVAL 90 MINUTE, '%H:%M:%S') AS u, strftime(date_trunc('hour', t), '%H:%M') AS v FROM (SELECT *, TIMESTAMP '2000-01-01 00:00:05' + to_hours((o_orderkey % 24)::INT) + to_minutes((o_custkey % 60)::INT) AS t FROM orders)"),
    "time_fns": ("UNWIND range(0, 5) AS i WITH i, time({hour: 10 + i, minute: 30, timezone: '+02:00'}) AS t RETURN i, toString(t) AS s, t.offset AS o, t.offsetSeconds AS e, t > time('11:00Z') AS a, t = time('10:30Z') AS b", "SELECT i, (10 + i) || ':30+02:00' AS s, '+02:00' AS o, 7200::BIGINT AS e, i >= 3 AS a, i = 2 AS b FROM range(0, 6) t(i)"),
    "datetime_zone": ("MATCH (o:Order) WITH o, datetime({datetime: o.o_orderdate, timezone: '+01:00'}) AS d RETURN o.o_orderkey AS k, d.hour AS h, d.offset AS z, d.epochSeconds AS e, d.timezone AS n", "SELECT o_orderkey AS k, hour(o_orderdate)::BIGINT AS h, '+01:00' AS z, floor(epoch_us(o_orderdate) / 1e6)::BIGINT - 3600 AS e, '+01:00' AS n FROM orders"),
    "datetime_named_zone": ("UNWIND [1, 7] AS m WITH m, datetime({year: 2020, month: m, day: 5, hour: 3, timezone: 'Europe/Stockholm'}) AS d RETURN m, toString(d) AS s, d.offsetMinutes AS o, d.epochSeconds AS e", "SELECT * FROM (VALUES (1::BIGINT, '2020-01-05T03:00+01:00[Europe/Stockholm]', 60::BIGINT, 1578189600::BIGINT), (7, '2020-07-05T03:00+02:00[Europe/Stockholm]', 120, 1593910800)) t(m, s, o, e)"),
    "truncate_fields": ("MATCH (o:Order) RETURN o.o_orderkey AS k, toString(date.truncate('month', o.o_orderdate, {day: 5})) AS a, toString(localdatetime.truncate('day', o.o_orderdate, {hour: 7})) AS b, toString(date.truncate('week', o.o_orderdate, {dayOfWeek: 3})) AS c", "SELECT o_orderkey AS k, strftime(date_trunc('month', o_orderdate) + INTERVAL 4 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') || 'T07:00' AS b, strftime(date_trunc('week', o_orderdate) + INTERVAL 2 DAY, '%Y-%m-%d') AS c FROM orders"),
    "duration_between_times": ("UNWIND range(0, 3) AS i RETURN i, toString(duration.between(localtime('10:00'), localtime({hour: 12 + i, minute: 30}))) AS a, duration.inSeconds(time('10:00Z'), time({hour: 10 + i, timezone: '+01:00'})).seconds AS b, duration.inMonths(date('2000-01-15'), date({year: 2000 + i, month: 3, day: 20})).months AS c", "SELECT i, 'PT' || (2 + i) || 'H30M' AS a, (i - 1) * 3600 AS b, 12 * i + 2 AS c FROM range(0, 4) t(i)"),
    "clock_fns": ("RETURN localtime.transaction() = localtime.transaction() AS a, datetime() > datetime('2020-01-01') AS b, time.statement().offset AS c, date.realtime() >= date('2020-01-01') AS d, localdatetime.statement().year > 2000 AS e", "SELECT true AS a, true AS b, 'Z' AS c, true AS d, true AS e"),
    "proc_ping": ("CALL db.ping()", "SELECT true AS success"),
    "proc_node_properties": ("CALL db.schema.nodeTypeProperties() YIELD nodeType, nodeLabels, propertyName, propertyTypes WITH nodeType AS t, nodeLabels[0] AS l, propertyName AS p, propertyTypes[0] AS k WHERE l IN ['Region', 'Order'] RETURN t, l, p, k", "SELECT ':' || l AS t, l, p, k FROM (VALUES ('Region', 'r_regionkey', 'int'), ('Region', 'r_name', 'str'), ('Order', 'o_orderkey', 'int'), ('Order', 'o_custkey', 'int'), ('Order', 'o_orderstatus', 'str'), ('Order', 'o_totalprice', 'float'), ('Order', 'o_orderdate', 'localdatetime'), ('Order', 'o_orderpriority', 'str')) v(l, p, k)"),
    "proc_rel_properties": ("CALL db.schema.relTypeProperties() YIELD relType, propertyName, mandatory RETURN relType AS t, count(propertyName) AS n, max(propertyName) AS hi, count(CASE WHEN mandatory THEN 1 END) AS m", "SELECT ':`' || t || '`' AS t, 5::BIGINT AS n, 'l_shipdate' AS hi, 0::BIGINT AS m FROM (VALUES ('CONTAINS'), ('SHIPPED_BY')) v(t)"),
    "proc_visualization": ("CALL db.schema.visualization() YIELD nodes, relationships RETURN size(nodes) AS n, head(nodes) AS a, size(relationships) AS r, last(relationships) AS b", "SELECT 10::BIGINT AS n, 'Customer' AS a, 8::BIGINT AS r, 'SHIPPED_BY' AS b"),
    "proc_components": ("CALL dbms.components() YIELD name, versions, edition RETURN name, size(versions) AS v, edition", "SELECT 'graphweft' AS name, 1::BIGINT AS v, 'spark' AS edition"),
    "proc_info": ("CALL dbms.info() YIELD id, name RETURN id, name", "SELECT 'graphweft' AS id, 'graphweft' AS name"),
    "proc_client_config": ("CALL dbms.clientConfig() YIELD name RETURN count(*) AS n", "SELECT 0::BIGINT AS n"),
    "proc_procedures": ("CALL dbms.procedures() YIELD name RETURN name", "SELECT unnest(['db.ping', 'db.labels', 'db.relationshipTypes', 'db.propertyKeys', 'db.indexes', 'db.schema.nodeTypeProperties', 'db.schema.relTypeProperties', 'db.schema.visualization', 'dbms.components', 'dbms.info', 'dbms.clientConfig', 'dbms.procedures', 'dbms.functions']) AS name"),
    "proc_functions": ("CALL dbms.functions() YIELD name WITH name WHERE name IN ['abs', 'collect', 'nothing', 'percentiledisc', 'toupper'] RETURN name", "SELECT unnest(['abs', 'collect', 'percentiledisc', 'toupper']) AS name"),
    "proc_beside_rows": ("UNWIND range(1, 3) AS i CALL db.ping() YIELD success RETURN i, success", "SELECT i, true AS success FROM range(1, 4) t(i)"),
    "explain": ("EXPLAIN MATCH (c:Customer) RETURN count(*) AS n", None),
}

#: name -> (statements run before, query, SQL)
UPDATES: dict[str, tuple[list[str], str, str]] = {
    "create_nodes": (["UNWIND range(1, 50) AS i CREATE (t:Tag {k: i, even: i % 2 = 0})"], "MATCH (t:Tag) RETURN t.even AS e, count(*) AS n, sum(t.k) AS s", "SELECT i % 2 = 0 AS e, count(*) AS n, sum(i)::BIGINT AS s FROM range(1, 51) t(i) GROUP BY 1"),
    "create_edges": (["MATCH (c:Customer)-[:FROM]->(n:Nation) WHERE c.c_acctbal < 0 CREATE (c)-[:OWES {amount: 0 - c.c_acctbal}]->(n)"], "MATCH (c)-[r:OWES]->(n:Nation) RETURN n.n_name AS name, count(*) AS n, max(r.amount) AS m", "SELECT n_name AS name, count(*) AS n, max(-c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY 1"),
    "set_prop": (["MATCH (s:Supplier) WHERE s.s_acctbal < 0 SET s.s_acctbal = 0.0, s.poor = true"], "MATCH (s:Supplier) RETURN s.s_suppkey AS k, s.s_acctbal AS b, s.poor AS p", "SELECT s_suppkey AS k, greatest(s_acctbal, 0.0) AS b, CASE WHEN s_acctbal < 0 THEN true END AS p FROM supplier"),
    "set_map_labels": (["MATCH (r:Region) WHERE r.r_regionkey < 2 SET r += {tag: 'x', r_name: null}, r:Hot"], "MATCH (r:Hot) RETURN r.r_regionkey AS k, r.tag AS t, r.r_name AS n", "SELECT r_regionkey::BIGINT AS k, 'x' AS t, NULL::VARCHAR AS n FROM region WHERE r_regionkey < 2"),
    "remove_prop": (["MATCH (n:Nation) WHERE n.n_nationkey > 10 REMOVE n.n_name"], "MATCH (n:Nation) RETURN count(*) AS n, count(n.n_name) AS c", "SELECT count(*) AS n, count(CASE WHEN n_nationkey <= 10 THEN 1 END) AS c FROM nation"),
    "delete_edges": (["MATCH (:Customer)-[r:PLACED]->(o) WHERE o.o_totalprice > 100000 DELETE r"], "MATCH (:Customer)-[r:PLACED]->() RETURN count(r) AS n", "SELECT count(*) AS n FROM orders WHERE NOT o_totalprice > 100000"),
    "detach_delete": (["MATCH (n:Nation) WHERE n.n_nationkey < 5 DETACH DELETE n"], "MATCH (c:Customer) OPTIONAL MATCH (c)-[:FROM]->(n:Nation) RETURN count(c) AS c, count(n) AS n", "SELECT count(*) AS c, count(CASE WHEN c_nationkey >= 5 THEN 1 END) AS n FROM customer"),
    "merge_node": (["MATCH (c:Customer) MERGE (s:Segment {name: c.c_mktsegment}) ON CREATE SET s.fresh = true"], "MATCH (s:Segment) RETURN s.name AS n, s.fresh AS f", "SELECT DISTINCT c_mktsegment AS n, true AS f FROM customer"),
    "merge_edge": (["MATCH (c:Customer)-[:FROM]->(n:Nation)-[:IN_REGION]->(r:Region) MERGE (n)-[:SELLS]->(r)"], "MATCH (n:Nation)-[:SELLS]->(r:Region) RETURN n.n_name AS n, r.r_name AS r", "SELECT DISTINCT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey"),
    "merge_on_match": (["UNWIND [1, 2] AS i CREATE (:K {i: i})", "UNWIND [1, 2, 3] AS i MERGE (k:K {i: i}) ON CREATE SET k.c = 1 ON MATCH SET k.m = 2"], "MATCH (k:K) RETURN k.i AS i, k.c AS c, k.m AS m", "SELECT * FROM (VALUES (1::BIGINT, NULL::BIGINT, 2::BIGINT), (2, NULL, 2), (3, 1, NULL)) v(i, c, m)"),
    "remove_label": (["MATCH (s:Supplier) WHERE s.s_suppkey <= 5 REMOVE s:Supplier"], "MATCH (s:Supplier) RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier WHERE s_suppkey > 5"),
    "index_with_duplicates": ([], "CREATE UNIQUE INDEX by_nation FOR (c:Customer) ON (c.c_nationkey)", "SELECT 'by_nation' AS name, 'Customer' AS label, 'c_nationkey' AS property, true AS \"unique\", 'ERROR' AS state"),
    "drop_index": (["CREATE INDEX a FOR (c:Customer) ON (c.c_name)", "CREATE INDEX b FOR ()-[r:CONTAINS]-() ON (r.l_quantity)", "DROP INDEX a"], "SHOW INDEXES", "SELECT 'b' AS name, 'CONTAINS' AS label, 'l_quantity' AS property, false AS \"unique\", 'PUBLIC' AS state"),
    "proc_indexes": (["CREATE INDEX by_two FOR (o:Order) ON (o.o_custkey, o.o_orderdate)"], "CALL db.indexes() YIELD name, state, labels, properties RETURN name, state, labels[0] AS l, size(properties) AS n", "SELECT 'by_two' AS name, 'PUBLIC' AS state, 'Order' AS l, 2::BIGINT AS n"),
    "use_database": (["CREATE DATABASE other", "USE other", "UNWIND range(1, 4) AS i CREATE (:T {k: i})"], "MATCH (n) RETURN count(*) AS n, sum(n.k) AS s", "SELECT 4::BIGINT AS n, 10::BIGINT AS s"),
    "create_database": (["CREATE DATABASE other", "CREATE DATABASE other IF NOT EXISTS", "CREATE DATABASE third", "DROP DATABASE third"], "SHOW DATABASES", "SELECT * FROM (VALUES ('default', true), ('other', false)) t(name, current)"),
    "create_index": ([], "CREATE UNIQUE INDEX by_key FOR (c:Customer) ON (c.c_custkey)", "SELECT 'by_key' AS name, 'Customer' AS label, 'c_custkey' AS property, true AS \"unique\", 'PUBLIC' AS state"),
}


#: Declared graphs by application and folder: files are listed and schemas read once.
_declared: dict[tuple[str, str], Graph] = {}


def _session(spark: SparkSession, d: str) -> GraphSession:
    key = (spark.sparkContext.applicationId, d)
    if key not in _declared:
        _declared[key] = star_graph(spark, d)
    session = GraphSession(spark, _declared[key])
    # means of doubles depend on the order of addition; comparisons use four places
    session.register_function("round_", lambda v: (F.round(v[0], 4), "float"))
    return session


def _case(text: str):
    return lambda spark, d: _session(spark, d).run(text, {"least": 150000})


def _update(before: list[str], text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        session = _session(spark, d)
        for statement in before:
            session.run(statement)
        return session.run(text)

    return run


def queries() -> dict:
    return {**{n: _case(t) for n, (t, _) in CASES.items()}, **{n: _update(b, t) for n, (b, t, _) in UPDATES.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{n: s for n, (_, s) in CASES.items() if s}, **{n: s for n, (*_, s) in UPDATES.items()}}
