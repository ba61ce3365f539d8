"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds by query (median of warm runs)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from graphweft import catalogue

HEADLINE = ["flagship", "filter_compound", "three_hop", "expand_into", "rel_uniqueness", "varlen_bounded", "optional_match", "exists_semi", "pattern_comprehension", "group_agg", "topk", "date_fields"]
RUNS = 3

#: The same queries written by hand as Spark SQL over the tables: what the planner is measured against.
BY_HAND = {
    "flagship": "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY n DESC, seg LIMIT 5",
    "filter_compound": "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 1e5 AND o_orderstatus IN ('F', 'O')",
    "three_hop": "SELECT r_name AS region, count(*) AS n, max(o_totalprice) AS top FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "expand_into": "SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = s_suppkey",
    "rel_uniqueness": "WITH l AS (SELECT *, xxhash64(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id FROM lineitem) SELECT a.l_orderkey AS k, count(*) AS n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.id <> b.id GROUP BY 1",
    "varlen_bounded": "WITH x AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn FROM conversations), e AS (SELECT a.id AS s, b.id AS d FROM x a JOIN x b ON b.id = a.id + 1), w1 AS (SELECT s, d FROM e), w2 AS (SELECT w1.s, e.d FROM w1 JOIN e ON w1.d = e.s), w3 AS (SELECT w2.s, e.d FROM w2 JOIN e ON w2.d = e.s), w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) SELECT m.conv_id AS c, m.turn AS t, k.turn AS u FROM w JOIN x m ON m.id = w.s JOIN x k ON k.id = w.d",
    "optional_match": "SELECT o_orderkey AS k, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "exists_semi": "SELECT o_orderkey AS k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "pattern_comprehension": "SELECT c_custkey AS c, size(coalesce(l, array())) AS n FROM customer LEFT JOIN (SELECT o_custkey, collect_list(o_orderkey) AS l FROM orders WHERE o_totalprice > 100000 GROUP BY 1) ON o_custkey = c_custkey",
    "group_agg": "SELECT o_orderstatus AS s, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS m FROM orders GROUP BY 1",
    "topk": "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, k LIMIT 10",
    "date_fields": "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, weekofyear(o_orderdate) AS w, dayofyear(o_orderdate) AS n, weekday(o_orderdate) + 1 AS wd FROM orders",
}


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for table in ("region", "nation", "customer", "supplier", "orders", "lineitem", "conversations"):
        spark.read.parquet(f"{folder}/{table}.parquet").createOrReplaceTempView(table)
    queries, took, by_hand = catalogue.queries(), {}, {}
    for name in HEADLINE:
        each: dict[str, list[float]] = {"ours": [], "by hand": []}
        for _ in range(RUNS + 1):  # in turn, so that both see the same machine
            for who, make in (("ours", lambda n=name: queries[n](spark, folder)), ("by hand", lambda n=name: spark.sql(BY_HAND[n]))):
                began = time.perf_counter()
                make().write.format("noop").mode("overwrite").save()
                each[who].append(time.perf_counter() - began)
        took[name], by_hand[name] = (round(statistics.median(each[who][1:]), 3) for who in ("ours", "by hand"))
    scale = folder.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale) if scale.replace(".", "").isdigit() else scale, "by_hand": by_hand, "ratio": {n: round(took[n] / by_hand[n], 2) for n in took}, "ratio_total": round(sum(took.values()) / sum(by_hand.values()), 2)}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
