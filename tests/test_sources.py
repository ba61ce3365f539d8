"""Graphs from frames and from folders of delimited files."""

import pytest

from graphweft.session import GraphSession
from graphweft.sources import csv
from graphweft.sources.graph import empty


def test_csv_folder(spark, tmp_path):
    (tmp_path / "person_0_0.csv").write_text("id|name|age\n1|ann|30\n2|bob|x\n")
    (tmp_path / "city_0_0.csv").write_text("id|name\n7|rome\n")
    (tmp_path / "person_livesin_city_0_0.csv").write_text("Person.id|City.id|since\n1|7|1999\n")
    (tmp_path / "person_knows_person_0_0.csv").write_text("Person.id|Person.id|w\n1|2|5\n")
    names = sorted(p.name for p in tmp_path.iterdir())
    s = GraphSession(spark, csv.load(spark, str(tmp_path), names))
    assert s.run("MATCH (p:Person)-[r:LIVESIN]->(c:City) RETURN p.name AS p, c.name AS c, r.since AS s").collect()[0] == ("ann", "rome", 1999)
    assert s.run("MATCH (p:Person)-[r:KNOWS]->(q:Person) RETURN q.age AS a, r.w AS w").collect()[0] == ("x", 5)
    with pytest.raises(ValueError):
        csv.load(spark, str(tmp_path), ["bad.csv"])


def test_ids_differ_over_labels_and_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    g = empty(spark).add_nodes("A", df, "id").add_nodes("B", df, "id").add_edges("T", df, ("A", "id"), ("B", "id"))
    s = GraphSession(spark, g)
    assert s.run("MATCH (n) RETURN count(DISTINCT id(n)) AS n").collect()[0].n == 4
    first, second = (sorted(r.i for r in s.run("MATCH ()-[r:T]->() RETURN id(r) AS i").collect()) for _ in range(2))
    assert first == second and len(set(first)) == 2
