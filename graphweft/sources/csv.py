"""Bulk load of a folder of delimited files; a file's name says what it holds.

``label_0_0.csv`` holds nodes, ``source_type_target_0_0.csv`` edges between two labels; the first column (for
edges the first two) is a key. Values are whole numbers where a whole column is.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphweft.sources.graph import Graph, empty


def load(spark: SparkSession, folder: str, names: list[str], sep: str = "|") -> Graph:
    """The graph in the files ``names`` of ``folder``; each is read once for its columns' types and again by every query on it. Names that fit neither form raise."""
    g = empty(spark)
    for edges in (False, True):
        for name in names:
            bare = re.sub(r"\.csv$", "", name).split("_")
            if len(bare) not in (3, 5):
                raise ValueError(f"{name}: not label_0_0.csv or source_type_target_0_0.csv")
            if (len(bare) == 5) != edges:
                continue
            raw = spark.read.option("sep", sep).option("header", True).option("inferSchema", True).csv(f"{folder}/{name}")
            plain = [re.sub(r"[.`]", "_", c) for c in raw.columns]
            df = raw.toDF(*(c if plain.count(c) == 1 else f"{c}_{k}" for k, c in enumerate(plain)))
            if not edges:
                g = g.add_nodes(bare[0].capitalize(), df.withColumn("_key", F.col(df.columns[0]).cast("bigint")), "_key", {c: c for c in df.columns})
            else:
                keyed = df.withColumns({"_a": F.col(df.columns[0]).cast("bigint"), "_b": F.col(df.columns[1]).cast("bigint")})
                g = g.add_edges(bare[1].upper(), keyed, (bare[0].capitalize(), "_a"), (bare[2].capitalize(), "_b"), tuple(df.columns[2:]))
    return g
