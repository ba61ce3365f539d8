"""Shared helpers: lineage cuts in the shared folder, row keys, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts, as a character class body.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is set (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set; a cluster needs a folder that all its machines share")
        folder = tempfile.mkdtemp(prefix="graphweft-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Slim rows, computed once and kept in the shared folder; Spark removes them when unused."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Wide rows, written once as Parquet in the shared folder and read back with column pruning."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``table`` that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternating large-star and small-star steps: rows stay linear in the edges, every step is
    a group minimum with a map-side combine and a join on it, and its rows go to the shared folder.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def deal(rows: DataFrame, key: str, by: str, limit: int) -> DataFrame:
    """``rows`` dealt for comparing all rows of a key: with columns pair and side.

    A key of at most ``limit`` rows is one task (pair 0, side 2). A larger one is cut into parts by the hash of ``by``, and each
    pair of parts is a task: rows of side 0 meet those of side 1 there; where a part meets itself, side is 2.
    """
    sizes = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > limit).select(key, F.ceil(F.col("rows") * 2 / limit).cast("int").alias("parts")))
    out = rows.join(sizes, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")).cast("int"))
    other = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct((F.least(k, F.col("part")).cast("long") * F.col("parts") + F.greatest(k, F.col("part"))).alias("pair"), F.when(k == F.col("part"), 2).when(k > F.col("part"), 0).otherwise(1).alias("side")),
    )
    return out.withColumn("o", F.explode(other)).select(*rows.columns, "o.pair", "o.side")


def runs(batches, keys: list[str]):
    """Complete groups of sorted Arrow batches: (table, bounds) with each group of equal ``keys`` whole in one table."""
    import numpy as np
    import pyarrow as pa

    left = None
    for batch in batches:
        have = pa.Table.from_batches(([] if left is None else left.to_batches()) + [batch]).combine_chunks()
        new = np.zeros(max(len(have) - 1, 0), dtype=bool)
        for k in keys:
            c = have.column(k).to_numpy()
            new |= c[1:] != c[:-1]
        edges = np.flatnonzero(new) + 1
        if len(edges):
            yield have.slice(0, int(edges[-1])), np.concatenate([[0], edges])
            left = have.slice(int(edges[-1]))
        else:
            left = have
    if left is not None and len(left):
        yield left.combine_chunks(), np.array([0, len(left)])
