"""Operator 4: near-duplicate documents by an LSH forest over MinHash signatures.

Each tree sorts all distinct shingle sets by its own sequence of min-hashes. Neighbours in that order whose
sequences agree in the first DEPTH values are candidates, and where a region is sparse the depth adapts: up to SPARSE sets
that agree in one value fewer are candidates as well. Candidate regions, joined over the trees, put every set that can have
a link into one group, and each group is compared exactly on the full sets with an inverted index. Documents
with equal sets are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphweft.llm import shingles as S
from graphweft.llm.common import connected_components, cut, deal, partitions, runs, table

#: Links have 100 * intersection >= PERCENT * union. A pair at 85 % is missed by all trees with probability 1e-5.
PERCENT = 85
TREES, DEPTH, LENGTH, SPARSE = 16, 4, 6, 8
#: Texts hashed at once; sets of a group above which it is compared as pairs of parts.
TEXTS, GROUP = 64, 4096
_A, _B = S.constants(TREES * LENGTH, 21), S.constants(TREES * LENGTH, 22)


def _texts(column) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (which name the set; null for an empty one) and its signature."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                hashes, of, _, _ = S.words(_texts(batch.column(1)))
                found, start = S.shingles(hashes, of)
                full = np.flatnonzero(np.diff(start))
                least = np.empty((len(full), TREES * LENGTH), dtype="<u2")
                for k in range(TREES * LENGTH if len(full) else 0):
                    least[:, k] = (np.minimum.reduceat((found ^ _B[k]) * _A[k], start[:-1][full]) >> np.uint64(16)) & np.uint64(0xFFFF)
                size, k1, k2, sig = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
                for row, k in zip(least, full.tolist()):
                    own = np.unique(found[start[k] : start[k + 1]])
                    size[k] = len(own)
                    k1[k], k2[k] = (int(x) for x in np.array([own.sum(), S.mix(own + np.uint64(1)).sum()], dtype=np.uint64).view(np.int64))
                    sig[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that join all classes (cid, sig) of a region of some tree."""
    step = 2 * LENGTH
    rows = classes.select("cid", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig").select("tree", F.expr(f"substring(sig, tree * {step} + 1, {step})").alias("key"), "cid")
    order = rows.repartitionByRange(partitions(classes.sparkSession), "tree", "key", "cid").sortWithinPartitions("tree", "key", "cid")

    def run(batches):
        have = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None  # slim rows of one range
        if have is None or not len(have):
            return
        cid, n = have.column("cid").to_numpy(), len(have)
        key = np.frombuffer(b"".join(have.column("key").to_pylist()), dtype="<u2").reshape(n, LENGTH)
        tree = have.column("tree").to_numpy()
        common = np.cumprod((key[1:] == key[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
        root = np.arange(n)
        for depth in (DEPTH - 1, DEPTH):
            first = np.concatenate([[True], common < depth])
            begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            size = np.diff(np.append(np.flatnonzero(first), n))[np.cumsum(first) - 1]
            take = (size <= SPARSE) | (depth == DEPTH)
            root = np.where(take & (root == np.arange(n)), begin, root)
        linked = np.flatnonzero(root != np.arange(n))
        ends = np.array([0, n - 1])
        # ends of the range, to be joined with its neighbours'
        kinds = pa.array([0] * len(linked) + [1, 2], pa.int32())
        at = np.concatenate([linked, ends])
        yield pa.RecordBatch.from_arrays(
            [kinds, pa.array(cid[at]), pa.array(cid[np.concatenate([root[linked], ends])]), pa.array(tree[at], pa.int32()), pa.array([None] * len(linked) + [key[k].astype(">u2").tobytes() for k in ends], pa.binary())],
            ["kind", "a", "b", "tree", "key"],
        )

    found = table(order.mapInArrow(run, "kind int, a long, b long, tree int, key binary").withColumn("part", F.spark_partition_id()), "forest")
    ends = found.where("kind > 0").groupBy("part").agg(F.min_by(F.struct("tree", "key", "a"), "kind").alias("lo"), F.max_by(F.struct("tree", "key", "a"), "kind").alias("hi"))
    before = F.lag("hi").over(W.orderBy("part"))  # a row for each range
    near = ends.select("lo", before.alias("hi")).where(f"lo.tree = hi.tree and substring(lo.key, 1, {2 * DEPTH - 2}) = substring(hi.key, 1, {2 * DEPTH - 2})")
    return found.where("kind = 0").select("a", "b").union(near.select("lo.a", F.col("hi.a").alias("b"))).distinct()


def verify(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links within each group of ``sets`` (g, cid, own: sorted 64-bit shingles)."""

    def group(have, lo, hi):
        own = [np.frombuffer(x, dtype=np.uint64) for x in have.column("own").slice(lo, hi - lo).to_pylist()]
        cid, side = have.column("cid").to_numpy()[lo:hi], have.column("side").to_numpy()[lo:hi]
        n, size = len(own), np.array([len(x) for x in own])
        token = np.concatenate(own)
        doc = np.repeat(np.arange(n), size)
        order = np.argsort(token, kind="stable")
        ranked = token[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        name = np.empty(len(token), dtype=np.int64)
        name[order] = np.cumsum(new) - 1
        begin = np.append(np.flatnonzero(new), len(token))
        holders, upto = doc[order], np.concatenate([[0], np.cumsum(size)])
        part = np.arange(n)
        for x in range(n - 1):
            rest = (side[x] != side[x + 1 :]) | (side[x] == 2)
            if not (rest & (part[x + 1 :] != part[x])).any():
                continue
            mine = name[upto[x] : upto[x + 1]]
            length = begin[mine + 1] - begin[mine]
            mine, length = mine[length > 1], length[length > 1]
            if not len(mine):
                continue
            at = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            both = np.bincount(holders[at], minlength=n)[x + 1 :]
            linked = np.flatnonzero(rest & (100 * both >= percent * (size[x] + size[x + 1 :] - both))) + x + 1
            if len(linked):
                parts = np.unique(part[np.append(linked, x)])
                part[np.isin(part, parts)] = parts[0]
        moved = np.flatnonzero(part != np.arange(n))
        return cid[moved], cid[part[moved]]

    def run(batches):
        for have, bounds in runs(batches, ["g", "pair"]):
            out = [group(have, int(bounds[k]), int(bounds[k + 1])) for k in np.flatnonzero(np.diff(bounds) > 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = deal(sets, "g", "cid", GROUP).select("g", "pair", "side", "cid", "own")
    return dealt.repartition(partitions(sets.sparkSession), "g", "pair").sortWithinPartitions("g", "pair", "cid").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame) -> DataFrame:
    """g, cid, own of the rows (doc_id, text, g, k1, k2) whose text has the named set."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                hashes, of, _, _ = S.words(_texts(batch.column(1)))
                found, start = S.shingles(hashes, of)
                keep, own = [], []
                for k, k1 in enumerate(batch.column(3).to_pylist()):
                    x = np.unique(found[start[k] : start[k + 1]])
                    if int(x.sum(dtype=np.uint64).astype(np.int64)) == k1:
                        keep.append(k)
                        own.append(x.tobytes())
                some = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(2), some.column(0), pa.array(own, pa.binary())], ["g", "cid", "own"])

    return docs.select("doc_id", F.col("text").cast("binary"), "g", "k1").mapInArrow(run, "g long, cid long, own binary")


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Null texts and texts without words have no shingles and link with nothing, nor do rows with null doc_id; each is a component
    of its own. Rows that share a doc_id are one document as far as components go. Words are compared byte by byte
    after folding A-Z.
    """
    slim = table(signatures(docs), "minhash-docs")
    classes = table(slim.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.first("sig").alias("sig")), "minhash-classes")
    groups = connected_components(candidates(classes.select("cid", "sig")))
    wanted = cut(classes.select("cid", "k1", "k2").join(groups.withColumnRenamed("node", "cid"), "cid").select(F.col("cid").alias("doc_id"), F.col("component").alias("g"), "k1", "k2"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id")
    sets = table(_sets(texts), "minhash-sets").dropDuplicates(["g", "cid", "own"])
    parts = connected_components(table(verify(sets, percent), "minhash-links"))
    found = cut(classes.select("k1", "k2", "cid").join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("k1", "k2", F.coalesce("component", "cid").alias("c")))
    out = slim.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(found, ["k1", "k2"], "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
    ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * p.x >= 85 * (x.n + y.n - p.x)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(w.doc_id, m.m), w.doc_id) AS component_id,
  w.doc_id = coalesce(least(w.doc_id, m.m), w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) m USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
