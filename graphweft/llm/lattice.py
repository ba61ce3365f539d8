"""Operator 1: near-duplicate embeddings by E8 lattice hashing.

Each table projects unit vectors onto 8 x BLOCKS random orthonormal directions and decodes each group of
eight coordinates to its nearest point of the E8 lattice; the points and the label name a cell. A vector lives in one
cell of every table and visits the neighbouring cells (a minimal lattice vector away) that it is nearest to. Vectors that
meet in a cell are compared in blocks by their cosines in double precision. A pair counts in the first table where it
meets, so nothing has to be made distinct, and only counts and a spanning forest leave a cell. Equal vectors are one
class with a number of members. Cells with many rows are dealt as pairs of blocks over tasks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import connected_components, cut, deal, partitions, runs, table

COSINE = 0.98
#: Tables, E8 points in a cell's name, neighbouring cells visited, coordinates' scale at which a link is short.
TABLES, BLOCKS, VISITS, ZOOM, SEED = 10, 2, 4, 1.5, 11
#: Rows of a cell above which it is dealt as pairs of blocks.
CELL_ROWS = 4096


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (-1, 1) for b in (-1, 1)]
    half = [np.array(s) for s in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of the even-sum whole points and of those moved by a half, the nearer."""

    def even(z):
        p = np.rint(z)
        off = z - p
        odd = np.flatnonzero(p.sum(axis=1) % 2)
        worst = np.abs(off[odd]).argmax(axis=1)
        p[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return p

    a, b = even(y), even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def _name(points: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit name for rows of lattice coordinates (halves)."""
    h = np.full(len(points), seed + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c in (2 * points).astype(np.int64).astype(np.uint64).T:
        h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, upto: int | None = None) -> np.ndarray:
    """Names of cells, rows x tables x (own cell, then visited ones), of the first ``upto`` tables."""
    n, d = unit.shape
    upto = tables if upto is None else upto
    short, out = minimal_vectors(), np.empty((n, upto, 1 + VISITS), dtype=np.int64)
    width = -(-d // 8) * 8
    for t in range(upto):
        rng = np.random.default_rng([SEED, t, d])
        blocks = min(BLOCKS, width // 8)
        base = np.linalg.qr(rng.normal(size=(width, width)))[0][:d, : 8 * blocks]
        y = unit @ base * (ZOOM * np.sqrt(max(d, 8) / 8))
        home = np.concatenate([decode(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        out[:, t, 0] = _name(home, t + tables * d)
        off = y - home
        nearness = np.concatenate([off[:, 8 * b : 8 * b + 8] @ short.T for b in range(blocks)], axis=1)
        best = np.argpartition(-nearness, VISITS - 1, axis=1)[:, :VISITS]
        for v in range(VISITS):
            next_to = home.copy()
            b, r = best[:, v] // 240, best[:, v] % 240
            for k in range(blocks):
                next_to[:, 8 * k : 8 * k + 8] += short[r] * (b == k)[:, None]
            out[:, t, 1 + v] = _name(next_to, t + tables * d)
    return out


def _unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = np.array(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread_out(classes: DataFrame, tables: int) -> DataFrame:
    """A slim row for every cell that a class lives in or visits."""

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("v"))
            same = [batch.filter(pc.equal(sizes, d)) for d in pc.unique(sizes)]
            for part in (b.slice(at, 2048) for b in same for at in range(0, b.num_rows, 2048)):
                names = cells(_unit(part.column("v")), tables)
                n, each = len(names), tables * (1 + VISITS)
                label = np.repeat(part.column("label_key").to_numpy(), each)
                cell = (names.reshape(-1).view(np.uint64) ^ (label.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))).view(np.int64)
                take = pa.array(np.repeat(np.arange(n), each))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.tile(np.repeat(np.arange(tables), 1 + VISITS), n), pa.int32()), pa.array(np.tile(np.arange(1 + VISITS) == 0, n * tables)), part.column("node").take(take)], ["cell", "t", "home", "node"])

    return classes.select("node", "label_key", "v").mapInArrow(run, "cell long, t int, home boolean, node long")


def _meet(rows: DataFrame, classes: DataFrame, tables: int, cosine: float) -> DataFrame:
    """Counts and forest edges of each cell, from rows sorted by cell: a (class), b (class linked with, or null), n (members linked with)."""

    def group(cols, lo, hi, out):
        t = int(cols["t"][lo])
        home = cols["home"][lo:hi]
        if hi - lo < 2 or not home.any():
            return
        node, m, label, side = (cols[k][lo:hi] for k in ("node", "m", "label_key", "side"))
        u = _unit(cols["v"][lo:hi])
        names, named = np.zeros((hi - lo, t + 1, 1 + VISITS), dtype=np.int64), np.zeros(hi - lo, dtype=bool)
        at_home, n, root = np.flatnonzero(home), np.zeros(hi - lo, dtype=np.int64), np.arange(hi - lo)
        links: list[np.ndarray] = []
        for k in range(0, hi - lo, 512):
            i, j = np.nonzero(u[k : k + 512] @ u[at_home].T >= cosine)  # vectors of one cell have one length
            i, j = i + k, at_home[j]
            ok = (node[i] != node[j]) & (label[i] == label[j]) & ((node[i] < node[j]) | ~home[i])
            ok &= (side[i] != side[j]) | ((side[i] == 2) & (side[j] == 2))  # of two parts only pairs across, of one all
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            ends = np.zeros(hi - lo, dtype=bool)
            ends[i], ends[j] = True, True
            new = np.flatnonzero(ends & ~named)
            names[new], named[new] = cells(u[new], tables, t + 1), True
            first = np.ones(len(i), dtype=bool)
            for s in range(t):
                first &= ~((names[i, s] == names[j, s, :1]).any(axis=1) | (names[j, s] == names[i, s, :1]).any(axis=1))
            # both visit each other: once, from the smaller number
            first &= home[i] | (node[i] < node[j]) | ~(names[j, t] == names[i, t, :1]).any(axis=1)
            i, j = i[first], j[first]
            np.add.at(n, i, m[j])
            np.add.at(n, j, m[i])
            links.append(np.stack([i, j]))
        if not links:
            return
        i, j = np.concatenate(links, axis=1)
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
        seen = np.flatnonzero(n)
        out[0].append(node[seen])
        out[1].append(node[root[seen]])
        out[2].append(n[seen])

    def run(batches):
        for have, bounds in runs(batches, ["cell", "pair"]):
            cols = {c: have.column(c).to_numpy() for c in ("t", "home", "node", "m", "label_key", "side")} | {"v": have.column("v")}
            out: list[list] = [[], [], []]
            for k in np.flatnonzero(np.diff(bounds) > 1):
                group(cols, int(bounds[k]), int(bounds[k + 1]), out)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["a", "b", "n"])

    met = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("lived")).where("rows > 1 and lived")
    rows = table(rows.join(met.select("cell"), "cell", "left_semi"), "lattice-met").join(classes.select("node", "m", "label_key", "v"), "node")
    dealt = deal(rows, "cell", "node", CELL_ROWS).select("cell", "pair", "side", "t", "home", "node", "m", "label_key", "v")
    return dealt.repartition(partitions(rows.sparkSession), "cell", "pair").sortWithinPartitions("cell", "pair").mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows with equal, non-null labels link at ``cosine`` or more. Vectors that are null, empty, zero or hold null, NaN or
    infinite components, rows without a label and rows without a vec_id link with nothing and are their own component.
    Vectors of different length never link; rows that repeat link with each other, and so do rows of one id
    whose vectors differ, where they are near: every row counts for itself.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0)
    key = [F.col("label"), F.xxhash64(F.lit(1), x).alias("k1"), F.xxhash64(F.lit(2), x).alias("k2")]
    grouped = rows.where(good).select("vec_id", x.cast("array<double>").alias("v"), *key).groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    # the numbers hold since the table is written once; ids wouldn't do, since one may have several vectors
    classes = table(grouped.withColumns({"label_key": F.xxhash64("label"), "node": F.monotonically_increasing_id()}), "lattice-classes")
    found = cut(_meet(table(_spread_out(classes, tables), "lattice-cells"), classes, tables, cosine))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.select("a", "b"))
    linked = table(classes.select("node", "cid").join(links, "node").join(parts, "node"), "lattice-linked")
    least = linked.groupBy("component").agg(F.min("cid").alias("component_id"))
    by_class = classes.select("label", "k1", "k2", "node", "cid", "m").join(linked.join(least, "component").select("node", "n", "component_id"), "node", "left")
    by_class = table(by_class.select("label", "k1", "k2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "cid").alias("component_id")), "lattice-found")
    slim = rows.select("vec_id", F.when(good, F.col("label")).alias("label"), F.when(good, key[1]).alias("k1"), F.when(good, key[2]).alias("k2"))
    out = slim.join(by_class, ["label", "k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {COSINE}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
FROM embeddings
"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
