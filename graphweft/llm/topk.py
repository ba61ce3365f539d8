"""Operator 2: exact top-k inner products by MaxScore.

A dimension is a term, a row's value in it the weight of its posting. Rows are dealt into shards, and each shard keeps
the postings of every term sorted by weight, whose ends bound a term's part of any score. The best postings of the
heaviest terms are scored first, which gives a k-th best score. What a row may fall short of the sum of all bounds and still reach that
score is the slack. Terms are split by their bounds' reach: the non-essential ones, lighter, aren't traversed at all,
and the slack is shared out over the essential ones by their reach. A row that falls short of every essential term's
bound by more than its share falls short of the sum by more than the slack, so only postings within a share are traversed; of
the splits (1, 2, 4, ... essential terms) the one with the fewest such postings is taken. The other terms are then probed in order of reach for the rows
found, and a row goes when what it has and the bounds of the terms left can't reach the k-th score. Shards' answers are merged
by a ranked window of k rows from each shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphweft.llm.common import partitions, table

K, SCALE = 10, 1024
SHARD_ROWS, QUERY_BLOCK = 8192, 1024
#: Postings scored at once to have a first k-th score; terms probed between two looks at the bounds.
SEEDS, PROBE = 256, 8
#: Scores are held within 64 bits.
LOWEST, HIGHEST = -(2**63), 2**63 - 1


class Shard:
    """Postings of some rows; ``values`` is rows x terms of whole numbers, in int64 or, if sums could overflow, Python ints."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the rows but ``own``: ids and scores, ties to smaller ids."""
        low, high = query * self.sorted[0], query * self.sorted[-1]
        bound, reach = np.maximum(low, high), np.abs(high - low)
        terms = np.argsort(-reach, kind="stable")
        each = max(1, SEEDS // 8)
        seeds = np.unique(np.concatenate([self.order[-each:, t] if query[t] > 0 else self.order[:each, t] for t in terms[:8]]))
        seeds = seeds[self.ids[seeds] != own]
        if len(seeds) < k:  # no k-th score yet: every posting is essential
            found, least = np.arange(len(self.ids)), None
        else:
            scores = _held(self.values[seeds] @ query)
            least = int(np.partition(scores, len(scores) - k)[len(scores) - k])
            if least <= LOWEST:
                least = np.minimum(low, high).sum()  # scores held at the lowest are ties
            found = self._candidates(query, bound, reach, terms, least)
        found = found[self.ids[found] != own]
        have, left = np.zeros(len(found), dtype=self.values.dtype), bound.sum()
        for at in range(0, len(terms), PROBE):
            some = terms[at : at + PROBE]
            have = have + self.values[np.ix_(found, some)] @ query[some]
            left = left - bound[some].sum()
            if least is not None:
                competing = have + left >= least
                found, have = found[competing], have[competing]
        have = _held(have)
        best = np.lexsort((self.ids[found], ~have))[:k]
        return self.ids[found][best], have[best]

    def _candidates(self, query: np.ndarray, bound: np.ndarray, reach: np.ndarray, terms: np.ndarray, least) -> np.ndarray:
        """Rows with a posting within its essential term's share of the slack, for the split with the fewest of them."""
        slack, n = int(bound.sum()) - int(least), len(self.ids)
        heavy = [int(t) for t in terms if reach[t] > 0]
        best, cost = None, n
        for m in sorted({min(1 << e, len(heavy)) for e in range(len(heavy).bit_length() + 1)} - {0}):
            whole = sum(int(reach[t]) for t in heavy[:m])
            ranges = []
            for t in heavy[:m]:
                # shortfalls are whole numbers: over its share means over the share's whole part
                worth, q = int(bound[t]) - slack * int(reach[t]) // whole, int(query[t])
                if q > 0:  # q * x >= worth
                    ranges.append((t, int(np.searchsorted(self.sorted[:, t], -(-worth // q), side="left")), n))
                else:
                    ranges.append((t, 0, int(np.searchsorted(self.sorted[:, t], worth // q, side="right"))))
            traversed = sum(hi - lo for _, lo, hi in ranges)
            if traversed < cost:
                best, cost = ranges, traversed
        if best is None:  # no split is cheaper than the postings of one whole term, which holds every row
            return np.arange(n)
        return np.unique(np.concatenate([self.order[lo:hi, t] for t, lo, hi in best]))


def _held(scores: np.ndarray) -> np.ndarray:
    """Scores within 64 bits."""
    if scores.dtype != object:
        return scores
    return np.array([max(min(int(s), HIGHEST), LOWEST) for s in scores], dtype=np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of a matrix in double precision."""
    return np.array(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); Python ints where an inner product could leave 64 bits."""
    if float(np.abs(x).max(initial=0)) <= 2**40:
        out = np.floor(SCALE * x).astype(np.int64)
        if float(np.abs(out).max(initial=0)) ** 2 * x.shape[1] < 2**61:
            return out
    return np.array([[int(v) * SCALE if abs(v) > 2**53 else int(np.floor(SCALE * v)) for v in row] for row in x.tolist()], dtype=object)


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) that ``is_query`` selects.

    Vectors that are null or empty, hold null, NaN or infinite components, or have no id take no part. Vectors meet
    only those of their own length. Fewer than k rows give as many results as there are; rows of the query's own id are
    never its results. Rows that repeat are results each, and every row that asks is a query of its own, so an id that asks
    twice has each rank twice. Ties go to the smaller vec_id. Scores are 64-bit; those beyond are held at the largest or
    smallest and are ties there. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select("vec_id", "embedding", is_query.alias("asks")).where(fine).withColumn("n", F.size("embedding"))
    rows, asking = (good.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first())
    shards = max(1, -(-rows // SHARD_ROWS))
    blocks = max(1, -(-asking // QUERY_BLOCK), min(asking, -(-partitions(spark) // shards)))  # work for every core, however few the rows
    deal = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    index = good.select("n", deal(0, shards).alias("shard"), "vec_id", "embedding")
    packed = table(index.groupBy("n", "shard").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows")), "topk-shards")  # SHARD_ROWS or so
    # numbers that hold since the table is written once
    asks = good.where("asks").select("n", deal(1, blocks).alias("block"), "vec_id", "embedding", F.monotonically_increasing_id().alias("ask"))
    asks = table(asks.groupBy("n", "block").agg(F.collect_list(F.struct("vec_id", "embedding", "ask")).alias("queries")), "topk-queries")  # QUERY_BLOCK or so
    meet = packed.select("n", "shard").join(asks.select("n", "block"), "n")  # every shard and every block of queries
    tasks = min(shards * blocks, 64 * partitions(spark))
    at = F.pmod(F.col("shard").cast("long") * blocks + F.col("block"), F.lit(tasks)).cast("int")
    work = meet.join(packed, ["n", "shard"]).join(asks, ["n", "block"]).repartitionById(tasks, at).select("rows", "queries")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, held = batch.column(0)[at].values.flatten()
                asker, given, ask = batch.column(1)[at].values.flatten()
                both = _whole(np.concatenate([_vectors(held), _vectors(given)]))
                shard, out = Shard(ids.to_numpy(), both[: len(ids)]), [[], [], [], []]
                for q, number, x in zip(asker.to_pylist(), ask.to_pylist(), both[len(ids) :]):
                    found, scores = shard.top(q, x, k)
                    out[0] += [q] * len(found)
                    out[1] += [number] * len(found)
                    out[2] += found.tolist()
                    out[3] += scores.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "ask", "vec_id", "score"])

    best = work.mapInArrow(run, "query_id long, ask long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
