"""Operator 7: mix sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document has a fixed 60-bit hash. Words are summed by source and leading hash bits, the
cell in which a source's budget ends is found on those sums, and only the rows of that cell are
summed again by further bits, until the cell holds one hash value. What is below the threshold
is taken; no document is sorted. A second threshold of the same kind spends what the first
left over on documents that still fit. Joins run on (source, leading bits), so that a source
with a third of all rows is spread over 256 keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphweft.llm.common import SPACE, cut, word_count

#: Hash bits and how they are consumed, level by level.
BITS, LEVELS = 60, (8, 20, 32, 46, 60)
WEIGHTS = (5, 2, 1)


def _slim(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return docs.select("doc_id", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("k"), word_count(F.col("text")).alias("size"), h.alias("h"), *carry)


def _targets(slim: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """(k, total, target): weights by the source's rank, poured into caps until none is above its own.

    One number, the level of the water, goes to the driver and back in each round.
    """
    by_source = slim.groupBy("k").agg(F.sum("size").alias("total"))
    ordered = cut(by_source.orderBy(F.col("k") == "", "k").select("k", "total", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("before") + F.col("at")) % len(weights) + 1).cast("int")).cast("long")
    src = cut(ordered.join(F.broadcast(before), "part").select("k", "total", weight.alias("w")))  # a row for each partition of the sort
    whole = src.agg(F.sum("total")).first()[0] or 0
    num, den = share[0] * whole, 0
    full, capped = F.lit(cap * share[1]).cast("decimal(38,0)") * F.col("total"), F.lit(False)
    seen = -1
    while True:  # a budget of num shared by weights that sum to den; both in units of 1 / share[1] words
        n, spent, den = src.agg(F.count(F.when(capped, 1)), F.sum(F.when(capped, F.col("total"))), F.sum(F.when(~capped, F.col("w")))).first()
        num, den = share[0] * whole - cap * share[1] * (spent or 0), den or 0
        if n == seen or not den:
            break
        seen = n
        capped = F.col("w") * F.lit(num).cast("decimal(38,0)") >= full * F.lit(den)
    poured = (F.col("w") * F.lit(num)).cast("double") / F.lit(share[1] * max(den, 1)).cast("double")
    return src.select("k", "total", F.when(capped, (F.col("total") * cap).cast("double")).otherwise(poured).alias("target"))


def _threshold(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """For each k of ``budget`` (k, left): the greatest prefix of its hashes whose sizes stay within ``left``.

    Returns k, below (every hash under it is in), used (their words), edge (words at the hash ``below`` itself).
    Without a row for k, all of its documents fit.
    """
    state = budget.select("k", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("used"), "left")
    found = None
    for depth, bits in enumerate(LEVELS):
        up = F.shiftright("h", BITS - bits)
        if depth:
            held = docs.withColumn("cell", F.shiftright("h", BITS - LEVELS[depth - 1])).join(state.select("k", "cell"), ["k", "cell"], "left_semi")
        else:
            held = docs
        sums = held.groupBy("k", up.alias("sub")).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        cum = sums.join(state.select("k", "used", "left"), "k").withColumn("upto", F.col("used") + F.sum("words").over(W.partitionBy("k").orderBy("sub")))
        edge = cut(cum.where("upto > left").groupBy("k").agg(F.min_by(F.struct("sub", "words", "lo", "hi", "upto", "left"), "sub").alias("e")).select("k", "e.*"))
        done = edge.where("lo = hi").select("k", F.col("lo").alias("below"), (F.col("upto") - F.col("words")).alias("used"), F.col("words").alias("edge"), "left")
        found = done if found is None else found.union(done)
        state = edge.where("lo <> hi").select("k", F.col("sub").alias("cell"), (F.col("upto") - F.col("words")).alias("used"), "left")
        if not state.take(1):
            break
    return cut(found)


def _spread(by_source: DataFrame) -> DataFrame:
    """A row for each value of the first hash bits, so that joins on (k, b) spread a hot source."""
    return by_source.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << LEVELS[0]) - 1).cast("long"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns ``carry`` for every row of ``docs`` (doc_id, text, source).

    A target over its source's size takes whole copies first, the rest by threshold. Null text and
    text without words has size 0 and takes 0; a null source is a source of its own, ranked last; rows with
    equal doc_id share a hash and are taken together within a source; an empty table gives an empty result.
    """
    slim = cut(_slim(docs, carry)).withColumn("b", F.shiftright("h", BITS - LEVELS[0]))
    goal = _targets(slim, weights, share, cap)
    copies = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    goal = cut(goal.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("total")))
    first = _threshold(slim, goal.select("k", "left"))
    rest = slim.join(_spread(first.select("k", "below", (F.col("left") - F.col("used")).alias("gap"))), ["k", "b"]).where("h >= below and size <= gap")
    rest = cut(rest.select("k", "h", "size", "b", "gap"))
    second = _threshold(rest, rest.groupBy("k").agg(F.min("gap").alias("left")))
    nearer = F.col("edge") - (F.col("left") - F.col("used")) < F.col("left") - F.col("used")
    plan = goal.join(first.select("k", "below", (F.col("left") - F.col("used")).alias("gap")), "k", "left").join(second.select("k", F.col("below").alias("below2"), nearer.alias("nearer")), "k", "left")
    one = F.when(F.col("below").isNull() | (F.col("h") < F.col("below")), True).when(F.col("size") > F.col("gap"), False).otherwise(F.col("below2").isNull() | (F.col("h") < F.col("below2")) | ((F.col("h") == F.col("below2")) & F.col("nearer")))
    taken = F.col("size") * (F.col("copies") + F.when(one & (F.col("left") > 0), 1).otherwise(0))
    return slim.join(_spread(plan), ["k", "b"]).select("doc_id", "size", F.col("total").alias("source_size"), "target", taken.cast("long").alias("taken"), *carry)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS nul,
         len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT s, nul, sum(size)::BIGINT AS total,
         [5, 2, 1][((row_number() OVER (ORDER BY nul, s) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY s, nul),
poured AS (
  SELECT *, coalesce(sum(total) OVER o, 0) AS t0, coalesce(sum(w) OVER o, 0) AS w0,
         sum(total) OVER () AS t1, sum(w) OVER () AS w1
  FROM src WINDOW o AS (ORDER BY total / w, nul, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, w * (3 * t1 - 4 * t0) >= 4 * total * (w1 - w0) AS cap FROM poured),
lvl AS (SELECT 3 * sum(total) - 4 * coalesce(sum(total) FILTER (cap), 0) AS num, sum(w) FILTER (NOT cap) AS den FROM capped),
goal AS (
  SELECT s, nul, total, CASE WHEN cap THEN 2.0::DOUBLE * total ELSE (w * num)::DOUBLE / (2 * den)::DOUBLE END AS target
  FROM capped, lvl),
part AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS copies FROM goal),
a AS (
  SELECT d.*, total, target, copies, target - copies * total AS lft,
         sum(size) OVER (PARTITION BY d.s, d.nul ORDER BY h) AS upto
  FROM d JOIN part USING (s, nul)),
b AS (
  SELECT *, upto <= lft AS one, lft - coalesce(max(upto) FILTER (upto <= lft) OVER (PARTITION BY s, nul), 0) AS gap FROM a),
c AS (
  SELECT *, NOT one AND size <= gap AS second, sum(CASE WHEN NOT one AND size <= gap THEN size ELSE 0 END) OVER (PARTITION BY s, nul ORDER BY h) AS upto2 FROM b),
e AS (
  SELECT *, coalesce(max(upto2) FILTER (second AND upto2 <= gap) OVER (PARTITION BY s, nul), 0) AS used2,
         min(h) FILTER (second AND upto2 > gap) OVER (PARTITION BY s, nul) AS edge FROM c)
SELECT doc_id, size, total::BIGINT AS source_size, target,
  (size * (copies + CASE WHEN lft > 0 AND (one OR (second AND (upto2 <= gap OR (h = edge AND upto2 - gap < gap - used2)))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
"""


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
