"""Operator 3: quality from random-indexing word vectors, pooled per document, and a two-layer network.

Every word falls into a bucket by its folded spelling and into one by its shape (runs of capitals, small
letters, digits, signs). A bucket has a fixed sparse random vector; its word vector is that plus what the
fixed vectors of its neighbours sum to over the whole corpus. A document is the mean of its vectors. The
network is trained with numpy on a bounded sample of labelled rows, and a temperature fitted on rows that it
has not seen makes its probabilities calibrated.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.language import crc_mod

#: Buckets for words and for shapes, size of a vector, its non-zero entries, neighbours on either side.
WORDS, SHAPES, SIZE, NONZERO, REACH = 1 << 13, 1 << 10, 32, 4, 2
#: Labelled rows that the network learns from, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 300, 0.01, 1e-4, 7
REMEMBERED = 400_000

_SHAPE = {c: "A" if chr(c).isupper() else "a" if chr(c).isalpha() else "0" if chr(c).isdigit() else chr(c) for c in range(0x250)}
_RUN = re.compile(r"(.)\1+", re.S)


def index_vectors() -> np.ndarray:
    """Fixed ternary vectors of all buckets, words first."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((WORDS + SHAPES, SIZE), dtype=np.float32)
    for k in range(NONZERO):
        at = rng.integers(0, SIZE, WORDS + SHAPES)
        out[np.arange(WORDS + SHAPES), at] += rng.choice(np.array([-1, 1], dtype=np.float32), WORDS + SHAPES)
    return out


class _Buckets(dict):
    """word -> bucket of its spelling + WORDS * bucket of its shape."""

    def __missing__(self, word: str) -> int:
        shape = _RUN.sub(r"\1", word.translate(_SHAPE)) if len(word) < 200 else "long"
        got = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS + WORDS * (zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = got
        return got

    def of(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets from every row of ``docs`` (text)."""

    def gather(batches):
        fixed, buckets = index_vectors(), _Buckets()
        total = np.zeros((WORDS + SHAPES, SIZE))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                gap = np.full(REACH, -1)  # no neighbours over the ends of a text
                both = np.concatenate([x for t in batch.column(0).slice(at, 64) for x in (buckets.of(t.as_py()), gap)])
                real = both >= 0
                word, shape = np.where(real, both % WORDS, 0), np.where(real, both // WORDS, 0) + WORDS
                each = (fixed[word] + fixed[shape]) * real[:, None]
                near = np.zeros_like(each)
                for k in range(1, REACH + 1):
                    near[k:] += each[:-k]
                    near[:-k] += each[k:]
                word, shape, near = word[real], shape[real], near[real]
                for d in range(SIZE):
                    total[:WORDS, d] += np.bincount(word, near[:, d], WORDS)
                    total[WORDS:, d] += np.bincount(shape - WORDS, near[:, d], SHAPES)
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *(pa.array(total[seen, d].astype(np.int64)) for d in range(SIZE))], ["bucket", *(f"v{d}" for d in range(SIZE))])

    sums = docs.select("text").mapInArrow(gather, "bucket int, " + ", ".join(f"v{d} long" for d in range(SIZE)))
    rows = sums.groupBy("bucket").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(SIZE))).toPandas()  # WORDS + SHAPES rows at most
    context = np.zeros((WORDS + SHAPES, SIZE))
    context[rows["bucket"].to_numpy(np.int64)] = rows[[f"v{d}" for d in range(SIZE)]].to_numpy(np.float64)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return (unit(context) + unit(index_vectors().astype(np.float64))).astype(np.float32)


def _pool(both: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if not len(both):
        return np.zeros(2 * SIZE + 1, dtype=np.float32)
    return np.concatenate([vectors[both % WORDS].mean(axis=0), vectors[both // WORDS + WORDS].mean(axis=0), [np.log1p(len(both))]]).astype(np.float32)


def features(docs: DataFrame, shared, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the pooled vector of each row's whole text."""

    def run(batches):
        buckets = _Buckets()
        for batch in batches:
            x = [_pool(buckets.of(t.as_py()), shared.value).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x, pa.list_(pa.float32()))], names=[*batch.schema.names[1:], "x"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", x array<float>"
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, schema)


class Network:
    """tanh layer and a logit, with the inputs' scale and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(2 * SIZE + 1), np.ones(2 * SIZE + 1))
        n, self.heat = x.shape[1] if x.ndim == 2 else 2 * SIZE + 1, 1.0
        self.w = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        if len(set(y.tolist())) < 2:  # nothing to tell apart: the one label there is, or neither
            self.w[2][:] = 0
            self.w[3][:] = {0: -5.0, 1: 5.0}[int(y[0])] if len(y) else 0
            return
        apart = rng.random(len(x)) < 0.2
        fit, held = ~apart, apart
        z, m, v = (x - self.mean) / self.scale, [0 * p for p in self.w], [0 * p for p in self.w]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(z[fit] @ self.w[0] + self.w[1])
            e = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y[fit]) / fit.sum()
            back = np.outer(e, self.w[2]) * (1 - h * h)
            for k, g in enumerate((z[fit].T @ back + DECAY * self.w[0], back.sum(axis=0), h.T @ e + DECAY * self.w[2], e.sum(keepdims=True))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if held.any():
            logit = np.clip(self.logit(x[held]), -30, 30)
            heats = np.geomspace(0.25, 8, 60)
            self.heat = float(heats[np.argmin([np.logaddexp(0, -(2 * y[held] - 1) * logit / t).mean() for t in heats])])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.heat, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple:
    """Broadcast word vectors (all rows of ``docs``) and a network learned from ``labels`` (doc_id, quality)."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    sample = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    some = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "quality")), "doc_id")  # TRAIN_ROWS rows at most
    rows = features(some, vectors, ["doc_id", "quality"]).toPandas()
    rows["x"] = rows["x"].map(tuple)
    rows = rows.sort_values(["doc_id", "x"])
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), 2 * SIZE + 1)
    return vectors, Network(x, (rows["quality"].to_numpy() > 0).astype(np.float64))


def score(docs: DataFrame, model: tuple, keep: list[str]) -> DataFrame:
    """The columns ``keep``, score and predicted for every row of ``docs`` (text).

    Null and empty texts get the network's answer to a document without words. Every row is answered for itself, so rows that
    repeat get equal answers, and an empty table gives no rows. A probability of 0.5 exactly counts as label 1.
    """
    vectors, network = model
    net = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        buckets = _Buckets()
        for batch in batches:
            x = np.array([_pool(buckets.of(t.as_py()), vectors.value) for t in batch.column(0)], dtype=np.float64).reshape(batch.num_rows, 2 * SIZE + 1)
            p = net.value.probability(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", score double, predicted int"
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    return score(docs.withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1), model, ["doc_id", "held_out"])
