"""Operator 9: language proportions of each document by expectation-maximisation.

Training counts hashed character n-grams of each language over all training rows. A document is a mixture:
each word comes from one of the languages, with a likelihood from its n-grams. The set of languages
grows from the best single one while a further language raises the mixture's likelihood by more than a
penalty; the proportions of the set are what EM converges to. The prediction is the largest proportion.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: n-gram buckets; n-gram lengths; smoothing count; share of a word's summed log-likelihood that counts.
BUCKETS, GRAMS, SMOOTH, TEMPER = 1 << 15, (2, 3), 0.5, 0.5
#: Log-likelihood that each further language must add, times the log of the number of words; EM steps.
PENALTY, STEPS = 2.0, 30
#: Words that a worker remembers.
REMEMBERED, REMEMBERED_CHARS = 200_000, 4_000_000
#: Characters of texts after which a worker turns words into n-grams, words at once, and languages after which it passes sums on.
COUNTED_CHARS, COUNTED_WORDS, COUNTED_LANGS = 2_000_000, 1 << 15, 64
UNDEFINED = "und"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``words``, the word that each belongs to, and whether a word has letters.

    Case is folded, what isn't a letter becomes a boundary, and n-grams of boundaries alone or over two words are left out.
    """
    text = "\n" + "\n".join(words) + "\n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    kinds, back = np.unique(code, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()])[back]
    word = np.cumsum(code == 10) - 1
    c = np.where(letter, code, 0)
    out, of = [], []
    for n in GRAMS:
        k = len(c) - n + 1
        if k <= 0:
            continue
        h, some, within = np.full(k, n, dtype=np.uint64), np.zeros(k, dtype=bool), np.ones(k, dtype=bool)
        for j in range(n):
            h = (h ^ c[j : j + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            some |= letter[j : j + k]
            if 0 < j < n - 1:
                within &= code[j : j + k] != 10
        some &= within
        owner = np.minimum(word[n - 2 : n - 2 + k], len(words) - 1)  # the word before the last boundary character
        out.append((h[some] >> np.uint64(40)) % np.uint64(BUCKETS))
        of.append(owner[some])
    has = np.zeros(len(words), dtype=bool)
    has[np.unique(word[letter])] = True
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64), np.concatenate(of) if of else np.zeros(0, np.int64), has


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram log-probabilities (languages x BUCKETS), counted over all rows of ``docs`` (text, lang)."""

    def count(batches):
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}
        held = 0

        def add() -> None:
            for lang, counted in words.items():
                into = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                some, times = list(counted), np.fromiter(counted.values(), np.int64, len(counted))
                for k in range(0, len(some), COUNTED_WORDS):
                    buckets, of, _ = grams(some[k : k + COUNTED_WORDS])
                    into += np.bincount(buckets, weights=times[k:][of], minlength=BUCKETS).astype(np.int64)
            words.clear()

        def give():
            add()
            for lang, n in sums.items():
                at = np.flatnonzero(n) if n.any() else np.zeros(1, np.int64)  # a language without n-grams is known too
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                text, lang = text.as_py().lower(), lang.as_py()
                words.setdefault(lang, Counter()).update(text.split())
                held += len(text)
                if held > COUNTED_CHARS:
                    add()
                    held = 0
                if len(sums) > COUNTED_LANGS:
                    yield from give()
        yield from give()

    counted = docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS at most
    langs = sorted(rows["lang"].unique())
    n = np.zeros((len(langs), BUCKETS))
    n[np.searchsorted(np.array(langs), rows["lang"].to_numpy().astype(str)) if langs else [], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return langs, np.log((n + SMOOTH) / (n.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)


def proportions(like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen languages and their shares, from the words' log-likelihoods (words x languages)."""
    total = like.sum(axis=0, dtype=np.float64)
    chosen = [int(np.argmax(total))]
    share, best = np.ones(1), total[chosen[0]]
    price = PENALTY * np.log(len(like) + 1)
    now = like[:, chosen[0]].astype(np.float64)
    while len(chosen) < like.shape[1]:
        gain = np.maximum(like - now[:, None], 0).sum(axis=0)  # no mixture with a further language gains more
        tried = None
        for j in np.argsort(-gain):
            if gain[j] <= price:
                break
            if j not in chosen:
                fit, value, mixed = _em(like[:, [*chosen, j]].astype(np.float64))
                if value - price > best and (tried is None or value > tried[1]):
                    tried = fit, value, mixed, int(j)
        if tried is None:
            break
        share, best, now = tried[:3]
        chosen.append(tried[3])
    return np.array(chosen), share


def _em(like: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    top = like.max(axis=1, keepdims=True)
    p, share, value = np.exp(like - top), np.full(like.shape[1], 1 / like.shape[1]), -np.inf
    for _ in range(STEPS):
        joint = p * share
        mass = joint.sum(axis=1)
        was, value = value, float(np.log(np.maximum(mass, 1e-300)).sum())
        share = (joint / np.maximum(mass, 1e-300)[:, None]).mean(axis=0)
        if value - was < 1e-4:
            break
    mixed = np.log(np.maximum(p @ share, 1e-300)) + top[:, 0]
    return share, float(mixed.sum()), mixed


class _Words(dict):
    """Log-likelihoods of words, by row of ``table``; the last column says whether a word has letters."""

    def __init__(self, logp: np.ndarray):
        self.logp, self.table, self.chars = logp, np.zeros((0, len(logp) + 1), dtype=np.float32), 0

    def learn(self, texts: list[list[str]]) -> None:
        if len(self) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.clear()
            self.table, self.chars = self.table[:0], 0
        new = list(set().union(*texts) - self.keys())
        if not new:
            return
        buckets, of, has = grams(new)
        like = np.stack([np.bincount(of, weights=row[buckets], minlength=len(new)) for row in self.logp], axis=1) * TEMPER
        self.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.table = np.concatenate([self.table, np.column_stack([like, has]).astype(np.float32)])
        self.chars += sum(map(len, new))


def detect(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if none are named) with lang_pred, score (share of the predicted language) and languages (share by language).

    ``und``, with score 0 and no shares, for null texts, texts without a letter, and if the model knows no language.
    Words without letters have no say; equal shares go to the language that came first by likelihood. Every row is answered for
    itself, so rows that repeat get equal answers, and an empty table gives no rows.
    """
    langs, logp = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(logp)  # languages x BUCKETS numbers
    extra = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64()))])

    def predict(batches):
        words = _Words(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t.as_py() or "").lower().split() for t in part.column(0)]
                out = []
                if langs:
                    words.learn(texts)
                for tokens in texts:
                    rows = words.table[np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))] if langs and tokens else np.zeros((0, len(langs) + 1), np.float32)
                    rows = rows[rows[:, -1] > 0, :-1]
                    if not len(rows):
                        out.append((UNDEFINED, 0.0, {}))
                        continue
                    chosen, share = proportions(rows)
                    k = int(np.argmax(share))
                    out.append((langs[chosen[k]], float(min(max(share[k], 0), 1)), {langs[c]: float(s) for c, s in zip(chosen, share)}))
                made = pa.array([{"lang_pred": a, "score": b, "languages": list(c.items())} for a, b, c in out], extra)
                back = 0 if "text" in keep else 1  # the text goes back only where it is asked for
                yield pa.RecordBatch.from_arrays([*part.columns[back:], made], names=[*part.schema.names[back:], "_found"])

    keep = [c for c in keep or docs.columns if c not in ("lang_pred", "score", "languages")]
    ordered = [c for c in ("text",) if c in keep] + [c for c in keep if c != "text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*ordered).dtypes) + ", _found struct<lang_pred: string, score: double, languages: map<string, double>>"
    return docs.select("text", *(c for c in ordered if c != "text")).mapInArrow(predict, schema).select(*keep, "_found.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    slim = docs.select("doc_id", "text", held_out.alias("held_out"))
    return detect(slim, model, ["doc_id", "held_out"])
