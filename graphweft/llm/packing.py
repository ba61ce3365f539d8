"""Operator 10: pack token pieces into sequences by exact-complement hashing, then best fit.

Tokenising is one pass over the texts. What is left of a document is a few numbers per piece.
The plan works on the counts of pieces by length (at most ``capacity`` numbers, whatever the input),
so it is made on the driver: for the longest length left, single, pair and triple sums that fill
the gap exactly are looked up, as many sequences of that pattern are closed as the counts allow, and where
nothing fits exactly the longest piece that fits goes in. Pieces then find their place by their rank within
their length: ranks come from small (length, hash bucket) groups and the buckets' counts, so that one length
with a third of all pieces is spread over all buckets.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphweft.llm.common import cut, partitions

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, and their bytes; the memory starts anew when either is full.
REMEMBERED, REMEMBERED_CHARS = 500_000, 6_000_000
#: Bytes of texts tokenised at once.
CHUNK = 1 << 22
#: Pieces in a (length, bucket) group, on average over all lengths, at which more buckets are used.
BUCKET_ROWS = 20_000


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes: 0 space, 1 other, 2 letter, 3 digit, 4 apostrophe (other too); the second table knows spaces and others alone."""
    kinds = np.ones(256, dtype=np.uint8)
    kinds[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 2
    kinds[[*range(ord("0"), ord("9") + 1)]] = 3
    kinds[ord("'")] = 4
    kinds[[0x20, *range(0x09, 0x0E)]] = 0
    return kinds, np.minimum(kinds, 1)


class _WordIds:
    """Little-endian ids of texts by way of the ids of their words. The tokenizer folds case and never joins tokens over a word's ends.

    Texts whose characters are ASCII or letters are split into letters, digits and signs as the tokenizer does it
    itself; others only at ASCII spaces. Texts with special tokens are encoded whole. Words are cut out for many texts at once,
    and only the different ones are looked up.
    """

    #: Fixed by the tokenizer's own pattern: what may follow an apostrophe at the beginning of a word.
    ONE, TWO = b"stmd", (b"re", b"ve", b"ll")
    FINE, COARSE = _classes()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.letters: set[str] = set(map(chr, range(128)))
        self.others: set[str] = set()
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.chars, self.first, self.count, self.flat = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def plain(self, text: bytes) -> bool:
        """Whether all characters are ASCII or letters, also when they are normalised and folded."""
        if text.isascii():
            return True
        found = set(text.decode())
        for c in found - self.letters - self.others:
            (self.letters if unicodedata.normalize("NFC", c).lower().isalpha() else self.others).add(c)
        return found <= self.letters

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        simple = self.tokenizer.model.tokenize
        found: list[list[int]] = [[t.id for t in simple(w.decode())] if w.isascii() and (w.isalpha() or w.isdigit() and len(w) == 1) else [] for w in new]
        if rest := [k for k, ids in enumerate(found) if not ids]:
            [whole] = self.ids([b" ".join([new[k] for k in rest]).decode()])
            ends = np.flatnonzero(self.ends[whole]) + 1
            if len(ends) != len(rest):  # some are not one word to the tokenizer
                each = self.ids([new[k].decode() for k in rest])
                whole, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
            whole, ends = whole.tolist(), ends.tolist()
            for k, a, b in zip(rest, [0, *ends], ends):
                found[k] = whole[a:b]
        count = np.fromiter(map(len, found), np.int64, len(found))
        self.rows.update(zip(new, range(len(self.first), len(self.first) + len(new))))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), "<u4", int(count.sum()))])
        self.chars += sum(map(len, new))

    def starts(self, data: np.ndarray, fine: bool) -> np.ndarray:
        """Where words begin in ``data`` (folded, without special tokens)."""
        kind = (self.FINE if fine else self.COARSE)[data]
        if not fine:
            return np.flatnonzero((kind > 0) & (np.concatenate([[0], kind[:-1]]) == 0))
        mark = kind == 4
        kind[mark] = 1
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        new = (kind > 0) & ((kind != before) | (kind == 3))
        at = np.flatnonzero(mark & new)
        at = at[at + 3 < len(data)]
        one = at[np.isin(data[at + 1], np.frombuffer(self.ONE, np.uint8))]
        pair = data[at + 1].astype(np.int32) << 8 | data[at + 2]
        two = at[np.isin(pair, [x[0] << 8 | x[1] for x in self.TWO])]
        for k, some in ((2, one), (3, two)):
            new[some + 1] = False
            new[some + k] |= kind[some + k] > 0
        return np.flatnonzero(new)

    def many(self, texts: list[bytes], fine: bool) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.rows) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        data = np.frombuffer((b"\n".join(texts) + b"\n   ").lower(), dtype=np.uint8)
        starts = self.starts(data, fine)
        base = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
        own = self.COARSE[data] > 0  # without spaces, a word ends where the next begins
        offsets = np.append(np.cumsum(own)[starts] - 1, own.sum()).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[own])]).dictionary_encode()
        different = words.dictionary.to_pylist()
        if new := [w for w in different if w not in self.rows]:
            self.learn(new)
        row = np.fromiter(map(self.rows.__getitem__, different), np.int64, len(different))[words.indices.to_numpy()]
        count = self.count[row]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.first[row] - upto[:-1], count) + np.arange(upto[-1])]
        cuts = upto[base].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        special = [b"<|" in t for t in texts]
        fine = [not s and self.plain(t) for s, t in zip(special, texts)]
        for kind in (True, False):
            some = [k for k, s in enumerate(special) if not s and fine[k] == kind]
            if some:
                for k, ids in zip(some, self.many([texts[k] for k in some], kind)):
                    out[k] = ids
        for k, s in enumerate(special):
            if s:
                [out[k]] = self.ids([texts[k].decode()])
        return out


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document; null text counts as empty."""

    def cut_up(batches):
        words, end = _WordIds(path or tokenizer_path()), np.array([end_id], dtype="<u4")
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy())
            at = 0
            while at < whole.num_rows:
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, side="right")))
                batch = whole.slice(at, upto - at)
                at = upto
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(batch.column(0).to_pylist(), words.of(texts)):
                    ids = np.concatenate([ids, end])
                    for p, k in enumerate(range(0, len(ids), capacity)):
                        part = ids[k : k + capacity]
                        for column, value in zip(out, (doc, p, k, len(part), zlib.crc32(part))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences each fills; ``counts[n]`` is the number of pieces of length n.

    Each step uses up one length at least, or closes all sequences of one, so there are
    at most a few patterns for each length.
    """
    have = [int(x) for x in counts]
    bits = sum(1 << n for n, x in enumerate(have) if x and n)  # lengths in stock
    turned = sum(1 << (capacity - n) for n, x in enumerate(have) if x and n)  # the same, from the far end
    out: list[tuple[tuple[int, ...], int]] = []

    def pair(gap: int, top: int) -> tuple[int, int] | None:
        both = bits & (turned >> (capacity - gap) if gap <= capacity else 0) & ((1 << (top + 1)) - 1)
        while both:
            a = both.bit_length() - 1
            b = gap - a
            if a >= b and have[a] and have[b] and (a != b or have[a] > 1):
                return a, b
            if a < b:
                return None
            both ^= 1 << a
        return None

    def exact(gap: int) -> tuple[int, ...] | None:
        if have[gap]:
            return (gap,)
        if two := pair(gap, gap - 1):
            return two
        least = (bits & -bits).bit_length() - 1
        if least < 1 or 3 * least > gap:
            return None
        left = bits & ((1 << (gap - 2 * least + 1)) - 1)
        while left:
            a = left.bit_length() - 1
            if 3 * a < gap:
                return None
            left ^= 1 << a
            if not have[a]:
                continue
            have[a] -= 1
            two = pair(gap - a, a) if gap - a > 1 else None
            have[a] += 1
            if two:
                return (a, *two)
        return None

    for longest in range(capacity, 0, -1):
        while have[longest]:
            used = [longest]
            have[longest] -= 1
            gap = capacity - longest
            while gap:
                if fill := exact(gap):
                    used += fill
                    for n in fill:
                        have[n] -= 1
                    break
                best = (bits & ((1 << (gap + 1)) - 1)).bit_length() - 1
                while best > 0 and not have[best]:
                    best = (bits & ((1 << best) - 1)).bit_length() - 1
                if best <= 0:
                    break
                used.append(best)
                have[best] -= 1
                gap -= best
            need = {n: used.count(n) for n in used}
            more = min(have[n] // k for n, k in need.items())
            for n, k in need.items():
                have[n] -= more * k
                if not have[n] and bits >> n & 1:
                    bits ^= 1 << n
                    turned ^= 1 << (capacity - n)
            out.append((tuple(used), more + 1))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """By length: the first rank, the first sequence and the offset of each run of places for that length."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for used, times in patterns:
        offset = 0
        for n in used:
            ranks, first, at = out.setdefault(n, ([], [], []))
            ranks.append(filled.get(n, 0))
            first.append(sequence)
            at.append(offset)
            filled[n] = filled.get(n, 0) + times
            offset += n
        sequence += times
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every piece of every row of ``docs`` (doc_id, text) with its sequence_id and offset.

    Null and empty texts are one piece of the end id alone. Rows that repeat are packed as often as they
    stand there. Only documents over ``capacity`` ids are cut. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = cut(pieces(docs, path, capacity, end_id))
    by_length = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in by_length.items():
        counts[n] = k
    places = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    buckets = max(partitions(spark), int(counts.sum()) // BUCKET_ROWS)
    keyed = found.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = cut(keyed.groupBy("length", "b").count())
    before = sizes.select("length", "b", (F.sum("count").over(W.partitionBy("length").orderBy("b")) - F.col("count")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "b").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = keyed.withColumn("within", within).join(before, ["length", "b"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))

    def place(batches):
        table = places.value
        for batch in batches:
            got = [[], []]
            for n, rank in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                ranks, first, at = table[n]
                k = bisect_right(ranks, rank) - 1
                got[0].append(first[k] + rank - ranks[k])
                got[1].append(at[k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
