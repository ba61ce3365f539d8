"""Operator 6: remove byte strings that repeat anywhere, by suffix arrays over content-defined shards.

Every window of LENGTH bytes is filed under its anchor, the GRAM-byte string in it with the least hash. Equal windows
have equal anchors at equal places, so a window can only repeat among the segments (runs of windows that share an anchor)
with its anchor's hash. Hashes that occur once end there. Equal segments are one content with a count. Contents that share an
anchor's hash are sorted by external induced sorting (``induced``), shard by shard, and a window repeats if a neighbour in
suffix order shares LENGTH bytes with it or if its content occurs more than once. Only (document, place, hash) rows and the
segments in question move; the repeated ranges go back to their documents in one join.

Where passages of words are asked for as well (``words``), windows of so many words are filed under anchors of WORD_GRAM words in the same way. Those
whose anchor occurs again are compared by hashes of their words among all with that anchor; their texts move with those of the segments.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm import shingles as S
from graphweft.llm.common import discard, partitions, runs, table
from graphweft.llm.induced import BUDGET, IN_MEMORY, Shard

LENGTH, GRAM = 400, 32
#: Bytes hashed at once; bytes of segments that are sorted as one shard, unless one anchor has more.
CHUNK, SHARD = 1 << 20, 1 << 20
#: Segments that move at once; texts whose words are hashed at once; words of the string by which a passage is filed.
ROWS, TEXTS, WORD_GRAM = 1024, 64, 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0xD6E8FEB86659FD93


def _geometric(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _rolling(a: np.ndarray, width: int, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``width`` items."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(a * powers[: len(a)])])
    return S.mix((sums[width:] - sums[:-width]) * inverse[: len(a) - width + 1])


def anchors(a: np.ndarray, length: int, gram: int, powers: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window of each run of windows of ``a`` (at least ``length`` items) that share an anchor."""
    n, w = len(a), length - gram + 1
    key = _rolling(a, gram, powers, inverse)
    keyed = (key & ~np.uint64(0xFFFFFFFF)) | np.arange(len(key), dtype=np.uint64)  # the leftmost of equal ones
    blocks = -(-len(keyed) // w)
    padded = np.full(blocks * w, ~np.uint64(0))
    padded[: len(keyed)] = keyed
    square = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(back[:count], ahead[w - 1 : w - 1 + count])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return key[(least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)].view(np.int64), first, np.append(first[1:], count) - 1


def _row(docs: DataFrame) -> list[Column]:
    """What names a row: its id (a hash of it, unless it is a whole number) and a hash of its text and of whether it has an id. Rows
    equal in both are treated alike."""
    whole = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    own = F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id")
    return [F.coalesce(own, F.lit(0)).cast("long").alias("dk"), F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("ver")]


def _segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """dk, ver, h, g1, g2, s0, s1: each run of windows, its anchor's hash and the 128-bit hash of its bytes."""

    def run(batches):
        size = CHUNK + length
        powers, inverse = _geometric(_BASE, size), _geometric(pow(_BASE, -1, 1 << 64), size)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for dk, ver, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_buffer().to_pybytes()
                for at in range(0, len(text) - length + 1, CHUNK):  # windows that start in the chunk
                    part = text[at : at + CHUNK + length - 1]
                    h, first, last = anchors(np.frombuffer(part, dtype=np.uint8).astype(np.uint64) + np.uint64(1), length, gram, powers, inverse)
                    view = memoryview(part)
                    g = np.frombuffer(b"".join([hashlib.blake2b(view[a : b + length], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist())]), dtype=np.int64)
                    for column, value in zip(out, (np.full(len(h), dk), np.full(len(h), ver), h, g[::2], g[1::2], (first + at).astype(np.int64), (last + at).astype(np.int64))):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["dk", "ver", "h", "g1", "g2", "s0", "s1"])

    long = docs.select(*_row(docs), F.col("text").cast("binary").alias("text")).where(F.length("text") >= length)
    return long.mapInArrow(run, "dk long, ver long, h long, g1 long, g2 long, s0 long, s1 long")


def _pieces(text: bytes) -> list[tuple[int, bytes]]:
    """``text`` cut at white space into parts of CHUNK bytes or a little more, with the byte at which each begins."""
    out, at = [], 0
    while len(text) - at > CHUNK and (space := _SPACE.search(text, at + CHUNK)):
        out.append((at, text[at : space.start()]))
        at = space.start()
    return [*out, (at, text[at:])]


def _worded(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The hashes of each text's words, A-Z folded, and the bytes at which they begin and end."""
    out: list[list] = [[] for _ in texts]
    held: list[tuple] = []

    def hash_held():
        hashes, of, begin, end = S.words([part for _, _, part in held])
        for n, (k, at, _) in enumerate(held):
            own = slice(of[n], of[n + 1])
            out[k].append((hashes[own], begin[own] + at, end[own] + at))
        held.clear()

    for k, text in enumerate(texts):
        for at, part in _pieces(text):
            held.append((k, at, part))
            if sum(len(p) for _, _, p in held) >= CHUNK:
                hash_held()
    if held:
        hash_held()
    return [tuple(np.concatenate(c) for c in zip(*parts)) for parts in out]


def _passages(docs: DataFrame, words: int) -> DataFrame:
    """dk, ver, h, s0, s1, n: runs of windows of ``words`` words (by their first words) whose anchor's hash occurs again, and how many equal rows have
    each."""
    gram = min(WORD_GRAM, words)

    def run(batches):
        powers, inverse = _geometric(_BASE, CHUNK + words), _geometric(pow(_BASE, -1, 1 << 64), CHUNK + words)
        for whole in batches:
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                out: list[list] = [[] for _ in range(5)]
                for dk, ver, (hashes, _, _) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _worded([t.as_buffer().to_pybytes() for t in batch.column(2)])):
                    for at in range(0, len(hashes) - words + 1, CHUNK):
                        h, first, last = anchors(hashes[at : at + CHUNK + words - 1], words, gram, powers, inverse)
                        for column, value in zip(out, (np.full(len(h), dk), np.full(len(h), ver), h, first + at, last + at)):
                            column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["dk", "ver", "h", "s0", "s1"])

    long = docs.select(*_row(docs), F.col("text").cast("binary").alias("text")).where(F.length("text") >= 2 * words - 1)
    every = long.mapInArrow(run, "dk long, ver long, h long, s0 long, s1 long")
    met = every.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("met > 1")
    return met.groupBy("dk", "ver", "h", "s0", "s1").agg(F.count(F.lit(1)).alias("n"))


def _again(hashed: DataFrame) -> DataFrame:
    """dk, ver, ranges: runs of windows (by their first words) that occur again among those of one anchor."""

    def run(batches):
        for have, bounds in runs(batches, ["h"]):
            kept = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in have.column("bytes")), dtype=np.int64)
            size = pc.binary_length(have.column("bytes")).to_numpy().astype(np.int64) // 8
            of = np.repeat(np.arange(len(size)), size)
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[of]
            order = np.lexsort((kept, group))
            same = (kept[order][1:] == kept[order][:-1]) & (group[order][1:] == group[order][:-1])
            mark = np.zeros(len(kept) + 1, dtype=bool)
            mark[order[1:][same]] = mark[order[:-1][same]] = True
            mark = mark[:-1]
            new = np.concatenate([[True], of[1:] != of[:-1]])
            first = np.flatnonzero(mark & (new | ~np.concatenate([[False], mark[:-1]])))
            last = np.flatnonzero(mark & (np.append(new[1:], True) | ~np.append(mark[1:], False)))
            row, begin = of[first], np.concatenate([[0], np.cumsum(size)])[:-1]
            at = have.column("s0").to_numpy()[row] - begin[row]
            yield pa.RecordBatch.from_arrays([pa.array(have.column("g1").to_numpy()[row]), pa.array(have.column("g2").to_numpy()[row]), pa.array(first + at), pa.array(last + at)], ["dk", "ver", "a", "b"])

    dealt = hashed.repartition(partitions(hashed.sparkSession), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "dk long, ver long, a long, b long")


def _fetch(docs: DataFrame, wanted: DataFrame, length: int, words: int) -> DataFrame:
    """``wanted`` (dk, ver, view, h, g1, g2, s0, s1) as view, h, g1, g2, s0 with the bytes of each segment (view 0) or the hashes of its windows
    of ``words`` words, 8 bytes each (view 1)."""

    def run(batches):
        size = CHUNK + words
        powers, inverse = _geometric(_BASE, size), _geometric(pow(_BASE, -1, 1 << 64), size)

        def windows(text):
            ((hashes, _, _),) = _worded([text])
            return np.concatenate([_rolling(hashes[at : at + CHUNK + words - 1], words, powers, inverse) for at in range(0, len(hashes) - words + 1, CHUNK)])

        for batch in batches:
            for text, asked in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_buffer().to_pybytes()
                hashed = windows(text) if any(x["view"] for x in asked) else None
                part = lambda x: hashed[x["s0"] : x["s1"] + 1].tobytes() if x["view"] else text[x["s0"] : x["s1"] + length]
                yield pa.RecordBatch.from_pylist([{**{c: x[c] for c in schema.names[:-1]}, "bytes": part(x)} for x in asked], schema)

    schema = pa.schema([("view", pa.int32()), *((c, pa.int64()) for c in ("h", "g1", "g2", "s0")), ("bytes", pa.binary())])
    asked = wanted.groupBy("dk", "ver").agg(F.collect_list(F.struct("view", "h", "g1", "g2", "s0", "s1")).alias("asked"))  # of one document
    texts = docs.select(*_row(docs), F.col("text").cast("binary").alias("text")).where(F.length("text") >= (min(length, 2 * words - 1) if words else length))
    return texts.join(asked, ["dk", "ver"]).select("text", "asked").mapInArrow(run, "view int, h long, g1 long, g2 long, s0 long, bytes binary")


def _repeats(segments: DataFrame, length: int, budget: int, in_memory: int) -> DataFrame:
    """h, g1, g2, ranges: runs of windows (by their starts within the segment) that repeat among contents of one anchor.

    Segments stream into a shard, which is sorted when it holds SHARD bytes and the anchor changes; a shard of any size is.
    """

    def sort(shard, names):
        out = []
        for (h, g1, g2), mark in zip((x for part in names for x in part.tolist()), shard.repeated(length)):
            turn = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
            if len(turn):
                out.append({"h": h, "g1": g1, "g2": g2, "ranges": [{"a": int(a), "b": int(b) - 1} for a, b in zip(turn[::2], turn[1::2])]})
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("h", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])

    def run(batches):
        shard, names, last = Shard(budget, in_memory), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            name = np.stack([batch.column(c).to_numpy() for c in ("h", "g1", "g2")], axis=1)
            edges = np.flatnonzero(name[1:, 0] != name[:-1, 0]) + 1
            bounds = [0, *edges.tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                if shard.bytes >= SHARD and name[a, 0] != last:  # whole groups only
                    yield from sort(shard, names)
                    shard, names = Shard(budget, in_memory), []
                for k in range(a, b, ROWS):
                    some = slice(k, min(k + ROWS, b))
                    shard.add(batch.column("bytes").slice(k, some.stop - k).to_pylist())
                    names.append(name[some])
                last = name[a, 0]
        if names:
            yield from sort(shard, names)

    shards = segments.repartition(partitions(segments.sparkSession), "h").sortWithinPartitions("h", "g1", "g2")
    return shards.mapInArrow(run, "h long, g1 long, g2 long, ranges array<struct<a: long, b: long>>")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, budget: int = BUDGET, in_memory: int = IN_MEMORY, words: int = 0) -> DataFrame:
    """dk, ver, cuts: for each document with repeated strings the ranges (view, from, to) that they cover, unmerged, in bytes (view 0) or in
    words, where they are passages of ``words`` words (view 1)."""
    filed = table(_segments(docs, length, gram), "suffix-anchors")
    met = table(filed.groupBy("h").count().where("count > 1").select("h"), "suffix-met")
    every = table(filed.join(met, "h", "left_semi"), "suffix-candidates")
    discard(filed)
    rep = F.min(F.struct("dk", "ver", "s0", "s1")).alias("rep")
    contents = table(every.groupBy("h", "g1", "g2").agg(F.count(F.lit(1)).alias("n"), rep), "suffix-contents")
    mixed = table(contents.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h"), "suffix-mixed")
    wanted = contents.join(mixed, "h", "left_semi").select("rep.dk", "rep.ver", F.lit(0).alias("view"), "h", "g1", "g2", "rep.s0", "rep.s1")
    if words:
        passages = table(_passages(docs, words), "suffix-passages")
        wanted = wanted.unionByName(passages.select("dk", "ver", F.lit(1).alias("view"), "h", F.col("dk").alias("g1"), F.col("ver").alias("g2"), "s0", "s1"))
    fetched = table(_fetch(docs, wanted, length, words).dropDuplicates(["view", "h", "g1", "g2", "s0"]), "suffix-segments")
    segments = fetched.where("view = 0").select("h", "g1", "g2", "bytes")
    sorted_ = _repeats(segments, length, budget, in_memory)
    whole = contents.where("n > 1").select("h", "g1", "g2", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("rep.s1") - F.col("rep.s0")).alias("b"))).alias("ranges"))
    found = table(sorted_.unionByName(whole), "suffix-repeats")
    zero = F.lit(0).alias("view")
    back = every.join(found, ["h", "g1", "g2"]).select("dk", "ver", F.explode(F.transform("ranges", lambda r: F.struct(zero, (F.col("s0") + r["a"]).alias("lo"), (F.col("s0") + r["b"] + length).alias("hi")))).alias("cut"))
    if words:
        rows = passages.where("n > 1").select("dk", "ver", F.col("s0").alias("a"), F.col("s1").alias("b"))
        again = _again(fetched.where("view = 1").select("h", "g1", "g2", "s0", "bytes")).unionByName(rows)
        back = back.unionByName(again.select("dk", "ver", F.struct(F.lit(1).alias("view"), F.col("a").alias("lo"), (F.col("b") + words).alias("hi")).alias("cut")))
    return back.groupBy("dk", "ver").agg(F.collect_set("cut").alias("cuts"))  # ranges of one document


def merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges, in order, with what touches joined."""
    out: list[list[int]] = []
    for lo, hi in sorted(cuts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _spans(text: bytes, cuts: list[dict] | None) -> list[tuple[int, int]]:
    """The byte ranges of ``text`` that its cuts, of either view, cover."""
    out = [(c["lo"], c["hi"]) for c in cuts or () if not c["view"]]
    passages = merged([(c["lo"], c["hi"]) for c in cuts or () if c["view"]])
    if passages:
        ((_, begin, end),) = _worded([text])
        out += [(int(begin[lo]), int(end[hi - 1])) for lo, hi in passages]
    return merged(out)


def _left(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in spans:
        parts.append(text[at:lo])
        at = hi
    return b"".join([*parts, text[at:]])


def _marked(docs: DataFrame, length: int, gram: int, keep: list[str], budget: int = BUDGET, in_memory: int = IN_MEMORY, words: int = 0) -> DataFrame:
    """The columns ``keep``, and under names of their own the text's bytes, whether it is null, and its cuts."""
    own = ["__text", "__null", "__cuts"]
    cuts = table(repeated_ranges(docs, length, gram, budget, in_memory, words), "suffix-cuts").toDF("__dk", "__ver", "__cuts")
    dk, ver = _row(docs)
    texts = docs.select(dk.alias("__dk"), ver.alias("__ver"), F.coalesce("text", F.lit("")).cast("binary").alias("__text"), F.col("text").isNull().alias("__null"), *keep)
    return texts.join(cuts, ["__dk", "__ver"], "left").select(*own, *keep)


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, budget: int = BUDGET, in_memory: int = IN_MEMORY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is left) for every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes; a null text is an empty one. Texts under ``length`` bytes lose nothing. Rows that repeat lose what
    they have in common with each other. A removed run may end within a character: n_removed and kept_sha256 go by bytes, while text
    leaves out what remains of such a character. Ids may be of any type, and null.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, cuts in zip(batch.column("__text"), batch.column("__cuts")):
                text = text.as_buffer().to_pybytes()
                spans = _spans(text, cuts.as_py())
                left = _left(text, spans)
                for column, value in zip(out, (len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return _marked(docs, length, gram, ["doc_id"], budget, in_memory).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = 0) -> DataFrame:
    """``docs`` with what repeats taken out of ``text``; bytes of characters that a cut splits go as well.

    With ``words``, passages of so many words that repeat go too, however few bytes they have; letter case (A-Z) and the white space between
    words don't count there, and a text that has lost something and has only white space left becomes empty. A null text stays null. All
    other columns stay as they are.
    """
    rest = [c for c in docs.columns if c != "text"]

    def left(text: bytes, cuts: list[dict] | None) -> str:
        out = _left(text, _spans(text, cuts)).decode("utf-8", "ignore")
        return out if not words or not cuts or out.strip(" \t\n\v\f\r") else ""

    def run(batches):
        for batch in batches:
            texts = [None if null.as_py() else left(t.as_buffer().to_pybytes(), cuts.as_py()) for t, cuts, null in zip(batch.column("__text"), batch.column("__cuts"), batch.column("__null"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, "text"])

    marked = _marked(docs, length, gram, rest, words=words)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*rest).dtypes) + ", text string"
    return marked.mapInArrow(run, schema).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
