"""Operators on vectors and pages against brute force and round trips."""

import base64
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from graphweft.llm import lattice, topk, warc
from graphweft.llm.common import connected_components
from tests.llm.test_documents import closure


def vectors(spark, seed=0, n=120, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=d)
        if k % 3 == 1:
            v = np.array(rows[k - 1][1]) * 2 + rng.normal(size=d) * 0.1
        rows.append((k, [float(np.float32(x)) for x in v], int((k // 3) % 4)))
    rows[10] = (10, rows[9][1], rows[9][2])
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * d, 1), (203, [float("nan")] * d, 1), (204, [None, *[1.0] * (d - 1)], 1), (205, rows[0][1], None), (206, rows[0][1][:8], 0), (207, [float("inf")] * d, 1), rows[4], (None, rows[0][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"cell": F.lit(1), "m": F.lit(2), "n": F.lit(3)})


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_lattice(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CELL_ROWS", 8)
    rows, df = vectors(spark)
    rows += [(0, rows[100][1], rows[100][2]), (0, [-x for x in rows[0][1]], rows[0][2]), (0, rows[0][1], rows[0][2])]  # one id, several vectors
    df = df.unionByName(spark.createDataFrame(rows[-3:], "vec_id long, embedding array<float>, label int").withColumns({"cell": F.lit(1), "m": F.lit(2), "n": F.lit(3)}))
    got = lattice.near_duplicates(df).collect()
    assert len(got) == len(rows)
    good = [(i, r) for i, r in enumerate(rows) if r[0] is not None and r[2] is not None and usable(r[1]) and any(r[1])]
    n, links = {i: 0 for i in range(len(rows))}, []
    for i, a in good:
        for j, b in good:
            if i < j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    links.append((a[0], b[0]))
    assert links
    part = closure([r[0] for _, r in good], links)
    want = sorted([(r[0], n[i], part.get(r[0], r[0]), r[0] is not None and part.get(r[0], r[0]) == r[0]) for i, r in enumerate(rows)], key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert lattice.near_duplicates(df.where("false")).collect() == []


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(300, 8)) * 2
    p, short = lattice.decode(y), lattice.minimal_vectors()
    assert len(short) == 240 and np.allclose((short**2).sum(axis=1), 2)
    near = ((y - p) ** 2).sum(axis=1)
    assert all((((y - p - v) ** 2).sum(axis=1) >= near - 1e-9).all() for v in short)
    assert (near <= 1 + 1e-9).all()


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEEDS", 16)
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rows, df = vectors(spark)
    more = [(300, [1e30] * 16, 1), (310, [-1e30] * 16, 1), (50, rows[51][1], 1)]  # scores beyond 64 bits, an id that asks twice
    df = df.unionByName(spark.createDataFrame(more, "vec_id long, embedding array<float>, label int").withColumns({"cell": F.lit(1), "m": F.lit(2), "ask": F.lit(3)}).withColumnRenamed("ask", "n"))
    got = topk.search(df, F.col("vec_id") % 10 == 0).collect()
    whole = [(r[0], [int(np.floor(1024 * float(np.float32(x)))) for x in r[1]]) for r in rows + more if r[0] is not None and usable(r[1])]
    clip = lambda s: max(min(s, 2**63 - 1), -(2**63))
    want = []
    for q, x in whole:
        if q % 10 == 0:
            scored = sorted((-clip(sum(a * b for a, b in zip(x, v))), c) for c, v in whole if c != q and len(v) == len(x))[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.search(df.where("false"), F.col("vec_id") % 10 == 0).collect() == []


def test_topk_leaves_light_terms_out(monkeypatch):
    """Few heavy terms: only their best postings are traversed, and the answer is that of scoring every row."""
    monkeypatch.setattr(topk, "SEEDS", 64)
    rng = np.random.default_rng(4)
    values = np.floor(rng.pareto(1.5, size=(3000, 24)) * 40 * (rng.random((3000, 24)) < 0.1)).astype(np.int64)
    values[rng.random(values.shape) < 0.01] *= -1
    shard, seen = topk.Shard(np.arange(3000)[::-1], values), []
    kept = shard._candidates
    shard._candidates = lambda *a: seen.append(kept(*a)) or seen[-1]
    for own in range(0, 3000, 100):
        query = values[2999 - own] * np.where(rng.random(24) < 0.2, -1, 1)
        ids, scores = shard.top(own, query, 10)
        every = sorted((-int(v @ query), 2999 - i) for i, v in enumerate(values) if 2999 - i != own)[:10]
        assert list(zip((-scores).tolist(), ids.tolist())) == every
    assert min(map(len, seen)) < 300 and np.mean([len(x) for x in seen]) < 2000


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    want = closure({n for e in edges for n in e}, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == want[n] for n in got) and {n for n in want if want[n] != n} <= set(got)


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/é b", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "y" * 700_000), (6, "u", "line\r\n\r\nWARC/1.1\r\n"), (6, "u", "line\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>x</p>"), (None, "u", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "first": F.lit(2)})
    folder = str(tmp_path / "bundles")
    index = warc.write(df, folder)
    back = warc.read(index, folder)
    found = {(r.record, bytes(r.payload).decode()) for r in back.collect() if r.record_type == "response"}
    assert {("5", "y" * 700_000), ("1", "<p>x</p>"), ("3", "")} <= found
    got = sorted(map(tuple, warc.digest_rows(df, str(tmp_path / "again")).collect()), key=repr)
    first: dict = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in pages:
        h = h or ""
        f = first.get(h)
        want.append((p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if p == f else "revisit", None if p == f else f))
    assert got == sorted(want, key=repr)
    # the seek table alone finds each frame, and each frame stands alone
    import zstandard

    fs, path = warc.open_store(folder)
    for info in fs.get_file_info(__import__("pyarrow.fs").fs.FileSelector(path)):
        data = open(info.path, "rb").read()
        plain = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + n]) for a, n, _ in warc.seek_table(fs, info.path))
        assert plain.count(b"WARC-Record-ID") >= 1 and zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == plain
    assert warc.digest_rows(df.where("false"), str(tmp_path / "none")).collect() == []
