"""Operators on documents against brute force, on a corpus of odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphweft.llm import induced, language, minhash, mixing, packing, quality, suffix, windows
from tests.llm.fixtures import SCHEMA, corpus, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def closure(nodes, links):
    part = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(part[a], part[b])
            changed |= part[a] != low or part[b] != low
            part[a] = part[b] = low
    return part


def shingle_set(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_minhash_components(spark):
    got = minhash.components(frame(spark)).collect()
    rows = corpus()
    assert len(got) == len(rows)
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert (2, 3) in links and (4, 5) in links and (6, 7) in links and (27, 28) in links
    want = closure(sets, links)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(sets[r.doc_id]))


def test_minhash_dense_group_in_parts(spark, monkeypatch):
    """A group far over the size that one task compares, of near copies that mostly don't link directly."""
    monkeypatch.setattr(minhash, "GROUP", 16)
    rng = random.Random(5)
    base = sentence(rng, 120).split()
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w), "en", "s", 1))
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    want = closure(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in minhash.components(frame(spark, rows)).collect()} == want


def test_suffix_digests(spark):
    for length, gram, budget, in_memory in ((400, 32, induced.BUDGET, induced.IN_MEMORY), (40, 8, 1 << 10, 50)):  # the latter on files, by recursion
        got = suffix.digests(frame(spark), length, gram, budget, in_memory).collect()
        rows = corpus()
        data = [(r[1] or "").encode() for r in rows]
        seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
        want = []
        for r, t in zip(rows, data):
            gone = bytearray(len(t))
            for i in range(len(t) - length + 1):
                if seen[t[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
            spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
            left = bytes(c for c, g in zip(t, gone) if not g)
            want.append((r[0], len(t), sum(gone), spans, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        assert any(w[2] for w in want)


def test_suffix_strip_keeps_columns(spark):
    df = frame(spark)
    out = suffix.strip(df, 40, 8)
    assert out.columns == df.columns
    assert sum(r.text is None for r in out.collect()) == sum(r[1] is None for r in corpus())


@pytest.mark.parametrize("budget,in_memory,block", [(1 << 20, 1 << 20, 1 << 20), (0, 1 << 20, 1 << 20), (0, 3, 1 << 20), (100, 0, 3)])
def test_induced_sorting(budget, in_memory, block, monkeypatch):
    monkeypatch.setattr(induced, "BLOCK", block)
    rng = random.Random(1)
    for trial in range(60):
        t = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(1, 60))] + [0]
        order = sorted(range(len(t)), key=lambda i: t[i:])
        common = [0] + [next((k for k in range(len(t)) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), 0) for a, b in zip(order, order[1:])]
        sa, lcp = induced.suffixes(np.array(t, dtype=np.uint16), 1000, budget, in_memory)
        assert (sa.tolist(), lcp.tolist()) == (order, common)


def test_a_shard_larger_than_its_budget():
    """Queues, text and results lie in files, and names are sorted by induction."""
    rng = random.Random(8)
    parts = [bytes(rng.choices(b"abcd", k=rng.randint(40, 900))) for _ in range(300)]
    segments = [p + rng.choice(parts)[:60] + p[::-1] for p in parts]
    plain, spilled = induced.Shard(), induced.Shard(1 << 14, 500)
    for s in (plain, spilled):
        s.add(segments)
    for mine, other in zip(plain.repeated(40), spilled.repeated(40), strict=True):
        assert (mine == other).all()
    assert plain.spool.spilled == 0 and spilled.spool.spilled > 10 * len(b"".join(segments))


def test_mixing(spark):
    got = mixing.mix(frame(spark)).collect()
    rows = corpus()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows)
    again = mixing.mix(frame(spark)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.target, r.source_size][0] += r.taken
        by[r.target, r.source_size][2] = max(by[r.target, r.source_size][2], r.size)
    sizes = defaultdict(int)
    for r, (_, text, _, source, _) in zip(sorted(got, key=lambda r: repr((r.doc_id, r.size))), sorted(rows, key=lambda r: repr((r[0], len(WORD.findall(r[1] or "")))))):
        sizes[r.target, r.source_size] = max(sizes[r.target, r.source_size], r.size)
    for key, (taken, _, _) in by.items():  # half of a very long document at most
        assert abs(taken - key[0]) <= max(200, sizes[key] / 2)
    whole = sum(len(WORD.findall(r[1] or "")) for r in rows)
    assert sum(t for t, _ in by) == pytest.approx(1.5 * whole)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    odd = [(100 + k, t, "en", "s", 1) for k, t in enumerate(["It's 'TIS rock'n'roll!'s", "“Quoted” — 12½ x²", "日本語。テスト", "İ'S K Å", "<|endoftext|> a<|startoftext|>", "<|ENDOFTEXT|>", "\x1c a\x85b"])]
    rows = corpus() + odd
    got = packing.pack(frame(spark, rows)).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, k in enumerate(range(0, len(ids), 2048)):
            part = ids[k : k + 2048]
            want[doc, p, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1


def test_language(spark):
    rng = random.Random(2)
    make = {"a": lambda n: " ".join("".join(rng.choice("kotenari") for _ in range(5)) for _ in range(n)), "b": lambda n: " ".join("".join(rng.choice("bumilowe") for _ in range(5)) for _ in range(n))}
    rows = [(k, make["ab"[k % 2]](60), "ab"[k % 2], "s", 1) for k in range(60)]
    rows += [(100, f"{make['a'](70)} {make['b'](30)}", None, "s", 1), (101, None, "a", "s", 1), (102, "12 !!", "a", "s", 1), (103, "", "b", "s", 1)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in language.detect(df, language.train(df.where("doc_id < 40")), ["doc_id", "key"]).collect()}
    assert all(got[k].lang_pred == "ab"[k % 2] and 0 <= got[k].score <= 1 for k in range(60))
    assert got[100].lang_pred == "a" and got[100].languages["b"] == pytest.approx(0.3, abs=0.08)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (101, 102, 103))
    none = language.detect(df, language.train(df.where("false"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: sentence(rng, 80)
    rows = [(k, good() if k % 2 else " ".join(w.upper() + "!!" for w in good().split()), "en", "s", 1) for k in range(120)]
    rows += [(500, None, None, None, 0), (501, "", None, None, 0)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(7, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(df, quality.fit(df, labels), ["doc_id"]).collect()}
    assert sum(got[k].predicted == k % 2 for k in range(80, 120)) >= 38
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    flat = quality.score(df, quality.fit(df, labels.where("false")), ["doc_id"]).collect()
    assert {r.score for r in flat} == {0.5}


def test_language_counts_and_mixture_step_by_step(spark):
    """Trained probabilities against counting one n-gram at a time, and the mixture against a slow EM."""

    def slow_grams(word):
        c = [0, *(ord(x) if x.isalpha() else 0 for x in word), 0]
        out = []
        for n in (2, 3):
            for k in range(len(c) - n + 1):
                if any(c[k : k + n]):
                    h = n
                    for x in c[k : k + n]:
                        h = (h ^ x) * 0x9E3779B97F4A7C15 % 2**64
                        h ^= h >> 29
                    out.append((h >> 40) % language.BUCKETS)
        return out

    rows = [(1, "Ett hus, ETT hus\nvid å7ån", "sv", "s", 1), (2, "the house of the 'hill' x", "en", "s", 1), (3, "hus 12 !!", "sv", "s", 1), (4, "left out", None, "s", 1), (5, None, "en", "s", 1), (6, "", "de", "s", 1), (2, "the house of the 'hill' x", "en", "s", 1)]
    langs, logp = language.train(frame(spark, rows))
    assert langs == ["de", "en", "sv"]
    for lang, got in zip(langs, logp):
        seen = Counter(g for _, t, own, *_ in rows if own == lang and t for w in t.lower().split() for g in slow_grams(w))
        n = np.array([seen[b] for b in range(language.BUCKETS)])
        assert np.allclose(got, np.log((n + language.SMOOTH) / (n.sum() + language.SMOOTH * language.BUCKETS)), atol=1e-5)

    rng = np.random.default_rng(3)
    for _ in range(20):
        like = np.log(rng.random((40, 4))) * 3
        like[:20, 0] += 6
        like[20:32, 2] += 6
        chosen, share = language.proportions(like)
        slow = [1 / len(chosen)] * len(chosen)
        for _ in range(language.STEPS):
            total = [0.0] * len(chosen)
            for word in like[:, chosen].tolist():
                parts = [s * np.exp(x - max(word)) for s, x in zip(slow, word)]
                total = [t + p / sum(parts) for t, p in zip(total, parts)]
            slow = [t / len(like) for t in total]
        assert sorted(chosen.tolist())[:2] == [0, 2] and share == pytest.approx(slow, abs=2e-3)
        # a further language is in the set only if it is worth its price, and none that is left out would be
        value = lambda some: language._em(like[:, list(some)])[1]
        price = language.PENALTY * np.log(41)
        assert value(chosen) - value(chosen[:-1]) > price
        assert all(value([*chosen, j]) - value(chosen) <= price for j in range(4) if j not in chosen)


def test_quality_vectors_one_neighbour_at_a_time(spark):
    """Random-index vectors, pooling and the gradient against loops."""
    rng = random.Random(6)
    rows = [(k, sentence(rng, rng.randint(1, 30)), "en", "s", 1) for k in range(150)] + [(500, None, None, None, 0), (501, "", None, None, 0), (502, "One", None, None, 0)]
    fixed, buckets = quality.index_vectors().astype(np.float64), quality._Buckets()
    context = np.zeros_like(fixed)
    for _, text, *_ in rows:
        both = [(b % quality.WORDS, quality.WORDS + b // quality.WORDS) for b in buckets.of(text).tolist()]
        for i, own in enumerate(both):
            for j in range(max(0, i - quality.REACH), min(len(both), i + quality.REACH + 1)):
                if i != j:
                    for b in own:
                        context[b] += fixed[both[j][0]] + fixed[both[j][1]]
    want = np.array([c / max(np.linalg.norm(c), 1e-9) + f / max(np.linalg.norm(f), 1e-9) for c, f in zip(context, fixed)])
    got = quality.word_vectors(frame(spark, rows))
    assert np.allclose(got, want, atol=1e-5)
    for _, text, *_ in rows[:5]:
        words = [quality._Buckets().of(w)[0] for w in text.split()]
        mean = [sum(got[w % quality.WORDS] for w in words) / len(words), sum(got[w // quality.WORDS + quality.WORDS] for w in words) / len(words)]
        assert np.allclose(quality._pool(buckets.of(text), got), [*mean[0], *mean[1], np.log(1 + len(words))], atol=1e-4)
    # a network that has learned is surer of what it gets right, and its heat is the best of those tried on the rows kept apart
    x = np.random.default_rng(1).normal(size=(400, 2 * quality.SIZE + 1))
    y = (x[:, 0] + 0.5 * x[:, 1] + np.random.default_rng(2).normal(size=400) > 0).astype(float)
    net = quality.Network(x, y)
    held = np.random.default_rng(quality.SEED)
    held.normal(0, 1, net.w[0].shape), held.normal(0, 1, net.w[2].shape)
    apart = held.random(400) < 0.2
    loss = lambda heat: np.mean([np.log1p(np.exp(-(2 * b - 1) * a / heat)) for a, b in zip(net.logit(x[apart]), y[apart])])
    assert loss(net.heat) <= min(map(loss, (0.25, 0.5, 1, 2, 4, 8))) + 1e-3
    assert ((net.probability(x) >= 0.5) == y).mean() > 0.8


def test_compact_windows_are_the_tree():
    rng = np.random.default_rng(0)

    def tree(h, w, a, b, out):
        if b - a + 1 >= w:
            c = a + int(np.argmin(h[a : b + 1]))
            if h[c] > 0:
                out.append((a, c, b))
            tree(h, w, a, c - 1, out)
            tree(h, w, c + 1, b, out)
        return sorted(out)

    for t in range(200):
        h = rng.integers(t % 2, (6, 500)[t % 2], rng.integers(1, 100)).astype(np.uint64)
        w = int(rng.integers(1, 20))
        assert sorted(zip(*(x.tolist() for x in windows.compact_windows(h, w)))) == tree(h, w, 0, len(h) - 1, [])


def test_passages(spark):
    got = windows.passages(frame(spark)).collect()
    texts = {r[0]: r[1] for r in corpus()}
    pairs = {frozenset((r.doc_id, r.other_doc_id)) for r in got}
    assert {frozenset((2, 3)), frozenset((4, 5)), frozenset((6, 7))} <= pairs
    assert {2, 3, 4, 5, 6, 7, 8, 9, 10} <= {r.doc_id for r in got}
    exact = defaultdict(set)
    for k, t in texts.items():
        w = WORD.findall(lower(t))
        for i in range(len(w) - 49):
            exact[tuple(w[i : i + 50])].add(k)
    assert {k for s in exact.values() if len(s) > 1 for k in s} <= {r.doc_id for r in got}
    for r in got:
        assert r.n_words >= 50 and r.similarity >= 0.8
        if r.doc_id is not None and r.other_doc_id is not None:
            a, b = (shingle_set(texts[d].encode()[x:y].decode()) for d, x, y in ((r.doc_id, r.byte_from, r.byte_to), (r.other_doc_id, r.other_from, r.other_to)))
            assert len(a & b) / len(a | b) == pytest.approx(r.similarity)
    clean = {k for k in range(11, 24)} - {11}
    assert not clean & {d for r in got for d in (r.doc_id, r.other_doc_id)}


def test_ranges_are_trimmed_to_what_they_share():
    """Windows overhang on both sides; a passage with a changed, an added and a missing item is cut out of them."""
    rng = np.random.default_rng(7)
    own = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    same = own(60)
    for other, ends in ((same, (60, 60)), (np.concatenate([same[:30], own(1), same[31:]]), (60, 60)), (np.concatenate([same[:30], own(1), same[30:]]), (60, 61)), (np.delete(same, 30), (60, 59))):
        x, y = np.concatenate([own(25), same, own(40)]), np.concatenate([own(25), other, own(40)])
        assert [r[:4] for r in windows.aligned(x, y, -16, 16, 46, 80)] == [(25, 24 + ends[0], 25, 24 + ends[1])]
    # two passages too far apart to be one, and one that is too short
    x, y = (np.concatenate([same, own(40), same[::-1], own(9), own(9)]) for _ in range(2))
    assert [r[:2] for r in windows.aligned(x, y, -16, 16, 46, 80)] == [(0, 59), (100, 159)]
    assert not windows.aligned(np.concatenate([own(25), same[:40], own(40)]), np.concatenate([own(25), same[:40], own(40)]), -16, 16, 46, 80)
    # the ends of a passage may be what differs
    x, y = (np.concatenate([own(30), same[:44], own(30)]) for _ in range(2))
    (found,) = windows.aligned(x, y, -16, 16, 46, 80)
    assert found[1] - found[0] == 45 and found[4] == pytest.approx(44 / 48)


def test_a_window_counts_in_every_range_it_covers():
    """Windows of 146 shared shingles: a narrow one doesn't use up those that cover the rest too."""
    l, r = np.array([0, 0, 0, 0, 0, 0, 0, 0, 74]), np.array([72, 119, 129, 139, 145, 145, 145, 145, 145])
    c, f = np.array([50, 51, 52, 53, 60, 61, 62, 63, 100]), np.array([0, 1, 2, 3, 0, 1, 2, 3, 0])
    got = [v.tolist() for v in windows.joined(np.zeros(9, np.int64), f, [l, c, r, l + 9, c + 9, r + 9], 46, 2)]
    assert got == [[0], [0], [145], [9], [154], [-9], [-9]]
    # two functions with their least value at one place are two; one window alone isn't enough
    two = [np.array([v, v]) for v in (0, 20, 60, 5, 25, 65)]
    assert len(windows.joined(np.zeros(2, np.int64), np.array([0, 1]), two, 46, 2)[0]) == 1
    assert len(windows.joined(np.zeros(2, np.int64), np.array([1, 1]), two, 46, 2)[0]) == 0
    assert len(windows.joined(np.array([0, 1]), np.array([0, 1]), two, 46, 2)[0]) == 0


def test_isolated_passages_are_found_whole(spark):
    """Passages alone in long unrelated texts, exact and with one word changed, from the shortest length on."""
    rng, rows, sizes = random.Random(11), [], [50, 55, 60, 65, 70, 100, 150, 400]
    for k, n in enumerate(sizes * 4):
        words = sentence(rng, n).split()
        copy = words if k // len(sizes) % 2 == 0 else [*words[: n // 2], "changed", *words[n // 2 + 1 :]]
        for i, own in ((2 * k, words), (2 * k + 1, copy)):
            rows.append((i, f"{sentence(rng, rng.randint(100, 300))} {' '.join(own)} {sentence(rng, rng.randint(100, 300))}"))
    found = defaultdict(set)
    for r in windows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.doc_id // 2 == r.other_doc_id // 2
        found[r.doc_id // 2] |= set(range(r.byte_from, r.byte_to))
    assert set(found) == set(range(len(sizes) * 4))
    for k, n in enumerate(sizes * 4):
        assert len(found[k]) >= 0.9 * n * 4


def test_similar_passages_on_which_one_function_agrees(spark):
    """Passages of 60 words, one of them changed, in texts where windows of one function alone agree; all reach 80 percent."""
    rows = []
    for k in (25, 176, 234, 493):
        rng = random.Random(k)
        words = sentence(rng, 60).split()
        for i, own in ((2 * k, words), (2 * k + 1, [*words[:30], "changed", *words[31:]])):
            rows.append((i, f"{sentence(rng, 150)} {' '.join(own)} {sentence(rng, 150)}"))
    got = windows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_doc_id) for r in got} == {(2 * k + i, 2 * k + 1 - i) for k in (25, 176, 234, 493) for i in (0, 1)}


def test_empty_tables(spark):
    df = frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    assert df.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    for out in (minhash.components(df), suffix.digests(df), mixing.mix(df), packing.pack(df), windows.passages(df), language.detect(df, language.train(df)), quality.score(df, quality.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")), ["doc_id"])):
        assert out.collect() == []
