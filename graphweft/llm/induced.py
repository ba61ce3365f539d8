"""Suffix sorting with common-prefix values by external induced sorting.

Suffixes that begin a rising run (S*) are sorted first: their substrings get names by one induction, and the string of
names is sorted recursively, by induction in its turn while it has more than ``in_memory`` names. Then two sweeps over the first
characters induce all other suffixes. What a sweep pops and pushes is a monotone priority queue: keys are characters in sweep order,
entries of one key leave in the order they came. Entries are (suffix, common prefix with the entry before) and move in blocks; a pushed
entry's common prefix is one more than the least value popped since the last push to the same character.

Text, types, names and results are arrays that lie in files beyond the memory budget, like queue blocks; they are read and written
in chunks. Files have no name, vanish with the task and lie where Spark spills. Besides a chunk, memory holds the entries of one
character at a time and some numbers for each character of the alphabet at hand.

Values are exact up to ``cap``; suffixes that agree in ``cap`` characters may stand in any order.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of arrays and queue entries in memory, entries moved at once, and names up to which a recursion is sorted in memory.
BUDGET, BLOCK, IN_MEMORY = 64 << 20, 1 << 20, 1 << 23
_FAR = np.int32(2**30)


def scratch_file():
    """A file without a name where Spark spills (a task's scratch, read by no one else)."""
    for name in ("SPARK_LOCAL_DIRS", "LOCAL_DIRS"):
        folder = os.environ.get(name, "").split(",")[0]
        if folder and os.path.isdir(folder):
            return tempfile.TemporaryFile(dir=folder)
    return tempfile.TemporaryFile()


class Spool:
    """Arrays and blocks of entries, in memory up to a budget and in files beyond it."""

    def __init__(self, budget: int = BUDGET):
        self.left, self.file, self.spilled = budget, None, 0

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.left:
            self.left -= size
            return np.zeros(n, dtype=dtype)
        self.spilled += size
        with scratch_file() as f:
            f.truncate(max(size, 1))
            return np.memmap(f, dtype=dtype, mode="r+", shape=(n,))

    def put(self, *arrays: np.ndarray):
        size = sum(a.nbytes for a in arrays)
        if size <= self.left:
            self.left -= size
            return arrays
        self.file = self.file or scratch_file()
        self.spilled += size
        at = self.file.seek(0, 2)
        for a in arrays:
            self.file.write(a.tobytes())
        return at, [(a.dtype, len(a)) for a in arrays]

    def get(self, block):
        if isinstance(block[0], np.ndarray):
            return block
        self.file.seek(block[0])
        return tuple(np.frombuffer(self.file.read(t.itemsize * n), dtype=t) for t, n in block[1])


def _chunks(n: int):
    return ((k, min(k + BLOCK, n)) for k in range(0, n, BLOCK))


class Queue:
    """Blocks by character; entries of a character leave in the order they came."""

    def __init__(self, spool: Spool):
        self.spool, self.blocks = spool, {}

    def push(self, c: int, *arrays: np.ndarray) -> None:
        self.blocks.setdefault(c, []).append(self.spool.put(*arrays))

    def drain(self, c: int):
        """All blocks of a character, also those that come while it is drained."""
        k = 0
        while k < len(self.blocks.get(c, ())):
            some, size = [], 0
            while k < len(self.blocks[c]) and size < BLOCK:
                some.append(self.spool.get(self.blocks[c][k]))
                size += len(some[-1][0])
                k += 1
            yield some[0] if len(some) == 1 else tuple(np.concatenate([b[i] for b in some]) for i in range(len(some[0])))

    def all(self, c: int, kind) -> tuple[np.ndarray, np.ndarray]:
        got = list(self.drain(c))
        if not got:
            return np.zeros(0, kind), np.zeros(0, np.int32)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _types(t: np.ndarray, small: np.ndarray) -> None:
    """Whether each suffix is smaller than the next; the last character is the only least one."""
    carry = small[len(t) - 1] = True
    for hi in range(len(t) - 1, 0, -BLOCK):
        lo = max(0, hi - BLOCK)
        step = np.diff(np.asarray(t[lo : hi + 1]).astype(np.int64))
        at = np.where(step != 0, np.arange(len(step)), len(step))
        turn = np.minimum.accumulate(at[::-1])[::-1]
        small[lo:hi] = found = np.where(turn < len(step), step[np.minimum(turn, len(step) - 1)] > 0, carry)
        carry = bool(found[0])


def _common(t: np.ndarray, i: int, j: int, cap: int) -> int:
    n = min(cap, len(t) - max(i, j))
    differ = t[i : i + n] != t[j : j + n]
    k = int(differ.argmax()) if n else 0
    return k if n and differ[k] else n


class _Sweep:
    """One direction of induction: pushes the predecessors of popped suffixes that have the wanted type."""

    def __init__(self, t, small, wanted, queue, cap, sigma, values):
        self.t, self.small, self.wanted, self.queue, self.cap, self.values = t, small, wanted, queue, cap, values
        self.carry, self.pushed = np.zeros(sigma, dtype=np.int32), np.zeros(0, np.int64)  # since the character at hand began

    def new_character(self) -> None:
        self.carry[self.pushed] = 0
        self.pushed = self.pushed[:0]

    def pop(self, at: np.ndarray, common: np.ndarray) -> None:
        for k in range(0, len(at), BLOCK):
            self._pop(at[k : k + BLOCK], common[k : k + BLOCK])

    def _pop(self, at: np.ndarray, common: np.ndarray) -> None:
        before = at - 1
        ok = np.flatnonzero((before >= 0) & (np.asarray(self.small[before]) == self.wanted))
        if not len(ok):
            if self.values and len(common):
                self.carry[self.pushed] = np.minimum(self.carry[self.pushed], common.min())
            return
        to = np.asarray(self.t[before[ok]])
        order = np.argsort(to, kind="stable")
        ok, to = ok[order], to[order]
        first = np.concatenate([[True], to[1:] != to[:-1]])
        heads = np.flatnonzero(first)
        chars = to[heads].astype(np.int64)
        if self.values:
            start = np.where(first, 0, np.concatenate([[0], ok[:-1] + 1]))
            padded = np.append(common, _FAR)
            low = np.minimum.reduceat(padded, np.stack([start, ok + 1], axis=1).ravel())[::2]
            low[heads] = np.minimum(low[heads], self.carry[chars])
            value = np.minimum(low + 1, self.cap).astype(np.int32)
            self.carry[self.pushed] = np.minimum(self.carry[self.pushed], common.min())
            self.pushed = np.union1d(self.pushed, chars)
            last = ok[np.append(heads[1:], len(ok)) - 1]
            self.carry[chars] = np.minimum.accumulate(padded[::-1])[::-1][last + 1]
        else:
            value = np.zeros(len(ok), np.int32)
        out, ends = before[ok], np.append(heads[1:], len(ok))
        for c, a, b in zip(chars.tolist(), heads.tolist(), ends.tolist()):
            self.queue.push(c, out[a:b], value[a:b])


def _induce(t, small, stars, star_common, cap, sigma, values, spool):
    """All suffixes in order with their common prefixes, from S* suffixes in order. Yields (suffixes, values)."""
    kind = stars.dtype
    up, down = Queue(spool), Queue(spool)
    times, heads = np.zeros(sigma, np.int64), np.zeros(sigma, np.int64)
    for a, b in _chunks(len(t)):
        times += np.bincount(t[a:b], minlength=sigma)
    for a, b in _chunks(len(stars)):
        heads += np.bincount(t[stars[a:b]], minlength=sigma)
    present, bounds = np.flatnonzero(times).tolist(), np.concatenate([[0], np.cumsum(heads)])
    sweep = _Sweep(t, small, False, up, cap, sigma, values)
    for c in present:
        sweep.new_character()
        last = None
        for at, common in up.drain(c):
            sweep.pop(at, common)
            last = int(at[-1])
        a, b = int(bounds[c]), int(bounds[c + 1])
        for k, n in ((k, min(k + BLOCK, b)) for k in range(a, b, BLOCK)):
            at = np.array(stars[k:n])
            common = np.array(star_common[k:n]) if values else np.zeros(n - k, np.int32)
            if k == a:
                common[0] = _common(t, last, int(at[0]), cap) if last is not None and values else 0
            sweep.pop(at, common)
    sweep = _Sweep(t, small, True, down, cap, sigma, values)
    out = []
    for c in reversed(present):
        sweep.new_character()
        last = None
        for at, common in down.drain(c):
            sweep.pop(at, common)
            last = int(at[-1])
        large, common = up.all(c, kind)
        joint = 0
        if len(large):
            if last is not None and values:
                joint = _common(t, last, int(large[-1]), cap)
            sweep.pop(large[::-1], np.concatenate([[joint], common[:0:-1]]).astype(np.int32))
        rising, value = down.all(c, kind)
        if c == 0:
            rising, value = np.array([len(t) - 1], kind), np.zeros(1, np.int32)
        seq = np.concatenate([large, rising[::-1]])
        val = np.concatenate([common, [joint] if len(rising) else [], value[:0:-1]]).astype(np.int32)
        if len(val):
            val[0] = 0
        out.append(spool.put(seq, val))
    for block in reversed(out):
        yield spool.get(block)


def _doubling(names: np.ndarray, reach: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of ``names`` by their first ``reach`` names at least, and ranks by their first 1, 2, 4 ... names."""
    m = len(names)
    ranks, k = [np.unique(names, return_inverse=True)[1].astype(np.int64)], 1
    while k < reach and ranks[-1].max() < m - 1:
        rank = ranks[-1]
        follow = np.zeros(m, np.int64)
        follow[: m - k] = rank[k:] + 1
        key = rank * (m + 1) + follow
        order = np.argsort(key)
        key = key[order]
        new = np.empty(m, np.int64)
        new[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        ranks.append(new)
        k *= 2
    return np.argsort(ranks[-1]), ranks


def _by_first(t, stars, sigma, spool) -> np.ndarray:
    """S* suffixes by their first character, those of one character as they stand."""
    out, upto = spool.array(len(stars), stars.dtype), np.zeros(sigma + 1, np.int64)
    for a, b in _chunks(len(stars)):
        upto[1:] += np.bincount(t[stars[a:b]], minlength=sigma)
    place = np.cumsum(upto)[:-1]
    for a, b in _chunks(len(stars)):
        c = np.asarray(t[stars[a:b]]).astype(np.int64)
        order = np.argsort(c, kind="stable")
        c = c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        n = np.diff(np.append(first, len(c)))
        out[np.repeat(place[c[first]] - first, n) + np.arange(len(c))] = np.asarray(stars[a:b])[order]
        place[c[first]] += n
    return out


def _names(t, stars, named, spool) -> tuple[np.ndarray, int]:
    """The string of names of the S* substrings (neighbours in ``named`` with equal substrings share one), and how many names there are."""
    m = len(stars)
    place = spool.array(len(t), stars.dtype)
    for a, b in _chunks(m):
        place[stars[a:b]] = np.arange(a, b)
    end = lambda at: np.where((k := np.asarray(place[at]).astype(np.int64)) + 1 < m, stars[np.minimum(k + 1, m - 1)], len(t) - 1)
    reduced, names = spool.array(m, np.int64), 0
    for a, b in _chunks(m):
        at = np.asarray(named[max(a - 1, 0) : b]).astype(np.int64)
        size = end(at) - at + 1
        same = np.zeros(len(at), dtype=bool)
        live = np.flatnonzero(size[1:] == size[:-1]) + 1
        step = 0
        while len(live):
            live = live[t[at[live] + step] == t[at[live - 1] + step]]
            step += 1
            done = size[live] <= step
            same[live[done]] = True
            live = live[~done]
        name = np.cumsum(~same[a > 0 :]) - 1 + names
        reduced[place[at[a > 0 :]]] = name
        names = int(name[-1]) + 1
    return reduced, names


def suffixes(t: np.ndarray, cap: int, budget: int = BUDGET, in_memory: int = IN_MEMORY, spool: Spool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``t`` (its last character the only 0) and, for each entry, the prefix it shares with the one before, up to ``cap``."""
    spool = spool or Spool(budget)
    n, kind = len(t), np.int32 if len(t) < 2**31 else np.int64
    if n == 1:
        return np.zeros(1, kind), np.zeros(1, np.int32)
    sigma = max(int(t[a:b].max()) for a, b in _chunks(n)) + 1
    small = spool.array(n, bool)
    _types(t, small)
    turns = lambda a, b: np.flatnonzero(np.asarray(small[a + 1 : b + 1]) & ~np.asarray(small[a:b])) + a + 1
    m = sum(len(turns(a, b)) for a, b in _chunks(n - 1))
    stars, k = spool.array(m, kind), 0
    for a, b in _chunks(n - 1):
        found = turns(a, b)
        stars[k : k + len(found)] = found
        k += len(found)
    is_star = spool.array(n, bool)
    for a, b in _chunks(m):
        is_star[stars[a:b]] = True
    named, k = spool.array(m, kind), 0
    for at, _ in _induce(t, small, _by_first(t, stars, sigma, spool), None, cap, sigma, False, spool):
        some = at[np.asarray(is_star[at])]
        named[k : k + len(some)] = some
        k += len(some)
    reduced, names = _names(t, stars, named, spool)
    order_stars, common = spool.array(m, kind), None
    if names == m and m > in_memory:  # names are ranks
        for a, b in _chunks(m):
            order_stars[reduced[a:b]] = stars[a:b]
    elif m <= in_memory:
        order, ranks = _doubling(np.asarray(reduced), cap)
        common = _star_common(t, np.asarray(stars), order, ranks, cap)
        order_stars[:] = stars[order]
    else:  # an S* substring moves on by one character at least; the last name ends the string, or a 0 does
        ends = int(reduced[m - 1]) == 0 and sum(int((reduced[a:b] == 0).sum()) for a, b in _chunks(m)) == 1
        string = spool.array(m if ends else m + 1, np.int64)
        for a, b in _chunks(m):
            string[a:b] = np.asarray(reduced[a:b]) + (not ends)
        order, _ = suffixes(string, cap, budget, in_memory, spool)
        for a, b in _chunks(m):
            order_stars[a:b] = stars[order[a + (not ends) : b + (not ends)]]
    if common is None:
        common = spool.array(m, np.int32)
        for a, b in _chunks(m):
            common[a:b] = _direct_common(t, np.asarray(order_stars[max(a - 1, 0) : b]), cap)[a > 0 :]
    sa, lcp, k = spool.array(n, kind), spool.array(n, np.int32), 0
    for at, value in _induce(t, small, order_stars, common, cap, sigma, True, spool):
        sa[k : k + len(at)], lcp[k : k + len(at)] = at, value
        k += len(at)
    return sa, lcp


def _direct_common(t: np.ndarray, at: np.ndarray, cap: int, start: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix of ``at`` with the one before, from ``start`` characters on that are known to agree."""
    out = np.zeros(len(at), np.int32) if start is None else start.astype(np.int32)
    live = np.arange(1, len(at))
    while len(live):
        i, j = at[live] + out[live], at[live - 1] + out[live]
        live = live[(out[live] < cap) & (i < len(t)) & (j < len(t))]
        i, j = at[live] + out[live], at[live - 1] + out[live]
        live = live[t[i] == t[j]]
        out[live] += 1
    return np.minimum(out, cap)


def _star_common(t, stars, order, ranks, cap) -> np.ndarray:
    """Common prefixes of sorted S* suffixes, carried over from those of their names."""
    m = len(stars)
    i, j = order[1:].astype(np.int64), order[:-1].astype(np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        k, rank = 1 << level, ranks[level]
        same = (i < m) & (j < m)
        same[same] = rank[i[same]] == rank[j[same]]
        i[same], j[same] = i[same] + k, j[same] + k
    place = np.append(stars, len(t)).astype(np.int64)
    known = np.zeros(m, np.int64)
    known[1:] = np.minimum(place[np.minimum(i, m)] - place[order[1:]], place[np.minimum(j, m)] - place[order[:-1]])
    return _direct_common(t, stars[order], cap, np.minimum(np.maximum(known, 0), cap))


class Shard:
    """Segments that are sorted together, written as they come."""

    def __init__(self, budget: int = BUDGET, in_memory: int = IN_MEMORY):
        self.budget, self.in_memory, self.spool, self.sizes, self.bytes = budget, in_memory, Spool(budget), [], 0
        self.parts: list = []

    def add(self, segments: list[bytes]) -> None:
        for k in range(0, len(segments), 256):
            some = b"\0".join(segments[k : k + 256])
            self.parts.append(self.spool.put(np.frombuffer(some, dtype=np.uint8)))
            self.bytes += len(some)
        self.sizes += map(len, segments)

    def repeated(self, length: int):
        """For each segment, which of its ``length``-byte strings (by their starts) also start elsewhere in the shard."""
        sizes = np.array(self.sizes, dtype=np.int64)
        bounds = np.cumsum(sizes + 1)
        t, k = self.spool.array(int(bounds[-1]) + 1, np.uint16), 0
        for part in self.parts:
            (some,) = self.spool.get(part)
            t[k : k + len(some)] = some.astype(np.uint16) + 2
            k += len(some) + 1
        for a, b in _chunks(len(bounds)):
            t[bounds[a:b] - 1] = 1
        t[len(t) - 1] = 0
        at, common = suffixes(t, length, self.budget, self.in_memory, self.spool)
        mark = self.spool.array(len(t), bool)
        for a, b in _chunks(len(t)):
            hit = np.asarray(common[a : b + 1]) >= length
            mark[at[a:b]] = hit[: b - a] | (hit[1:] if len(hit) > b - a else np.append(hit[1:], False))
        for b, n in zip(bounds.tolist(), sizes.tolist()):
            yield np.asarray(mark[b - 1 - n : max(b - 1 - n, b - length)])


def repeated_starts(segments: list[bytes], length: int, budget: int = BUDGET, in_memory: int = IN_MEMORY) -> list[np.ndarray]:
    """For each segment, which of its ``length``-byte strings (by their starts) also start elsewhere in the segments."""
    shard = Shard(budget, in_memory)
    shard.add(segments)
    return list(shard.repeated(length))
