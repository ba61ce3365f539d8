"""Words and word shingles of whole texts as 64-bit numbers, for many texts at once."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS = np.cumprod(np.full(1 << 12, 0xD6E8FEB86659FD93, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    return _POWERS[:n] if n <= len(_POWERS) else np.cumprod(np.full(n, 0xD6E8FEB86659FD93, dtype=np.uint64))


def places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes at which the words of a text begin and end."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(text, dtype=np.uint8)], [True]])
    turn = np.flatnonzero(space[1:] != space[:-1])
    return turn[::2], turn[1::2]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z folded; where each text's words begin (one more than texts); and the
    bytes at which each word begins and ends within its text."""
    data = b"\n".join(texts) + b"\n"
    a = np.frombuffer(data.lower(), dtype=np.uint8)
    space = _SPACE[a]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        turn = np.concatenate([[0], turn])
    starts, ends = turn[::2], turn[1::2]
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    of = np.searchsorted(starts, base)
    if not len(starts):
        return np.zeros(0, np.uint64), of, starts, ends
    size = ends - starts
    at = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))])
    powers = _powers(int(size.max()))
    value = np.where(space, np.uint64(0), a.astype(np.uint64) + np.uint64(1))
    value *= powers[np.minimum(at, len(powers) - 1)]
    text = np.repeat(np.arange(len(texts)), np.diff(of))
    return mix(np.add.reduceat(value, starts) + size.astype(np.uint64)), of, starts - base[text], ends - base[text]


def shingles(hashes: np.ndarray, of: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order, repeats included, and where each text's begin.

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """
    n, count = len(hashes), np.diff(of)
    c = constants(width + 1, 5)
    some = np.maximum(count - width + 1, (count > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(some)])
    if not n:
        return np.zeros(0, np.uint64), start
    full = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        full[: n - j] += hashes[j:] * c[j]
    long = np.flatnonzero(count >= width)
    keep = np.repeat(of[:-1][long], some[long]) + (np.arange(some[long].sum()) - np.repeat(np.concatenate([[0], np.cumsum(some[long])[:-1]]), some[long]))
    out = np.zeros(start[-1], dtype=np.uint64)
    place = np.repeat(count >= width, some)
    out[place] = full[keep]
    for k in np.flatnonzero((count > 0) & (count < width)):
        part = hashes[of[k] : of[k + 1]]
        out[start[k]] = (np.append(part, len(part)).astype(np.uint64) * np.append(c[: len(part)], c[width])).sum(dtype=np.uint64)
    return mix(out), start
