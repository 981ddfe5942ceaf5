"""Words, shingles and signatures of whole Arrow batches of text, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from zonalis.llm.worker import kept

#: Bytes hashed at once; a longer text is hashed in segments that end between words.
SEGMENT = 1 << 18
_M = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    inverse = pow(_M, -1, 1 << 64)
    up, down = np.full(n + 1, _M, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _letters() -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)


class Roller:
    """Hashes of arbitrary substrings of one byte array, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = kept("powers", lambda: _powers(SEGMENT)) if n <= SEGMENT else _powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(kept("letters", _letters)[data] * up[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + lengths * _U(0xD6E8FEB86659FD93))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the offsets of its rows; NULL is empty."""
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``limit`` bytes, with the number of their first row."""
    _, at = buffer_of(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word; words are parted by ASCII white space and row ends, A-Z in lower case."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], letter[:-1]]) & ~edge[:-1]
    after = np.concatenate([letter[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    lower = _LOWER[data]
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        a = starts[i]
        out.append(Roller(lower[a:ends[j - 1]])(starts[i:j] - a, ends[i:j] - a))
        i = j
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), starts, ends


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on, as :func:`shingle` has it, whatever unit they are in."""
    n = max(0, len(hashes) - size + 1)
    folded = np.full(n, 0x51ED270B7A1F6E2D, np.uint64)
    for k in range(size):
        folded = mix(folded * _U(0xA24BAED4963EE407) + hashes[k:k + n])
    return folded


def shingle(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and unit of each run of ``size`` words inside a unit.

    ``first`` holds the number of each unit's first word, and the count of words at its end. A unit
    with fewer words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    unit = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    folded = np.full(n, 0x51ED270B7A1F6E2D, np.uint64)
    left = np.minimum(size, (np.repeat(first[1:], counts) - np.arange(n)))
    for k in range(size):
        here = left > k
        at = np.flatnonzero(here)
        folded[at] = mix(folded[at] * _U(0xA24BAED4963EE407) + hashes[at + k])
    whole = left == size
    short = np.repeat(counts < size, counts)
    heads = np.zeros(n, bool)
    heads[first[:-1][counts > 0]] = True
    use = whole | (short & heads)
    return folded[use], unit[use]


def distinct(values: np.ndarray, unit: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each unit one after another, and where each unit's begin."""
    bounds = np.searchsorted(unit, np.arange(n_units + 1))
    sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    starts = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), starts


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(n)
    draw = lambda: rng.integers(0, 1 << 63, n, np.uint64) * _U(2)
    return draw() + _U(1), draw() + _U(1)


def min_max(values: np.ndarray, starts: np.ndarray, n: int, both: bool = True) -> np.ndarray:
    """Signatures, one row per non-empty set: the minimum and, if ``both``, the maximum under n permutations."""
    a, b = permutations(n)
    out = np.empty((n * (1 + both), len(starts)), np.uint64)
    for k in range(n):
        x = values * a[k]
        x ^= x >> _U(32)
        x *= b[k]
        out[k] = np.minimum.reduceat(x, starts)
        if both:
            out[n + k] = np.maximum.reduceat(x, starts)
    return out.T


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` consecutive values."""
    n, width = signatures.shape
    bands = width // rows
    keys = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64) * _U(_M)), (n, 1))
    for r in range(rows):
        keys = mix(keys * _U(0xA24BAED4963EE407) + signatures[:, r:bands * rows:rows])
    return keys.view(np.int64)


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` values such that a pair of that similarity is missed with probability ``miss`` at most."""
    return int(np.ceil(np.log(miss) / np.log1p(-(similarity ** rows))))


def pack(values: np.ndarray) -> bytes:
    """The low 48 bits of sorted 64-bit values."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes | np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]
