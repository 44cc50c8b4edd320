"""Vectorised kernels over the bytes of many texts at once (numpy).

Texts arrive as Arrow string columns and are handled in chunks of about
``CHUNK`` bytes, so the memory in use doesn't depend on the size of a batch.
Two kinds of hashes are taken from prefix sums, so every substring costs the same:

* ``rolling`` only chooses places (triggers, anchors): a polynomial modulo 2^64,
  whose collisions cost nothing but work;
* ``Prefix`` tells strings apart: polynomials over the prime field of 2^31 - 1,
  one for each of four bases.  Two different strings of n symbols agree under a
  base drawn at random with a probability of n / 2^31 at most, whatever their
  structure, and bases are independent.  A pair of hashes from two bases each, as
  operators compare them, errs with (n / 2^31)^4: 1e-26 for 600 symbols.  Bases come
  from ``SEED``; where texts may be written against a known seed, draw another.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
PRIME, SEED, PAIR = 2**31 - 1, 20240229, 2
_P, _BITS = np.uint64(PRIME), np.uint64(31)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SYMBOL = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_fields: dict[int, np.ndarray] = {}


class Chunk(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # uint8
    off: np.ndarray  # int64, one more than rows


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Runs of whole texts of about ``size`` bytes; a longer text is a chunk of its own."""
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield Chunk(i, raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 4096)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def rolling(symbols: np.ndarray, k: int) -> np.ndarray:
    """One hash for each start of k symbols, to choose places by; no proof of equality."""
    up, down = _grow(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
    n = len(sums) - k
    return mix((sums[k:] - sums[:n]) * down[:n]) if n > 0 else np.zeros(0, np.uint64)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _SYMBOL[data]


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for any 64-bit x."""
    x = (x & _P) + (x >> _BITS)
    x = (x & _P) + (x >> _BITS)
    return np.where(x >= _P, x - _P, x)


def bases(seed: int = SEED) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(2**30, PRIME - 1, 2 * PAIR)]


def _field(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo the prime."""
    p = _fields.get(base)
    if p is None or len(p) < n:
        m = max(n, CHUNK + 4096)
        p = np.ones(1, np.uint64)
        while len(p) < m:
            p = np.append(p, fold(p * np.uint64(pow(base, len(p), PRIME))))
        p = _fields[base] = p[:m].astype(np.uint32)
    return p


class Prefix:
    """Hashes of any run of a sequence; ``symbols`` are values below 2^31, one sequence for each base."""

    def __init__(self, symbols: list[np.ndarray], base: list[int]):
        self.base, self.sums, self.down = base, [], []
        for b, x in zip(base, symbols, strict=True):
            n = len(x)
            terms = x.astype(np.uint64) * _field(b, n + 1)[:n]
            if n > 1 << 22 or x.dtype != np.uint8:  # sums stay below 2^64
                terms = fold(terms)
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(terms, out=s[1:])
            self.sums.append(s)
            self.down.append(_field(pow(b, -1, PRIME), n + 1))

    @classmethod
    def of_bytes(cls, data: np.ndarray, base: list[int]) -> Prefix:
        """Lengths tell runs of zero bytes apart, see ``runs``."""
        return cls([data] * len(base), base)

    def field(self, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
        """Values modulo the prime under the k-th base."""
        s = self.sums[k]
        return fold(fold(s[hi] - s[lo]) * self.down[k][lo])

    def runs(self, lo: np.ndarray, hi: np.ndarray, pair: int = 0) -> np.ndarray:
        """62 bits from bases 2 ``pair`` and 2 ``pair`` + 1, and the length, spread over 64."""
        both = (self.field(lo, hi, PAIR * pair) << _BITS) | self.field(lo, hi, PAIR * pair + 1)
        return mix(mix(both) + (hi - lo).astype(np.uint64))


class Words(NamedTuple):
    lo: np.ndarray  # byte range of each word in the chunk
    hi: np.ndarray
    off: np.ndarray  # first word of each text, and the end


def words(c: Chunk) -> Words:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D, within texts."""
    inside = ~_SPACE[c.data]
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    after = before[1:].copy()
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    starts, ends = c.off[:-1], c.off[1:]
    before[starts] = False
    after[ends[ends > starts] - 1] = False
    lo = np.flatnonzero(inside & ~before[:-1])
    hi = np.flatnonzero(inside & ~after) + 1
    return Words(lo, hi, np.searchsorted(lo, c.off))


def word_symbols(c: Chunk, w: Words, base: list[int]) -> list[np.ndarray]:
    """Each word's values, one sequence for each base."""
    p = Prefix.of_bytes(c.data, base)
    length = (w.hi - w.lo).astype(np.uint64)
    return [fold(p.field(w.lo, w.hi, k) * np.uint64(31) + length) for k in range(len(base))]


def packed(symbols: list[np.ndarray]) -> np.ndarray:
    """The first two values of each symbol as one."""
    return mix((symbols[0] << _BITS) | symbols[1])


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the first place of the least value among h[i : i + width] (to the end of h)."""
    n = len(h)
    low = np.uint64(2**31 - 1)
    packed = (h & ~low) | np.arange(n, dtype=np.uint64)
    m = -(-(n + width) // width) * width
    p = np.full(m, 2**64 - 1, np.uint64)
    p[:n] = packed
    rows = p.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:n], head[width - 1 : width - 1 + n]) & low).astype(np.int64)


class Anchors(NamedTuple):
    row: np.ndarray  # text of the chunk
    lo: np.ndarray  # first and last window start that the anchor answers for, in the chunk
    hi: np.ndarray
    at: np.ndarray
    key: np.ndarray  # hash of what all these windows share, from the anchor on (first pair of bases)
    whole: np.ndarray  # hash of what any of them covers, and of where it lies (second pair)


def anchors(p: Prefix, h: np.ndarray, off: np.ndarray, length: int, width: int) -> Anchors:
    """Content-chosen anchors of all windows of ``length`` symbols.

    The anchor of the window at i is the first least h in [i, i + width), so
    equal windows have equal anchors at equal distance.
    """
    n = int(off[-1])
    long = off[1:] - off[:-1] >= length
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, off[:-1][long], 1)
    np.add.at(step, off[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(step[:n]) > 0)
    if len(starts) == 0:
        e, z = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Anchors(e, e, e, e, z, z)
    at = sliding_argmin(h, width)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, at = starts[first], starts[np.append(first[1:], len(starts)) - 1], at[first]
    return Anchors(np.searchsorted(off, lo, "right") - 1, lo, hi, at, *block_hashes(p, lo, hi, at, length, width))


def block_hashes(p: Prefix, lo, hi, at, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, whole) of the windows lo..hi, all of which hold [at, at + length - width + 1); with one pair of bases key alone."""
    key = p.runs(at, at + (length - width + 1))
    return key, placed(p.runs(lo, hi + length, 1), at - lo, hi - lo) if len(p.base) > PAIR else key


def placed(h: np.ndarray, before: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A hash of what is covered and where the anchor lies in it."""
    return mix(h + mix((before * 65536 + more).astype(np.uint64)) * _M2)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
