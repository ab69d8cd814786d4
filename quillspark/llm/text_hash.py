"""Vectorised word and window hashing over the UTF-8 bytes of many texts.

Every helper works on one *slab*: the bytes of some documents joined by line feeds. A slab
is bounded (``slabs``), so memory stays at a few dozen MB whatever a batch holds; a single
text longer than the bound is a slab of its own.
"""

from __future__ import annotations

import numpy as np

SLAB_BYTES = 1 << 16  # its arrays of 64-bit values fit a core's cache
U64 = np.uint64
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stir(x: np.ndarray) -> np.ndarray:
    """A cheaper finaliser, for an order that only has to look random."""
    x = x ^ (x >> U64(32))
    x *= U64(0x9FB21C651E98DF25)
    x ^= x >> U64(29)
    return x


def byte_table(which: int = 0) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(_SEEDS[which]))


class Quick:
    """Polynomial hashes modulo 2**64, for buckets and for choosing anchors.

    Crafted texts can collide, so nothing may rest on equal values; ``Rolling`` is for that.
    """

    def __init__(self) -> None:
        self._powers = (np.ones(0, dtype=U64), np.ones(0, dtype=U64))

    def table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """base**i and base**-i for i < n at least; the base is odd, so it has an inverse."""
        if len(self._powers[0]) < n:
            base, n = _SEEDS[0] | 1, max(n, SLAB_BYTES + 4096)
            up, down = np.full(n, base, dtype=U64), np.full(n, pow(base, -1, 1 << 64), dtype=U64)
            up[:1] = down[:1] = 1
            self._powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self._powers

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.table(len(values))
        sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        lengths = (ends - starts).astype(U64)
        return mix((sums[ends] - sums[starts]) * down[starts] + lengths * U64(0xD6E8FEB86659FD93))

    def fixed(self, values: np.ndarray, n: int, finish=mix) -> np.ndarray:
        """Hashes of all n-element windows."""
        if len(values) < n:
            return np.zeros(0, dtype=U64)
        up, down = self.table(len(values))
        sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return finish((sums[n:] - sums[:-n]) * down[: len(values) - n + 1])


PRIME = U64((1 << 61) - 1)
_LOW31, _LOW32 = U64((1 << 31) - 1), U64((1 << 32) - 1)


def reduce(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo the prime."""
    x = (x & PRIME) + (x >> U64(61))
    return np.minimum(x, x - PRIME)  # what is below the prime wraps to a greater number


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 30 and 31 bits."""
    ah, al, bh, bl = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    middle = ah * bl + al * bh
    return reduce(((ah * bh) << U64(1)) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << U64(31)) + al * bl)


class Rolling:
    """Polynomial hashes of ranges of a sequence modulo the prime 2**61 - 1, from prefix sums.

    Two different sequences of n values have equal hashes for at most n of 2**61 bases,
    whatever their structure; two bases (``which``) are independent of each other.
    """

    def __init__(self) -> None:
        self._powers: dict[int, tuple[np.ndarray, ...]] = {}

    def table(self, n: int, which: int) -> tuple[np.ndarray, ...]:
        """For i < n at least, modulo the prime: base**i, its low and high half, base**-i."""
        if which not in self._powers or len(self._powers[which][0]) < n:
            found, n = [], max(n, SLAB_BYTES + 4096)
            for base in (_SEEDS[which] % int(PRIME), pow(_SEEDS[which], -1, int(PRIME))):
                row = np.ones(1, dtype=U64)
                while len(row) < n:
                    row = np.concatenate([row, times(row, U64(pow(base, len(row), int(PRIME))))])
                found.append(row)
            self._powers[which] = found[0], found[0] & _LOW32, found[0] >> U64(32), found[1]
        return self._powers[which]

    def sums(self, values: np.ndarray, starts, ends, which: int) -> np.ndarray:
        """Sum of values[i] * base**(i - start); values are bytes, or 64-bit numbers."""
        n, (up, up_low, up_high, down) = len(values), self.table(len(values), which)
        low, high = np.zeros(n + 1, dtype=U64), np.zeros(n + 1, dtype=U64)
        if values.dtype == np.uint8 and n < 1 << 24:  # so that no sum passes 64 bits
            wide = values.astype(U64)
            np.cumsum(wide * up_low[:n], out=low[1:])
            np.cumsum(wide * up_high[:n], out=high[1:])
        else:
            terms = times(reduce(values.astype(U64)), up[:n])
            np.cumsum(terms & _LOW32, out=low[1:])
            np.cumsum(terms >> U64(32), out=high[1:])
        low, high = reduce(low[ends] - low[starts]), reduce(high[ends] - high[starts])
        high = ((high & U64((1 << 29) - 1)) << U64(32)) + (high >> U64(29))  # times 2**32
        return times(reduce(high + low), down[starts])

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        return mix(self.sums(values, starts, ends, which) ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))

    def fixed(self, values: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """Hashes of all n-element windows; equal to those of ``ranges``."""
        starts, ends = slice(0, max(0, len(values) - n + 1)), slice(n, None)
        found = self.sums(values, starts, ends, which) if len(values) >= n else np.zeros(0, dtype=U64)
        return mix(found ^ U64(n * 0xD6E8FEB86659FD93 % (1 << 64)))


def slabs(sizes: list[int], limit: int = SLAB_BYTES):
    """Ranges of consecutive texts whose bytes, with separators, stay within the limit."""
    at, used = 0, 0
    for i, n in enumerate(sizes):
        if i > at and used + n + 1 > limit:
            yield at, i
            at, used = i, 0
        used += n + 1
    if at < len(sizes):
        yield at, len(sizes)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slab: byte starts and ends, and each word's document."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.data, dtype=np.uint8)
        space = (self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([np.zeros(1, dtype=edge.dtype), edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, offsets)  # of each document, and the end
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, rolling: Rolling, which: int = 0, lower: bool = False) -> np.ndarray:
        buf = self.buf
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        return rolling.ranges(buf, self.starts, self.ends, which)

    def whole(self, n: int) -> np.ndarray:
        """Word indexes at which a window of n words starts and stays inside its document."""
        if len(self.doc) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1])
