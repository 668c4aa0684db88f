"""Elias-Fano coding of a non-decreasing sequence: select, successor search and bulk decoding.

n values below u take about n * (2 + log2(u / n)) bits: l low bits of each in a packed array, the rest
as gaps in a bit vector whose i-th one stands at high(i) + i. A count of ones for each 512 bits is the
only directory."""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np

MAGIC = b"SEF1"
#: Values that one step of a walk decodes, and the share of them (one in DENSE) that have to be asked for.
SEGMENT = 1 << 15
DENSE = 24
HEAD = struct.Struct("<4sBxxxQQQ")
_POP8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SEL8 = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _SEL8[_b, : len(_at)] = _at


def encode(values: np.ndarray) -> bytes:
    """The bytes of one sequence of unsigned 64-bit values."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if n and (v[1:] < v[:-1]).any():
        raise ValueError("Elias-Fano needs a non-decreasing sequence")
    top = int(v[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    n_bits = int(ones[-1]) + 1 if n else 0
    blocks = -(-n_bits // 512)
    bits = np.zeros(blocks * 512, np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little")
    counts = np.concatenate([[0], np.cumsum(bits.reshape(-1, 512).sum(axis=1, dtype=np.int64))]).astype("<u8") if blocks else np.zeros(1, "<u8")
    low = bytearray()
    step = 1 << 15  # a multiple of 8 values, so that each part ends on a byte
    for a in range(0, n if low_bits else 0, step):
        part = v[a : a + step, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)
        low += np.packbits(part.astype(np.uint8).ravel(), bitorder="little").tobytes()
    low += bytes(16 + -len(low) % 8)
    return HEAD.pack(MAGIC, low_bits, n, n_bits, len(low)) + counts.tobytes() + high.tobytes() + bytes(low)


class EliasFano:
    """A view on encoded bytes (mapped or not); nothing is copied."""

    def __init__(self, buffer: np.ndarray):
        magic, self.low_bits, self.n, self.n_bits, n_low = HEAD.unpack(bytes(buffer[: HEAD.size]))
        if magic != MAGIC:
            raise ValueError("not an Elias-Fano sequence")
        blocks, at = -(-self.n_bits // 512), HEAD.size
        self.counts = np.frombuffer(buffer[at : at + 8 * (blocks + 1)], "<u8").astype(np.int64)
        at += 8 * (blocks + 1)
        self.high = buffer[at : at + 64 * blocks]
        self.low = buffer[at + 64 * blocks : at + 64 * blocks + n_low]
        self.size = at + 64 * blocks + n_low

    def __len__(self) -> int:
        return self.n

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        words = np.frombuffer(np.ascontiguousarray(self.low[: len(self.low) // 8 * 8]), "<u8")
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = words[word] >> shift
        second = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (first | second) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, directory: np.ndarray | None = None, zeros: bool = False) -> np.ndarray:
        """Position of the k-th one (or zero) of the bit vector."""
        directory = self.counts if directory is None else directory
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 1 << 14):
            kk = k[a : a + (1 << 14)]
            block = np.searchsorted(directory, kk, "right") - 1
            rest = kk - directory[block]
            # The word of the block first, then its octet: eight counts each.
            words = self.high.view("<u8").reshape(-1, 8)[block]
            words = ~words if zeros else words
            ones = np.bitwise_count(words).cumsum(axis=1, dtype=np.int64)
            word = (ones <= rest[:, None]).sum(axis=1)
            row = np.arange(len(kk))
            own = words[row, word]
            rest = rest - ones[row, word] + np.bitwise_count(own)
            octets = own.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
            ones = _POP8[octets].cumsum(axis=1, dtype=np.int64)
            octet = (ones <= rest[:, None]).sum(axis=1)
            rest = rest - ones[row, octet] + _POP8[octets[row, octet]]
            out[a : a + len(kk)] = block * 512 + word * 64 + octet * 8 + _SEL8[octets[row, octet], rest]
        return out

    def select(self, i) -> np.ndarray:
        """The i-th values."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("outside the sequence")
        high = (self._select(i) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._lows(i)

    def decode(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Values a .. b-1; reads only the blocks that hold them."""
        b = self.n if b is None else b
        if a >= b:
            return np.zeros(0, np.uint64)
        first, last = np.searchsorted(self.counts, [a, b - 1], "right") - 1
        bits = np.unpackbits(np.asarray(self.high[first * 64 : (last + 1) * 64]), bitorder="little").view(bool)
        ones = np.flatnonzero(bits)[a - self.counts[first] : b - self.counts[first]] + first * 512
        i = np.arange(a, b)
        return (ones - i).astype(np.uint64) << np.uint64(self.low_bits) | self._lows(i)

    @cached_property
    def edges(self) -> np.ndarray:
        """Every ``SEGMENT``-th value."""
        return self.select(np.arange(0, self.n, SEGMENT))

    def take(self, i: np.ndarray) -> np.ndarray:
        """The i-th values for ascending i: segments that many ask for are decoded, others answer by select."""
        i = np.asarray(i, np.int64)
        out = np.empty(len(i), np.uint64)
        sparse = np.ones(len(i), bool)
        cuts = np.searchsorted(i, np.arange(0, self.n + SEGMENT, SEGMENT))
        for s in np.flatnonzero(np.diff(cuts) * DENSE >= SEGMENT).tolist():
            a, b = cuts[s], cuts[s + 1]
            low, high = int(i[a]), int(i[b - 1]) + 1
            out[a:b] = self.decode(low, high)[i[a:b] - low]
            sparse[a:b] = False
        if sparse.any():
            out[sparse] = self.select(i[sparse])
        return out

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``high``: ones before the zero that ends the part before."""
        zeros = np.arange(len(self.counts)) * 512 - self.counts
        k = high.astype(np.int64) - 1
        out = np.where(k < 0, 0, self.n)
        ask = np.flatnonzero((k >= 0) & (k < zeros[-1]))
        if len(ask):
            out[ask] = self._select(k[ask], zeros, True) - k[ask]
        return out

    def _search(self, x: np.ndarray) -> np.ndarray:
        """Successor indices by two selects of zeros and a search among the low bits between them."""
        high = np.minimum(x >> np.uint64(self.low_bits), np.uint64(self.n_bits + 1))
        lo, hi = self._below(high), self._below(high + np.uint64(1))
        low = x & np.uint64((1 << self.low_bits) - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            below = self._lows(mid) < low[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        return lo

    def successor(self, x) -> tuple[np.ndarray, np.ndarray]:
        """For each x the index of the first value >= x (n if none) and that value (0 if none).

        Ascending x walk the sequence once: a segment that many of them fall in is decoded, a few search."""
        x = np.atleast_1d(np.asarray(x, np.uint64))
        at, value = np.full(len(x), self.n, np.int64), np.zeros(len(x), np.uint64)
        if not self.n or not len(x):
            return at, value
        if (x[1:] < x[:-1]).any():
            order = np.argsort(x, kind="stable")
            at[order], value[order] = self.successor(x[order])
            return at, value
        cuts = np.append(np.searchsorted(x, self.edges, "right"), len(x))
        at[: cuts[0]], value[: cuts[0]] = 0, self.edges[0]
        sparse = np.zeros(len(x), bool)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            a, b, first = cuts[s], cuts[s + 1], s * SEGMENT
            if (b - a) * DENSE < SEGMENT:
                sparse[a:b] = True
                continue
            # One value more, so that what lies beyond the segment's last is at hand.
            own = self.decode(first, min(first + SEGMENT + 1, self.n))
            found = np.searchsorted(own, x[a:b])
            at[a:b] = first + found
            value[a:b] = np.where(found < len(own), own[np.minimum(found, len(own) - 1)], np.uint64(0))
        some = np.flatnonzero(sparse)
        if len(some):
            at[some] = self._search(x[some])
            some = some[at[some] < self.n]
            value[some] = self.select(at[some])
        return at, value
