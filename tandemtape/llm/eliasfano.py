"""Elias-Fano sequences over a byte buffer, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

MOST_LOW = 56  # low bits that one unaligned read of 64 bits can hold
#: Place of the k-th one in a byte.
IN_BYTE = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1, kind="stable").astype(np.uint8)
BYTES, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bits of each value, one after the other, as bytes."""
    parts = []
    step = 8 * max(1, (1 << 17) // max(width, 1))
    for start in range(0, len(values), step):  # whole bytes each: a multiple of eight values
        some = values[start : start + step]
        bits = (some[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        parts.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing array of unsigned numbers: a header of four numbers, packed low bits, then unary high bits in 64-bit words."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(4, np.uint64).tobytes()
    base = values[0]
    rest = values - base
    top = int(rest[-1])
    width = min(MOST_LOW, max(0, (top // n).bit_length() - 1)) if top else 0
    low = _pack(rest & np.uint64((1 << width) - 1), width) if width else np.zeros(8, np.uint8)
    low = np.concatenate([low, np.zeros(-len(low) % 8, np.uint8)])
    high = (rest >> np.uint64(width)).astype(np.int64)
    size = n + int(high[-1]) + 1
    unary = np.zeros(-(-size // 64) * 64, np.uint8)
    unary[high + np.arange(n)] = 1
    head = np.array([n, int(base), width, len(low)], np.uint64)
    return head.tobytes() + low.tobytes() + np.packbits(unary, bitorder="little").tobytes()


class EliasFano:
    """Reads an encoded sequence in place; ``buffer`` may be mapped from a file.  A directory counts the ones before every word."""

    def __init__(self, buffer: np.ndarray):
        buffer = np.asarray(buffer)
        head = np.frombuffer(buffer[:32].tobytes(), np.uint64)
        self.n, self.base, self.width, size = int(head[0]), head[1], int(head[2]), int(head[3])
        self.low, self.high = buffer[32 : 32 + size], buffer[32 + size :]
        self.words = self.high.view("<u8")
        #: Sixty-four bits from every byte on; the last seven bytes begin no value.
        self.reads = np.ndarray(max(size - 7, 0), "<u8", self.low, strides=(1,)) if size else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def _select(self, ranks: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the ones (or zeros) with these ranks, counted from 0: the word by the directory, the byte by running sums of
        the bytes' ones, all eight at once, and the bit by a table."""
        before = self.ones if bit else self.zeros
        word = np.minimum(np.searchsorted(before, ranks, side="right") - 1, len(before) - 2)
        bits = self.words[word] if bit else ~self.words[word]
        rank = (ranks - before[word]).astype(np.uint64)
        upto = bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))
        upto = (upto & np.uint64(0x3333333333333333)) + ((upto >> np.uint64(2)) & np.uint64(0x3333333333333333))
        upto = ((upto + (upto >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * BYTES
        passed = np.bitwise_count((((np.minimum(rank, np.uint64(64)) * BYTES) | TOPS) - upto) & TOPS)
        byte = np.minimum(passed, 7).astype(np.uint64) * np.uint64(8)
        rank -= ((upto << np.uint64(8)) >> byte) & np.uint64(255)
        place = byte.astype(np.int64) + IN_BYTE[((bits >> byte) & np.uint64(255)).astype(np.uint8), np.minimum(rank, np.uint64(7)).astype(np.uint8)]
        return word * 64 + np.where(passed > 7, 64, place)

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        first = at * self.width
        return (self.reads[first >> 3] >> (first & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at these positions."""
        high = (self._select(at, 1) - at).astype(np.uint64)
        return self.base + ((high << np.uint64(self.width)) | self._lows(at))

    def whole(self) -> np.ndarray:
        """All values, read in one pass over the high bits."""
        at = np.arange(self.n)
        high = (np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - at).astype(np.uint64)
        return self.base + ((high << np.uint64(self.width)) | self._lows(at))

    def successor(self, values: np.ndarray) -> np.ndarray:
        """For each value the position of the first element that is not smaller; ``n`` if there is none."""
        values = np.asarray(values, np.uint64)
        if not self.n:
            return np.zeros(len(values), np.int64)
        rest = np.where(values > self.base, values - self.base, np.uint64(0))
        last = int(self.zeros[-1])
        want = (rest >> np.uint64(self.width)).astype(np.int64)
        high = np.minimum(want, last)
        low = np.where(want > last, np.uint64(1 << self.width), rest & np.uint64((1 << self.width) - 1))
        # Elements with this high part lie between the zeros that end the part before and this one.
        a = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) + 1 - high, 0)
        b = np.minimum(np.where(high < last, self._select(np.minimum(high, last), 0) - high, self.n), self.n)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._lows(middle) < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        return a
