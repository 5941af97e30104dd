"""Numpy views of an Arrow batch of texts: words, lines and 64-bit names of byte ranges.

Every operator that has to look at each word of a corpus works on one contiguous byte array per
slice of a batch, so the cost of a word is a few vectorised passes and not a Python object.
Separators are the six bytes 0x20 and 0x09-0x0D; as they are ASCII, cutting UTF-8 bytes at them
is the same as cutting the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 3 << 19

_MASK = (1 << 64) - 1
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Which bytes of an 8-byte little-endian chunk are left if it has 0 to 8.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(left: np.ndarray, right: np.ndarray, salt: int = 0) -> np.ndarray:
    """The name of the ordered pair of two names."""
    return mix(mix(left + np.uint64((0xD6E8FEB86659FD93 * (salt + 1)) & _MASK)) * np.uint64(3) + right)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (a longer text stands alone)."""
    at = offsets(texts)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(at, at[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


def offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def plain(column: pa.Array) -> pa.Array:
    """One string array in which a null text is an empty one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null("") if column.null_count else column


class Texts:
    """The rows lo..hi of a string array as bytes; ``starts`` has one entry more than there are rows."""

    def __init__(self, texts: pa.Array, lo: int = 0, hi: int | None = None):
        hi = len(texts) if hi is None else hi
        at = offsets(texts)[lo : hi + 1]
        size = int(at[-1] - at[0])
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8, size, int(at[0])) if data is not None and size else np.zeros(0, np.uint8)
        self.starts = at - at[0]
        self.rows = hi - lo

    @classmethod
    def of(cls, values: list) -> Texts:
        return cls(plain(pa.array(values, pa.large_string())))

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        """The row of each byte position."""
        return np.searchsorted(self.starts, positions, "right") - 1

    def _ranges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal ranges of true bytes; a range ends with its row at the latest."""
        edge = np.empty(len(inside) + 1, bool)
        edge[0], edge[-1] = True, True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[self.starts] = True
        cut = np.flatnonzero(edge)
        keep = inside[cut[:-1]]
        return cut[:-1][keep], cut[1:][keep]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each word, in order."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._ranges(~SEPARATOR[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        r"""First byte and end of each line between \n, empty ones too; n breaks make n + 1 lines of a row."""
        breaks = np.flatnonzero(self.data == 10)
        first = np.sort(np.concatenate([self.starts[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([breaks, self.starts[1:]]), kind="stable")
        return first, end

    def names(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit names of byte ranges: equal bytes, equal names.

        A name sums mixed chunks of eight bytes, each mixed with its place. Unlike polynomials modulo 2^64,
        whose powers share factors of two, this has no family of inputs that collide by its form.
        """
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        chunk = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))  # from every byte on
        size = end - first
        out = mix(_chunks(chunk, first, np.minimum(size, 8), np.uint64(0)))
        long = np.flatnonzero(size > 8)
        if len(long):
            n = (size[long] - 1) >> 3  # chunks after the first
            nth = ragged(n) + 1
            at = np.repeat(first[long], n) + 8 * nth
            more = mix(_chunks(chunk, at, np.minimum(np.repeat(end[long], n) - at, 8), nth.astype(np.uint64)))
            out[long] += np.add.reduceat(more, np.cumsum(n) - n)
        return mix(out + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def per_row(self, positions: np.ndarray) -> np.ndarray:
        """How many of the ascending positions lie in each row."""
        return np.diff(np.searchsorted(positions, self.starts))


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lengths, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _chunks(chunk: np.ndarray, at: np.ndarray, size: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as a number, told apart by which chunk of its range it is."""
    return (chunk[at] & _LEFT[size]) + nth * np.uint64(0x9E3779B97F4A7C15)


#: A prime, the modulus of polynomial names of ranges.
_PRIME = np.uint64((1 << 61) - 1)
_POINT = np.uint64(0x0B5297A4D3F8E1C7 % ((1 << 61) - 1))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, both below it."""
    low, high = np.uint64(0xFFFFFFFF), np.uint64(32)
    al, ah, bl, bh = a & low, a >> high, b & low, b >> high
    cross = al * bh + ah * bl  # below 2^62
    # 2^64 is 8 and 2^61 is 1
    total = (al * bl & _PRIME) + (al * bl >> np.uint64(61)) + ((cross << high) & _PRIME) + (cross >> np.uint64(29)) + ah * bh * np.uint64(8)
    total = (total & _PRIME) + (total >> np.uint64(61))
    return np.where(total >= _PRIME, total - _PRIME, total)


class Ranges:
    """Equality of ranges of symbols, by polynomials modulo a prime at a fixed point.

    Two different ranges of n symbols agree for n of all 2^61 points at most, whatever their form.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.powers = np.ones(n + 1, np.uint64)
        step, k = np.full(1, _POINT), 1
        while k <= n:
            self.powers[k : 2 * k] = times(self.powers[: min(k, n + 1 - k)], step)
            step, k = times(step, step), 2 * k
        terms = times(mix(symbols) & _PRIME, self.powers[:n])
        low, high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(terms & np.uint64(0xFFFFFFFF), out=low[1:])
        np.cumsum(terms >> np.uint64(32), out=high[1:])
        total = low % _PRIME + times(high % _PRIME, np.full(1, 1 << 32, np.uint64))
        self.sums = np.where(total >= _PRIME, total - _PRIME, total)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ranges of some lengths from a and from b (a <= b) are alike."""
        part = lambda x: (self.sums[x + length] + _PRIME - self.sums[x]) % _PRIME
        return times(part(a), self.powers[b - a]) == part(b)
