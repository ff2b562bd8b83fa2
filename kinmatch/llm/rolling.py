"""Rolling hashes of numpy arrays, and the windows' content-chosen anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: A 64-bit symbol for each byte value.
BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Slices:
    """Rabin-Karp hashes, mod 2**64, of any slices of an array of 64-bit symbols, from one pass over it."""

    room, up, down = 0, None, None

    @classmethod
    def reserve(cls, n: int) -> None:
        if n > cls.room:
            cls.room = max(n, 1 << 16)
            cls.up, cls.down = powers(BASE, cls.room), powers(BACK, cls.room)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.reserve(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self.up[:n], out=self.sums[1:])

    def runs(self, width: int) -> np.ndarray:
        """Of every slice of this width."""
        n = max(0, len(self.sums) - width)
        out = self.sums[width : width + n] - self.sums[:n]
        out *= self.down[:n]
        return mix(out)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one, where in it words start and stop, and the number of words of each text."""
    text = b" ".join([b"", *texts, b""])
    space = _SPACE[np.frombuffer(text, np.uint8)]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return text, starts, stops, np.diff(np.searchsorted(starts, ends, "right"), prepend=0)


def slice_hashes(text: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return Slices(BYTE_SYMBOLS[np.frombuffer(text, np.uint8)])(starts, stops)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_table()


def prefix_crcs(text: bytes, starts: np.ndarray, stops: np.ndarray, width: int) -> np.ndarray:
    """CRC-32 of the first `width` bytes, at most, of slices of a text."""
    raw = np.frombuffer(text, np.uint8)
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for k in range(width):
        at = np.flatnonzero(starts + k < stops)
        out[at] = _CRC[(out[at] ^ raw[starts[at] + k]) & np.uint32(255)] ^ (out[at] >> np.uint32(8))
    return out ^ np.uint32(0xFFFFFFFF)


def binary_array(text: bytes, starts: np.ndarray, stops: np.ndarray) -> pa.BinaryArray:
    """Slices of a text as an Arrow array, without an object for each."""
    sizes = stops - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = np.frombuffer(text, np.uint8)[spans(starts, sizes)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    rest = width - span
    return (np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] values, and so on."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document, sorted, with those that touch or overlap made one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    # the furthest stop so far within the document
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + doc.astype(np.int64) * far) - doc.astype(np.int64) * far
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last]
