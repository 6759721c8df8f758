"""Words of many texts as arrays of 64-bit hashes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CHARS = 1_000_000
#: Words of more bytes are hashed one by one: there are few of them.
_LONG = 1024
#: Bytes that part words: the six ASCII blanks.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str], chars: int = _CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters; a longer text is a range of its own."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def word_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(texts in one, first byte of each word in it, end of each word, number of words of each text)."""
    joined = b"\n".join([*texts, bytes(8)])
    inside = ~_BLANK.take(np.frombuffer(joined, dtype=np.uint8)[:-8])
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    after = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    return joined, starts, ends, np.diff(np.searchsorted(starts, after), prepend=0)


def hashes_at(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges of ``data``, which needs eight bytes to spare at its end."""
    # The eight bytes from any place on, as one number.
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    sizes = ends - starts
    out = mixed(mixed(sizes.astype(np.uint64) + MULTIPLIER) ^ eight[starts] & _LOW_BYTES[np.minimum(sizes, 8)])
    left = np.flatnonzero((sizes > 8) & (sizes <= _LONG))
    at, rest = starts[left] + 8, sizes[left] - 8
    while len(left):
        out[left] = mixed(out[left] * MULTIPLIER ^ eight[at] & _LOW_BYTES[np.minimum(rest, 8)])
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(memoryview(data)[starts[i] : ends[i]])
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in a row, number of words of each text); words are runs of bytes other than the six ASCII blanks."""
    data, starts, ends, sizes = word_places(texts)
    return hashes_at(data, starts, ends), sizes


class Table:
    """Values by 64-bit key in open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.row = np.full(1 << bits, -1, dtype=np.int32)
        self.keys = keys.astype(np.uint64)
        self.values = values
        at, left = self._home(self.keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = np.flatnonzero(self.row[at] < 0)
            # The last of those that want the same free place gets it.
            self.row[at[free]] = left[free]
            lost = self.row[at] != left
            at, left = (at[lost] + 1) & self.mask, left[lost]
        self.key = np.zeros(1 << bits, dtype=np.uint64)
        self.key[self.row >= 0] = self.keys[self.row[self.row >= 0]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * MULTIPLIER >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not there."""
        at = self._home(keys)
        out = self.row.take(at)
        off = np.flatnonzero((self.key.take(at) != keys) & (out >= 0))
        out[off] = -1
        at = at[off]
        while len(off):
            at = (at + 1) & self.mask
            row = self.row.take(at)
            hit = (row >= 0) & (self.key.take(at) == keys[off])
            out[off[hit]] = row[hit]
            more = (row >= 0) & ~hit
            off, at = off[more], at[more]
        return out
