"""Words of whole Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``). Splitting and hashing work on the UTF-8 buffer, so
no Python object is made per word. Texts are handled in slices of a few MB,
which bounds memory whatever the batch size; one longer text is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Places of a word that have random numbers of their own in ``seeded_hash``.
_DRAWN = 64


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ np.uint64((salt * 0xD6E8FEB86659FD93) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of the texts of one slice.

    data: the UTF-8 bytes; text_at: byte offset of each text (one more than texts);
    start, end: byte span of each word; at: index of each text's first word (one
    more than texts); hash: 64 bits per word, uint64.
    """

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    hash: np.ndarray

    def owner(self) -> np.ndarray:
        """The text's index in the slice, for each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def text(self, i: int) -> bytes:
        return self.data[self.text_at[i] : self.text_at[i + 1]].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, UTF-8 bytes) of a string column; nulls are empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together (or one longer text)."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def slices_at(at: np.ndarray, data: np.ndarray, breaks: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``most`` bytes that end at a text's end or behind a byte of ``breaks`` (a table of 256 flags)."""
    lo, end = 0, len(data)
    while lo < end:
        hi = min(lo + most, end)
        if hi < end:
            edge = int(at[np.searchsorted(at, hi, "right") - 1])
            inside = np.flatnonzero(breaks[data[lo:hi]])
            cut = max(edge, lo + int(inside[-1]) + 1 if len(inside) else lo)
            while cut <= lo:  # no such byte in a whole slice: up to the next
                edge = int(at[np.searchsorted(at, hi, "left")])
                inside = np.flatnonzero(breaks[data[hi:min(hi + most, edge)]])
                hi = hi + int(inside[0]) + 1 if len(inside) else min(hi + most, edge)
                cut = hi if len(inside) or hi == edge else lo
            hi = cut
        yield lo, hi
        lo = hi


def split(data: np.ndarray, text_at: np.ndarray, hashed=None) -> Words:
    """``hashed``: another function than ``_hash`` of (data, space, start, end)."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[text_at] = True
    before = np.empty(len(data) + 1, bool)  # a word can't go on across this byte boundary
    before[0] = True
    before[1:] = space
    before |= edge
    start = np.flatnonzero(~space & before[:-1])
    after = np.empty(len(data) + 1, bool)
    after[-1] = True
    after[:-1] = space
    after |= edge
    end = np.flatnonzero(~space & after[1:]) + 1
    at = np.searchsorted(start, text_at)
    return Words(data, text_at, start, end, at, (hashed or _hash)(data, space, start, end))


def _hash(data, space, start, end) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    longest = int(length.max())
    power = np.ones(longest, np.uint64)
    if longest > 1:
        power[1:] = np.multiply.accumulate(np.full(longest - 1, _MULT, np.uint64))
    value = _BYTE[data[~space]] * power[place]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def seeded_hash(salt: int):
    """A hash of words that ``salt`` draws anew: the sum of random numbers by (place in the word, byte).

    Unlike the powers of ``_hash``, these follow no rule, so texts built to cancel them out (Thue-Morse words) don't."""
    drawn = np.random.Generator(np.random.PCG64([20240301, salt])).integers(0, 2**64, _DRAWN * 256, dtype=np.uint64)

    def run(data, space, start, end) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        length = end - start
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        value = drawn[(place % _DRAWN) * 256 + data[~space]]
        far = np.flatnonzero(place >= _DRAWN)  # the numbers repeat there: drawn again from them
        if len(far):
            value[far] = mix(value[far] + (place[far] // _DRAWN).astype(np.uint64) * _MULT, 3 + salt)
        return mix(np.add.reduceat(value, first) + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    return run


def each_slice(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first text, end text, words) for every slice of a text column."""
    at, data = text_buffer(column)
    for lo, hi in slices(at):
        yield lo, hi, split(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of the n words that start at each word (the last n-1 wrap to nothing real: cut by the caller)."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n if len(out) else 0):
        out = out * _MULT + mix(h[i : i + len(out)], salt + 1)
    return mix(out, salt)
