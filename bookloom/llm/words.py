"""Words of UTF-8 columns as numpy arrays of hashes, for the operators that work on word sequences.

A batch's string buffer is read in place; no Python string is made. Text is taken in pieces of some 256 kB that end
between words, so the working memory does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: bytes of text hashed at a time
PIECE = 1 << 18
_U = np.uint64
_STEP = _U(0xA24BAED4963EE407)
_BACK = _U(pow(0xA24BAED4963EE407, -1, 1 << 64))
#: bytes of text that are worked on together
SLICE = 1 << 20


def _table(outside: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, bool)
    for first, last in outside:
        t[first:last + 1] = False
    return t


#: bytes that belong to words: everything but blanks, and letters, digits and non-ASCII
BLANK_SEPARATED = _table([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _values(seed: int, lower: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))
    if lower:
        v[65:91] = v[97:123]
    return v


@dataclass
class Words:
    """Words of several texts: word i has hash[i] and the bytes start[i]:end[i] of `data`; text t has the words
    first[t]:first[t + 1]."""
    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def rest(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return ends - np.arange(len(self.hash))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def runs(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; only meaningful where rest() >= n."""
        out = np.zeros(len(self.hash), _U)
        with np.errstate(over="ignore"):
            for j in range(min(n, len(self.hash))):
                weight = _U(pow(0x9E3779B97F4A7C15 | 1, 2 * j + 1, 1 << 64))
                out[:len(out) - j] += self.hash[j:] * weight
            return mix(out)

    def joined(self, t: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text t (those that `keep` marks) with one blank between them."""
        at = slice(self.first[t], self.first[t + 1])
        start, end = self.start[at], self.end[at]
        if keep is not None:
            start, end = start[keep], end[keep]
        if not len(start):
            return b""
        # +1 where a word begins, -1 behind its blank; words and the one byte behind each are copied, that byte as a blank
        low, high = int(start[0]), int(end[-1])
        edge = np.zeros(high - low + 2, np.int8)
        edge[start - low] += 1
        edge[end - low + 1] -= 1
        inside = edge.cumsum(dtype=np.int8)[:high - low] > 0
        out = self.data[low:high].copy()
        out[end[:-1] - low] = 32
        return out[inside].tobytes()

    def spans(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hash of size[i] words from word first[i] on, for stretches of any length."""
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(len(self.hash) + 1, _STEP, _U))
            down = np.cumprod(np.full(len(self.hash) + 1, _BACK, _U))
            total = np.concatenate((np.zeros(1, _U), np.cumsum(self.hash * up[:-1])))
            return mix((total[first + size] - total[first]) * down[first] + size.astype(_U))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _pieces(data: np.ndarray, member: np.ndarray) -> Iterator[tuple[int, int]]:
    a, n = 0, len(data)
    while a < n:
        b = min(a + PIECE, n)
        while b < n:  # to the next byte that is in no word
            gap = np.flatnonzero(~member[data[b:b + 4096]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(b + 4096, n)
        yield a, b
        a = b


def hashed(column: pa.Array, member: np.ndarray = BLANK_SEPARATED, lower: bool = False, seed: int = 0) -> Words:
    """The words of each text of a column. `lower` hashes A-Z as a-z; the bytes stay as they are."""
    data, at = utf8(column)
    value = _values(seed, lower)
    power = np.ones(64, _U)
    base = _U(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        power[1:] = np.cumprod(np.full(63, base, _U))
        hashes, starts, ends = [], [], []
        firsts = at[:-1][at[:-1] < at[1:]]
        for a, b in _pieces(data, member):
            part = data[a:b]
            inside = member[part]
            begin = inside.copy()
            begin[1:] &= ~inside[:-1]
            cut = firsts[np.searchsorted(firsts, a):np.searchsorted(firsts, b)] - a
            begin[cut] = inside[cut]  # a text's first byte never goes on with the word before
            s = np.flatnonzero(begin)
            if not len(s):
                continue
            where = np.flatnonzero(inside)
            lead = np.searchsorted(where, s)
            size = np.diff(np.append(lead, len(where)))
            if (most := int(size.max())) > len(power):
                more = np.full(most, base, _U)
                more[0] = 1
                power = np.cumprod(more)
            within = np.arange(len(where)) - np.repeat(lead, size)
            h = np.add.reduceat(value[part[where]] * power[within], lead)
            hashes.append(mix(h + size.astype(_U)))
            starts.append(s + a)
            ends.append(s + a + size)
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(data, np.zeros(0, _U), none, none, np.zeros(len(at), np.int64))
    start = np.concatenate(starts)
    return Words(data, np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, at).astype(np.int64))


def parts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(place, part): a column of texts in parts of some megabytes; a text is never divided."""
    at = utf8(column)[1]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        yield i, column.slice(i, j - i)
        i = j


def sliced(batches: Iterator[pa.RecordBatch], column: int | str) -> Iterator[pa.RecordBatch]:
    """Batches in such parts."""
    for b in batches:
        for i, part in parts(b.column(column)):
            yield b.slice(i, len(part))
