"""Words of whole Arrow batches as NumPy arrays: positions and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: a worker lives on for other tasks beside a full executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A fixed pseudo-random 64-bit word for each byte.
BYTE_WORDS = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


@dataclass
class Words:
    """``first[d]:first[d + 1]`` are the words of text d; a word is bytes ``start:end`` of ``data``; ``lo``: where ``data`` begins."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    rows: slice
    data: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def prefix(self, length: int) -> np.ndarray:
        """The codes of the first ``length`` bytes of each word (a shorter word is its own prefix)."""
        end = np.minimum(self.end, self.start + length)
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[self.start]) * self.inverse[self.start] + (end - self.start).astype(_U))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Lexer:
    """Splits UTF-8 texts at the given ASCII delimiters, A to Z lower-cased first if asked; runs of the bytes ``apart`` are
    words of their own."""

    def __init__(self, delimiters: Iterable[int], lower: bool = True, apart: Iterable[int] = ()):
        self.kind = np.ones(256, np.uint8)
        self.kind[list(apart)] = 2
        self.kind[list(delimiters)] = 0
        byte = np.arange(256)
        if lower:
            byte[65:91] += 32
        self.value = BYTE_WORDS[byte]
        self._power = np.ones(1, _U)
        self._inverse = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self._power) < n:
            with np.errstate(over="ignore"):
                for name, base in (("_power", _ODD), ("_inverse", _BACK)):
                    steps = np.full(n, base, _U)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def scan(self, data: np.ndarray, bounds: np.ndarray, rows: slice = slice(0)) -> Words:
        """Words of the texts ``data[bounds[d]:bounds[d + 1]]``; words of equal (lower-cased) bytes have equal codes."""
        n = len(data)
        self._powers(n + 1)
        kind = np.zeros(n + 2, np.uint8)
        kind[1:-1] = self.kind[data]
        cut = kind[1:] != kind[:-1]
        cut[bounds] = True
        start = np.flatnonzero((kind[1:] > 0) & cut)
        end = np.flatnonzero((kind[:-1] > 0) & cut)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, _U)
            np.cumsum(self.value[data] * self._power[:n], out=sums[1:])
            code = mix((sums[end] - sums[start]) * self._inverse[start] + (end - start).astype(_U))
        return Words(np.searchsorted(start, bounds), start, end, code, rows, data, bounds, sums, self._inverse)

    def blocks(self, column: pa.Array, most: int = 1 << 20) -> Iterator[Words]:
        """The words of a string column, in runs of rows of about ``most`` bytes (a longer text is a run of its own)."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        if not n:
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            to = min(to, n)
            yield self.scan(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], slice(at, to))
            at = to
        release()


@dataclass
class Segment:
    """Texts ``row``, ``row + 1`` and so on, as bytes ``bounds[k]:bounds[k + 1]`` of ``data``; or a stretch of the one text ``row``
    that ``begins`` or ``ends`` with it or not."""

    row: int
    data: np.ndarray
    bounds: np.ndarray
    begins: bool = True
    ends: bool = True


def segments(column: pa.Array, most: int = 1 << 20) -> Iterator[Segment]:
    """A string column (null: empty) in runs of whole texts of about ``most`` bytes; a longer text by itself, in stretches cut before
    a space that follows printable ASCII and is not the text's last byte. Memory is bounded by the longest stretch without such a place."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1), n)
        first, last = int(offsets[at]), int(offsets[to])
        if last - first <= most:
            yield Segment(at, data[first:last], offsets[at : to + 1] - first)
        else:
            begin = first
            while begin < last:
                cut, look = begin + most, begin + most
                while look < last - 1:
                    here = data[look : min(look + (1 << 16), last - 1)]
                    before = data[look - 1 : look - 1 + len(here)]
                    found = np.flatnonzero((here == 0x20) & (before > 0x20) & (before < 0x7F))
                    if len(found):
                        cut = look + int(found[0])
                        break
                    look += len(here)
                else:
                    cut = last
                yield Segment(at, data[begin:cut], np.array([0, cut - begin]), begin == first, cut == last)
                begin = cut
        at = to
    release()


def runs(code: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k consecutive words of each text (a text of fewer, but some, words is one run), and their offsets by text."""
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], made) + np.repeat(first[:-1], made)
    width = np.repeat(np.minimum(count, k), made)
    padded = np.concatenate([code, np.zeros(k, _U)])
    total = width.astype(_U) * _U(0xA24BAED4963EE407)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = (total ^ np.where(j < width, padded[at + j], _U(0))) * _U(_ODD) + _U(j + 1)
            total ^= total >> _U(29)
    return mix(total), offsets


#: White space; ASCII punctuation; all that is no letter or digit, up to ASCII's end.
SPACES = [0x20, *range(0x09, 0x0E)]
PUNCTUATION = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]
NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
