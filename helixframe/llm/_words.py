"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Odd multipliers of the word and shingle hashes; any odd 64-bit numbers do.
_BASE = 0x9E3779B97F4A7C15
_MIX_1, _MIX_2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
#: Bytes hashed at a time: bounds the temporary arrays, however long a text is.
CHUNK = 1 << 19

SPACE = b"\t\n\x0b\x0c\r "


def byte_class(excluded: bytes | Iterable[int]) -> np.ndarray:
    """A 256-entry table that is true for bytes that belong to words."""
    out = np.ones(256, dtype=bool)
    out[list(excluded)] = False
    return out


#: ``[^\\x20\\x09-\\x0D]+``
NOT_SPACE = byte_class(SPACE)
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, after lower-casing A-Z
ALNUM = byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h *= _MIX_1
    h ^= h >> _U(33)
    h *= _MIX_2
    h ^= h >> _U(33)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets of texts in them; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterable[pa.RecordBatch], column: str | int, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose texts have ``limit`` bytes at most (or one longer text): work arrays are many
    times as large as the texts, so this bounds a task's memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            used = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, used + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Byte range of each word (``start``, ``end``), 64-bit ``hash`` and ``first``: the n+1 offsets of texts in words."""

    def __init__(self, column: pa.Array, member: np.ndarray, lower: bool, hashed: bool = True):
        self.buf, offsets = text_buffer(column)
        if lower:
            self.buf = _LOWER[self.buf]
        n = len(self.buf)
        inside = member[self.buf]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        if hashed:
            self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        longest = int((self.end - self.start).max(initial=0))
        power = np.cumprod(np.full(longest + 1, _BASE, np.uint64))
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + CHUNK, "right")))
            size = self.end[i:j] - self.start[i:j]
            at = np.concatenate(([0], np.cumsum(size)))
            place = np.arange(at[-1]) - np.repeat(at[:-1], size)
            term = (self.buf[place + np.repeat(self.start[i:j], size)].astype(np.uint64) + _U(1)) * power[place]
            out[i:j] = mixed(np.add.reduceat(term, at[:-1]) + size.astype(np.uint64))
            i = j
        return out

    def text(self, word: int) -> bytes:
        return self.buf[self.start[word] : self.end[word]].tobytes()

    def joined(self, first: int, last: int) -> bytes:
        """Words first..last-1 with one space between them."""
        return b" ".join(self.text(i) for i in range(first, last))


def numbered(words: Words, member: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words (byte by byte), and the distinct words."""
    raw = words.buf[member[words.buf]]
    ends = np.concatenate(([0], np.cumsum(words.end - words.start)))
    told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
    return told.indices.to_numpy(zero_copy_only=False).astype(np.int64), told.dictionary


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries: position i stands for i..i+k-1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _U((_BASE * (2 * j + 3) | 1) & 0xFFFFFFFFFFFFFFFF)
    return mixed(total)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + size), one after the other."""
    at = np.concatenate(([0], np.cumsum(sizes)))
    return np.arange(at[-1]) - np.repeat(at[:-1] - starts, sizes)


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))
