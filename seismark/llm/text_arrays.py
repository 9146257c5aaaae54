"""Word splitting and hashing over whole Arrow string columns with numpy.

A batch of texts is one byte buffer with offsets.  Everything here works on that buffer: a
256-entry table says which bytes belong to words, word edges are found by comparing neighbours,
and the hash of any byte range comes from one prefix sum (polynomial hash modulo 2**64, whose odd
base has an inverse).  UTF-8 continuation and lead bytes are all >= 0x80, so a table over bytes is
enough for classes that are defined on ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20
BLOCK_TEXTS = 4096

_powers = {BASE: np.ones(1, np.uint64), BASE_INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled as longer texts come."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def byte_class(word_bytes: set[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(word_bytes)] = True
    return table


#: Words of the n-gram join and of the classifiers: anything but ASCII white space.
NOT_SPACE = byte_class(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Words of decontamination: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_CHARS = byte_class(set(range(0x80, 256)) | set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of the texts first..first+len(offsets)-2 of a batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    prefix: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    def range_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[start:end]; equal bytes hash alike wherever they stand."""
        raw = (self.prefix[ends] - self.prefix[starts]) * powers(BASE_INVERSE, len(self.data) + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def bounds(self) -> np.ndarray:
        """First word of each text, and the number of words at the end."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))


def split(texts: pa.Array, table: np.ndarray, fold: np.ndarray = LOWER) -> Iterator[Words]:
    """The words of whole texts, in blocks of about BLOCK_BYTES and BLOCK_TEXTS at most; a longer text is a block of its own."""
    data, offsets = buffers(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
        last = min(n, first + BLOCK_TEXTS, max(last, first + 1))
        yield _block(first, fold[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first], table)
        first = last


def _block(first: int, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    inside = table[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=prefix[1:])
    return Words(first, data, offsets, starts, ends, np.searchsorted(offsets, starts, "right") - 1, prefix)


def window_hashes(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, and the index of the first word of each."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total = total * np.uint64(BASE) + hashes[at + j]
    return mix(total + np.uint64(k)), at
