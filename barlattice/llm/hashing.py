"""Vectorised hashes of the words of many texts (numpy on the bytes of an Arrow column)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, U)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (multiply and xor-shift)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def powers(n: int) -> np.ndarray:
    """Powers 0 to n-1 of an odd number, modulo 2**64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * U(pow(_ODD, len(_powers), 1 << 64))])
    return _powers[:n]


def slices(texts: pa.Array, most: int = 3_000_000, rows: int = 100_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes and at most ``rows`` texts, so that memory stays bounded."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], _offset_type(texts))[texts.offset:texts.offset + len(texts) + 1])
    start, held = 0, 0
    for i, s in enumerate(sizes):
        if i > start and (held + s > most or i - start >= rows):
            yield start, i
            start, held = i, 0
        held += int(s)
    if start < len(texts):
        yield start, len(texts)


def _offset_type(texts: pa.Array) -> type:
    return np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 offsets of the texts in them. Nulls must have been filled."""
    at = np.frombuffer(texts.buffers()[1], _offset_type(texts))[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return held, at - at[0]


def spans(marks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes that do not cross texts: starts, ends, and the text of each."""
    if not len(marks):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before = np.empty_like(marks)
    before[0], before[1:] = False, marks[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(marks)]
    before[cut] = False
    starts = np.flatnonzero(marks & ~before)
    after = np.empty_like(marks)
    after[-1], after[:-1] = False, marks[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(marks & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 500_000) -> np.ndarray:
    """One hash per span of bytes, made for about ``most`` bytes at a time."""
    if not len(starts):
        return np.zeros(0, U)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(starts[0] + most, ends[-1], most)), len(starts)))
    out, a = [], 0
    for b in cuts[cuts > 0]:
        out.append(_hash_spans(data, starts[a:b], ends[a:b]))
        a = b
    return np.concatenate(out)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inner = np.arange(total) - np.repeat(first, lengths)
    values = data[inner + np.repeat(starts, lengths)].astype(U) + U(1)
    values *= powers(int(lengths.max()))[inner]
    return mix64(np.add.reduceat(values, first) + lengths.astype(U) * U(0xD6E8FEB86659FD93))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the A-Z lower-cased texts, and the text each belongs to."""
    data, offsets = text_bytes(texts)
    starts, ends, owner = spans(~_BLANK[data], offsets)
    return hash_spans(_LOWER[data], starts, ends), owner


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; a shorter text is one shingle."""
    hashes, owner = words(texts)
    counts = np.bincount(owner, minlength=len(texts))
    step = powers(n + 1)[1:]
    whole = np.zeros(0, U)
    if len(hashes) >= n:
        whole = hashes[:len(hashes) - n + 1] * step[0]
        for k in range(1, n):
            whole = whole + hashes[k:len(hashes) - n + 1 + k] * step[k]
        whole = mix64(whole)
    first = np.cumsum(counts) - counts
    out = []
    for at, count in zip(first, counts):
        if count >= n:
            held = np.sort(whole[at:at + count - n + 1])
            out.append(held[np.concatenate([[True], held[1:] != held[:-1]])])
        elif count:
            short = np.array([count], U) * U(0xA0761D6478BD642F)
            out.append(mix64(short + (hashes[at:at + count] * step[:count]).sum(dtype=U)))
        else:
            out.append(np.zeros(0, U))
    return out
