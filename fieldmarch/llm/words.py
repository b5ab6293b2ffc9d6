"""Vectorised words and shingles of Arrow text columns.

A word is a longest run of characters outside space and U+0009..U+000D, with A-Z lower-cased. Words, and runs of words, are known by
64-bit hashes: byte values from a fixed random table, weighted by powers of an odd number and mixed, so equal words of any two texts
have equal hashes and the work is a few array steps a byte. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins; one offset more than texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most`` bytes, a longer single text alone."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for ordered, overlapping or not, short ranges; a segment of values at a time."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = int(np.searchsorted(starts, base + SEGMENT, side="left"))
        s, e = starts[first:last] - base, ends[first:last] - base
        span = int(e.max())
        up, down = _powers(span + 1)
        total = np.zeros(span + 1, np.uint64)
        np.cumsum(values[base : base + span] * up[:span], out=total[1:])
        out[first:last] = (total[e] - total[s]) * down[s]
        first = last
    return mix(out ^ (ends - starts).astype(np.uint64))


class Words:
    """Words of a column of texts: ``hash`` of each, ``first`` the index of each text's first word (one more at the end), byte ranges."""

    def __init__(self, texts: pa.Array):
        raw, offsets = text_buffers(texts)
        full = offsets[:-1] < offsets[1:]
        inside = ~_SPACE[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][full]] = False
        after = np.zeros(len(raw), bool)
        after[:-1] = inside[1:]
        after[offsets[1:][full] - 1] = False
        self.raw, self.offsets = raw, offsets
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.hash = range_hashes(_BYTE[_LOWER[raw]], self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and where each text's begin; a text with fewer words gives its whole sequence as one run."""
    runs = np.where(words.count >= k, words.count - k + 1, np.minimum(words.count, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], runs)
    size = np.repeat(np.minimum(words.count, k), runs)
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words.hash, np.zeros(k, np.uint64)])
    for j in range(k):
        h = np.where(j < size, h * _STEP + padded[at + j], h)
    return mix(h ^ size.astype(np.uint64)), first


def sets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and where each text's begin."""
    out = hashes.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    # the first of a text is new whatever the text before ended in
    new[first[:-1][first[:-1] < first[1:]]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[first]


def fold(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each text's ordered values; 0 where there are none."""
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(first[:-1] < first[1:])
    if len(full):
        out[full] = mix(np.add.reduceat(mix(values), first[:-1][full]) ^ np.diff(first)[full].astype(np.uint64))
    return out


def minima(values: np.ndarray, first: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """MinHash values of ``n`` hash functions, a row a text; rows of texts without values are all ones."""
    out = np.full((len(first) - 1, n), np.uint64(0xFFFFFFFFFFFFFFFF))
    full = np.flatnonzero(first[:-1] < first[1:])
    if not len(full):
        return out
    salt = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1))
    # each group of texts stays in the processor's cache through all functions
    cuts = [0, *np.flatnonzero(np.diff(first[full] // (1 << 15))) + 1, len(full)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = full[a:b]
        base, stop = first[rows[0]], first[rows[-1] + 1]
        part, at = values[base:stop], first[rows] - base
        for k in range(n):
            out[rows, k] = np.minimum.reduceat((part ^ salt[2 * k]) * (salt[2 * k + 1] | np.uint64(1)), at)
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
