"""Runs of bytes of Arrow text columns, and exact numbers for equal ones within a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_set(*members: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE = byte_set(0x20, *range(0x09, 0x0E))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes that are ``inside``; no run goes on into the next text."""
    full = offsets[:-1] < offsets[1:]
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def numbered(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each byte range, equal for equal bytes only, and the distinct strings in order of their numbers.

    Ranges come in order and do not overlap.
    """
    size = end - start
    edge = np.zeros(len(raw) + 1, np.int8)
    some = size > 0
    np.add.at(edge, start[some], 1)
    np.add.at(edge, end[some], -1)
    data = raw[np.cumsum(edge[:-1]) > 0]
    offsets = np.concatenate([[0], np.cumsum(size)])
    strings = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
