"""Line checksums of whole columns: NumPy steps over Arrow batches, a byte position of all lines at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, the first of each text with one more at the end, and which texts are given and plain ASCII."""
    given = texts.is_valid().to_numpy(zero_copy_only=False)
    texts = texts.fill_null("").cast(pa.large_binary())
    _, at, data = texts.buffers()
    first = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[first[0] : first[-1]] if data is not None else np.zeros(0, np.uint8)
    first = first - first[0]
    high = np.concatenate([[0], np.cumsum(raw >= 0x80)])
    return raw, first, given & (high[first[1:]] == high[first[:-1]])


def xor_of(texts: pa.Array) -> pa.Array:
    raw, first, plain = _bytes(texts)
    out = np.zeros(len(plain), np.int32)
    full = np.flatnonzero(first[:-1] < first[1:])
    if len(full):
        out[full] = np.bitwise_xor.reduceat(raw, first[:-1][full])
    return pa.array(out, mask=~plain)


def _ccitt_table() -> np.ndarray:
    reg = np.arange(256, dtype=np.int32) << 8
    for _ in range(8):
        reg = np.where(reg & 0x8000, reg << 1 ^ 0x1021, reg << 1) & 0xFFFF
    return reg


_CCITT = _ccitt_table()


def crc_of(texts: pa.Array) -> pa.Array:
    raw, first, plain = _bytes(texts)
    size = np.diff(first)
    # longest texts first, so those with a byte at a position are always a prefix
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    reg = np.full(len(order), 0xFFFF, np.int32)
    live = len(order)
    for i in range(int(size[0]) if len(size) else 0):
        while live and size[live - 1] <= i:
            live -= 1
        part = reg[:live]
        reg[:live] = (part << 8 & 0xFFFF) ^ _CCITT[part >> 8 ^ raw[start[:live] + i]]
    out = np.empty(len(order), np.int32)
    out[order] = reg
    return pa.array(out, mask=~plain)


@F.arrow_udf(IntegerType())
def _xor8(texts: pa.Array) -> pa.Array:
    return xor_of(texts)


@F.arrow_udf(IntegerType())
def _crc16(texts: pa.Array) -> pa.Array:
    return crc_of(texts)


def xor8(text: Column) -> Column:
    """XOR of all characters of an ASCII string; NULL for any other text, so compare null-safely."""
    return _xor8(text)


def crc16(text: Column) -> Column:
    """CRC-16/CCITT-FALSE of an ASCII string; NULL for any other text, so compare null-safely."""
    return _crc16(text)


def hex_upper(value: Column, width: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), width, "0")
