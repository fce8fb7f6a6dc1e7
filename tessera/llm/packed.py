"""Integers and flags as bytes, for exchanges of many small numbers between tasks."""

from __future__ import annotations

import numpy as np
import zstandard

#: Arrays of fewer bytes are not worth a compressed frame.
_RAW = 64


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**64: a byte with their width, then their byte planes, compressed where that pays."""
    v = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width + 8]) + planes if len(planes) < _RAW else bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(code: bytes) -> np.ndarray:
    """The integers of pack."""
    width, planes = (code[0] - 8, code[1:]) if code[0] > 8 else (code[0], zstandard.ZstdDecompressor().decompress(code[1:]))
    planes = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def flags(values: np.ndarray) -> bytes:
    """Booleans, eight a byte."""
    return np.packbits(values.astype(bool)).tobytes()


def unflags(code: bytes, n: int) -> np.ndarray:
    """The n booleans of flags."""
    return np.unpackbits(np.frombuffer(code, np.uint8), count=n).astype(bool)
