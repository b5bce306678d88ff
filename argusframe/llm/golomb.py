"""Golomb-Rice coding of sorted distinct integers, on numpy arrays."""

from __future__ import annotations

import numpy as np

_HEAD = np.dtype([("n", "<i8"), ("k", "<i8"), ("unary", "<i8")])


def rice_encode(values: np.ndarray) -> bytes:
    """values: sorted, distinct, non-negative int64. The gaps are coded: quotient in unary, k low bits as they are."""
    n = len(values)
    if n == 0:
        return np.zeros(1, _HEAD).tobytes()
    gaps = np.diff(values, prepend=np.int64(-1)) - 1
    mean = float(gaps.mean())
    k = max(0, int(np.floor(np.log2(mean * np.log(2))))) if mean > 1.5 else 0
    quotient = gaps >> k
    ends = np.cumsum(quotient + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    low = np.unpackbits(gaps.astype(">i8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - k :]
    head = np.array([(n, k, len(unary))], _HEAD)
    return head.tobytes() + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    n, k, length = (int(x) for x in np.frombuffer(blob, _HEAD, 1)[0])
    if n == 0:
        return np.zeros(0, np.int64)
    body = np.frombuffer(blob, np.uint8, offset=_HEAD.itemsize)
    size = (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(body[:size], count=length) == 0)
    quotient = np.diff(ends, prepend=-1).astype(np.int64) - 1
    if k == 0:
        return np.cumsum(quotient + 1) - 1
    # the 64 bits from the byte in which each value begins hold all of it up to 57 bits, and the byte after them the rest
    padded = np.concatenate([body[size:], np.zeros(9, np.uint8)])
    begin = np.arange(n, dtype=np.int64) * k
    words = np.lib.stride_tricks.as_strided(np.frombuffer(padded.data, ">u8", 1), (len(padded) - 7,), (1,))
    shift = (begin & 7).astype(np.uint64)
    bits = words[begin >> 3].astype(np.uint64) << shift
    bits |= padded[(begin >> 3) + 8].astype(np.uint64) >> (np.uint64(8) - shift)
    low = (bits >> np.uint64(64 - k)).astype(np.int64)
    return np.cumsum((quotient << k) + low + 1) - 1
