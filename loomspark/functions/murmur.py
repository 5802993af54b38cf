"""MurmurHash3 x64 128 of many words of one length at a time; the first 64 bits are what DNA sketches exchange."""

from __future__ import annotations

import numpy as np

# The multipliers of the published hash and of its final mix.
C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
F1, F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
A1, A2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _last(x: np.ndarray) -> np.ndarray:
    for by in (F1, F2):
        x = (x ^ (x >> np.uint64(33))) * by
    return x ^ (x >> np.uint64(33))


def first_lane(words: np.ndarray, seed: int) -> np.ndarray:
    """The first 64 bits for each row of an (n, length) matrix of bytes."""
    n, length = words.shape
    whole = length // 16
    padded = np.zeros((n, (whole + 1) * 16), np.uint8)
    padded[:, :length] = words
    lanes = padded.view("<u8").astype(np.uint64)
    a = np.full(n, seed, np.uint64)
    b = a.copy()
    with np.errstate(over="ignore"):
        for i in range(whole + 1):
            # An all-zero rest mixes to zero, so the rest of less than 16 bytes is one more block without its turns.
            a ^= _turn(lanes[:, 2 * i] * C1, 31) * C2
            if i < whole:
                a = (_turn(a, 27) + b) * np.uint64(5) + A1
            b ^= _turn(lanes[:, 2 * i + 1] * C2, 33) * C1
            if i < whole:
                b = (_turn(b, 31) + a) * np.uint64(5) + A2
        a, b = a ^ np.uint64(length), b ^ np.uint64(length)
        a = a + b
        b = b + a
        return _last(a) + _last(b)
