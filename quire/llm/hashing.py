"""Hashes of the words of a text, all words at once."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
# An odd base and a random value for each byte; fixed so that all tasks agree.
_random = np.random.default_rng(20)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSE = _powers(BASE), _powers(BASE_INVERSE)


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, from prefix sums.

    Words are taken in blocks of at most BLOCK bytes; a longer word is hashed alone.
    """
    count = len(words)
    out = np.empty(count, dtype=np.uint64)
    if not count:
        return out
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=count)
    stops = np.cumsum(sizes)
    at = 0
    while at < count:
        before = stops[at] - sizes[at]
        to = int(np.searchsorted(stops, before + BLOCK, side="right"))
        if to == at:
            out[at] = long_word(words[at])
            at += 1
            continue
        data = np.frombuffer(b"".join(words[at:to]), dtype=np.uint8)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data] * POWERS[: len(data)], out=sums[1:])
        ends = stops[at:to] - before
        starts = ends - sizes[at:to]
        out[at:to] = (sums[ends] - sums[starts]) * INVERSE[starts]
        at = to
    return mix(out + sizes.astype(np.uint64))


def long_word(word: bytes) -> np.uint64:
    total, scale = 0, 1
    for at in range(0, len(word), BLOCK):
        data = np.frombuffer(word[at : at + BLOCK], dtype=np.uint8)
        part = int((BYTE_VALUES[data] * POWERS[: len(data)]).sum(dtype=np.uint64))
        total = (total + part * scale) & ((1 << 64) - 1)
        scale = scale * int(POWERS[len(data)]) & ((1 << 64) - 1)
    return np.uint64(total)


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words; empty where there are fewer words."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(BASE) + hashes[i : i + count]
    return mix(out + np.uint64(width))
