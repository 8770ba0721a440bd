"""Hashes of words and word windows in arrays, and sorted hashes packed into a few bytes each.

The operators that compare every window of every document send their hashes as packed blobs: one
row per sender and bucket instead of one per hash. The upper bits of a hash are its bucket, so they
need not be sent, and what is left grows by a bit whenever the buckets are doubled with the data.
"""

from __future__ import annotations

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits; a one-to-one function."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of the window of `width` words at every place, by doubling; the last ones are cut off."""
    if len(words) < width:
        return np.empty(0, dtype=np.uint64)
    power, done, out = words, 0, None
    # a plain number, cut to 64 bits by hand: arrays wrap around in silence, single numbers warn
    size, scale = 1, factor
    rest = width
    while rest:
        if rest & 1:
            n = len(words) - done - size + 1
            part = power[done : done + n]
            out = part if out is None else out[:n] * np.uint64(scale) + part
            done += size
        rest >>= 1
        if rest:
            n = len(power) - size
            power = power[:n] * np.uint64(scale) + power[size : size + n]
            size, scale = size * 2, scale * scale & 0xFFFFFFFFFFFFFFFF
    return mix(out[: len(words) - width + 1])


def cuts_by_bucket(ordered: np.ndarray, bits: int) -> np.ndarray:
    """Where the buckets of sorted hashes begin, and the end."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(ordered, starts), len(ordered))


def pack(ordered: np.ndarray, bits: int, kept: int) -> bytes:
    """Sorted distinct hashes of one bucket: `kept` bits below the bucket's, as steps of four bytes."""
    if not len(ordered):
        return b""
    values = (ordered << np.uint64(bits)) >> np.uint64(64 - kept)
    steps = np.diff(values, prepend=np.uint64(0))
    if steps.max() < 1 << 32:
        return b"\x04" + steps.astype("<u4").tobytes()
    return b"\x08" + values.astype("<u8").tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, dtype=np.uint64)
    if blob[0] == 4:
        return np.cumsum(np.frombuffer(blob, dtype="<u4", offset=1), dtype=np.uint64)
    return np.frombuffer(blob, dtype="<u8", offset=1)


def flags(values: np.ndarray) -> bytes:
    return np.packbits(values).tobytes()


def unflag(blob: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=count).astype(bool)


def bucket_bits(n: float, each: float, least: int = 6, most: int = 20) -> int:
    """Bits for about `n / each` buckets."""
    bits = least
    while bits < most and (1 << bits) * each < n:
        bits += 1
    return bits
