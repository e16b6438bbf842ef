"""Vectorised splitting and 64-bit hashing of the words of many texts at once, on their UTF-8 bytes.

Texts arrive as Arrow strings, so offsets and bytes are used without a Python object per text or word.
Null texts have no words. Work is cut into blocks of about BLOCK bytes of whole texts, which bounds memory
at some hundred bytes for each byte of a block (or of the longest single text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _lower(table: np.ndarray) -> np.ndarray:
    table[65:91] = table[97:123]
    return table


def letters(separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash value of each byte after folding A-Z, whether the byte separates words)."""
    values = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    return _lower(values), separators


def _mask(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Words between ASCII white space, and words of ASCII letters, digits and every byte from 0x80 on.
SPACED = letters(_mask((0x09, 0x0D), (0x20, 0x20)))
ALNUM = letters(_mask((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)))
ALNUM[1][65:91] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        if size > 4 * BLOCK:
            _powers.clear()
        with np.errstate(over="ignore"):
            pair = []
            for b in (_BASE, _INVERSE):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                pair.append(np.multiply.accumulate(x))
        _powers[size] = (pair[0], pair[1])
    return _powers[size]


def blocks(texts: pa.Array):
    """Ranges [a, b) of whole texts with about BLOCK bytes each, with the bytes and the offsets in them."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    valid = np.asarray(texts.is_valid())
    lengths = np.where(valid, np.diff(offsets), 0)
    a, n = 0, len(texts)
    ends = np.cumsum(lengths)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, "right")))
        if valid[a:b].all():
            part = data[offsets[a] : offsets[b]]
        else:
            part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in range(a, b) if valid[i]] or [data[:0]])
        yield a, b, part, np.concatenate([[0], np.cumsum(lengths[a:b])])
        a = b


def words(part: np.ndarray, offsets: np.ndarray, kind=SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: (hash, first byte, end byte) of each word, and the index of each text's first word, closed by the count."""
    values, separators = kind
    n = len(part)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[part] * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def prefixes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, kind=ALNUM) -> np.ndarray:
    """Hash of the first `size` bytes of each word (of all its bytes, if it is shorter)."""
    up, down = _power(len(part) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kind[0][part] * up[: len(part)], dtype=np.uint64)])
        stops = np.minimum(ends, starts + size)
        return mix((sums[stops] - sums[starts]) * down[starts] + np.uint64(size << 32) + (stops - starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * _BASE + hashes[i : i + n]
        return mix(out)
