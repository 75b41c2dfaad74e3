"""Whole texts as byte arrays: word spans, 64-bit word hashes and shingles, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20
_rng = np.random.default_rng(20240229)
#: Random value of each byte, and an odd base with its inverse modulo 2^64.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = int(_rng.integers(1 << 40, 1 << 62)) | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that end a word: space and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Odd multipliers for the words of a shingle, by place.
PLACE = _rng.integers(1 << 40, 1 << 62, 64, dtype=np.uint64) | U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, in tables of a power of two at least."""
    size = max(CHUNK * 2, 1 << max(n - 1, 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (BASE, BASE_INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def forget_powers() -> None:
    _powers.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (in place where it can)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def groups_by_bytes(texts: list[bytes], limit: int = CHUNK):
    """Slices (from, to) of consecutive texts of about ``limit`` bytes; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flags = np.ones(len(buf) + 2, dtype=np.int8)
    flags[1:-1] = SPACE[buf]
    step = np.diff(flags)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each buf[start:end], the same wherever the bytes stand."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = powers(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lower-cased, in order; and the number of words of each text."""
    joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    stops = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    out, counts, at = [], np.zeros(len(texts), dtype=np.int64), 0
    while at < len(joined):
        end = min(at + CHUNK, len(joined))
        while end < len(joined):  # on to the next space, so that no word is cut
            gap = np.flatnonzero(SPACE[joined[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 4096, len(joined))
        buf = LOWER[joined[at:end]]
        s, e = _spans(buf)
        out.append(span_hashes(buf, s, e))
        if len(s):
            counts += np.bincount(np.searchsorted(stops, s + at, side="right"), minlength=len(texts))
        at = end
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), counts


def shingle_sets(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; a shorter sequence is one shingle; none: empty."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return mix((words * PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + U64(n))
    h = words[: n - size + 1] * PLACE[0]
    for k in range(1, size):
        h += words[k : n - size + 1 + k] * PLACE[k]
    return np.unique(mix(h + U64(size)))
