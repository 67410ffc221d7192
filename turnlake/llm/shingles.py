"""Hashed word shingles of a text, with numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]  # A-Z count as a-z
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bit mixer of 64-bit values."""
    x = x + np.uint64(seed * _BASE % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    known = _POWERS.get(name)
    if known is None or len(known) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        known = _POWERS[name] = np.multiply.accumulate(factors)
    return known[:n]


def word_hashes(text: str) -> np.ndarray:
    """One hash per word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SEPARATOR[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * _powers("up", _BASE, len(raw)), out=sums[1:])
    word = (sums[ends] - sums[starts]) * _powers("down", _INVERSE, len(raw))[starts]
    return mix(word + (ends - starts).astype(np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; with fewer words, of the whole sequence."""
    words = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if not len(words):
        return words
    width_here = min(width, len(words))
    hashed = np.zeros(len(words) - width_here + 1, dtype=np.uint64)
    for i in range(width_here):
        hashed = mix(hashed + words[i : len(words) - width_here + 1 + i], i + 1 + 64 * width_here)
    return np.unique(hashed)


def set_key(tokens: np.ndarray, seed: int) -> int:
    """Hash of a set of hashes, as a signed 64-bit number."""
    total = mix(tokens, seed).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total]), seed + 1).view(np.int64)[0])
