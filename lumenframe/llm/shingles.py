"""Word shingles of a text as 64-bit hashes, vectorised over the bytes of the text."""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SOLID = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _weights(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


_WEIGHTS = _weights(4096)


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    solid = _SOLID[raw]
    edges = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0, append=0))
    if not len(edges):
        return np.empty(0, np.uint64)
    sizes = edges[1::2] - edges[::2]
    first = np.cumsum(sizes) - sizes
    chars = _LOWER[raw[solid]].astype(np.uint64) + _U(1)
    place = np.arange(len(chars)) - np.repeat(first, sizes)
    most = int(sizes.max())
    weights = _WEIGHTS if most <= len(_WEIGHTS) else _weights(most)
    sums = np.add.reduceat(chars * weights[place], first)
    return mix(sums ^ (sizes.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words make one shingle,
    a text without words an empty set."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    width = min(WORDS, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = mix(out * _U(0x2545F4914F6CDD1D) + words[j : len(words) - width + 1 + j])
    return np.unique(out)
