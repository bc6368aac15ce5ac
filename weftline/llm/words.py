"""Words and word n-grams of many texts at once, as 64-bit hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text.  A
word's hash is a polynomial over a random value for each byte, taken from
prefix sums modulo 2**64 and mixed; an n-gram's is a weighted sum of its words'
hashes, mixed again.  All arrays follow the size of the group of texts.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS = np.cumprod(up), np.cumprod(down)
    return _POWERS


def words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash, first and past-the-end byte of every word of all texts in turn, the
    offsets of each text's words, and the joined bytes they refer to."""
    joined = b"\n".join(raws) + b"\n"
    a = np.frombuffer(joined, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, past = edge[::2], edge[1::2]
    up, down = _powers(len(a))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * up[: len(a)])])
    hashes = mix((total[past] - total[first]) * down[first])
    bounds = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return hashes, first, past, np.searchsorted(first, bounds), joined


def strip(hashes: np.ndarray, last: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Hashes of words without their last byte."""
    up, _ = _powers(int(past.max(initial=1)))
    return mix(unmix(hashes) - _BYTE[last] * up[past - 1 - first])


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; short by k - 1 at the end."""
    n = max(len(hashes) - k + 1, 0)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _PLACE[j]
    return mix(out)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles, A-Z lower-cased.  With
    fewer than k words, the whole sequence is one; without words, none."""
    hashes, _, _, at, _ = words([t.encode().lower() for t in texts])
    grams = ngrams(hashes, k)
    out = []
    for i, j in zip(at.tolist(), at[1:].tolist()):
        if j - i >= k:
            out.append(np.unique(grams[i : j - k + 1]))
        else:
            out.append(ngrams(hashes[i:j], j - i) if j > i else hashes[:0])
    return out
