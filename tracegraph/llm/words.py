"""Words of a text and 64-bit hashes of them, computed with arrays."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# An odd multiplier has an inverse modulo 2^64, so the hash of a piece is a difference of
# two prefix sums moved back to the origin.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    solid = np.concatenate(([False], ~SPACE[data], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# Bytes handled at once, few enough for the arrays to stay in a processor's cache.
CHUNK = 1 << 15


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end, the same wherever they lie. Pieces lie in order, apart from each other."""
    out = np.zeros(len(starts), dtype=np.uint64)
    cuts = [0]
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, int(starts[cuts[-1]]) + CHUNK))))
    size = max((int(ends[j - 1] - starts[i]) for i, j in zip(cuts, cuts[1:])), default=0)
    forth, back = powers(BASE, size), powers(INVERSE, size + 1)
    for i, j in zip(cuts, cuts[1:]):
        low, high = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * forth[: high - low], out=sums[1:])
        first = starts[i:j] - low
        out[i:j] = mix((sums[ends[i:j] - low] - sums[first]) * back[first])
    return out


def word_hashes(text: str | None, fold: bool = True) -> np.ndarray:
    """Hashes of the words in order; with ``fold`` of the lower-cased text."""
    body = (text or "").lower() if fold else text or ""
    data = np.frombuffer(body.encode("utf-8"), dtype=np.uint8)
    return piece_hashes(data, *spans(data))


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, of the whole sequence if it is shorter; none without words."""
    if len(hashes) < width:
        width = max(1, len(hashes))
    out = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(BASE) + hashes[k : len(hashes) - width + 1 + k])
    return out


# ASCII letters and digits stay (capitals folded), other ASCII characters become spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def bare_words(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words, ASCII punctuation left out."""
    data = np.frombuffer((text or "").lower().encode("utf-8").translate(LETTERS), dtype=np.uint8)
    return piece_hashes(data, *spans(data))
