"""Sets of hashed word shingles, computed on bytes with numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PART, _PLACES = 1 << 18, 64

#: Bytes that end a word, space and 0x09 to 0x0D.
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each place of a word, so that words of any structure collide by chance only; places from
#: _PLACES on use the same numbers times a power of an odd number.
_TABLE = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * _BASE)
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def _few(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words of these sizes, whose bytes follow each other."""
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(x)) - np.repeat(begins, sizes)
    each = _TABLE[((place & (_PLACES - 1)) << 8) | x]
    if (most := int(sizes.max())) > _PLACES:
        turns = np.concatenate([[np.uint64(1)], np.cumprod(np.full(most // _PLACES, _BASE, np.uint64))])
        each = each * turns[place // _PLACES]
    return mix(np.add.reduceat(each, begins) + sizes.astype(np.uint64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of the lower-cased bytes, some at a time."""
    gap = np.concatenate([[True], _GAP[data], [True]])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    out, at = [], 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + _PART, "right")))
        low, high = int(starts[at]), int(ends[upto - 1])
        part = data[low:high]
        out.append(_few(_LOWER[part[~_GAP[part]]], ends[at:upto] - starts[at:upto]))
        at = upto
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), starts


def _shingles(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        return mix(np.array([(words * _PLACE[:n]).sum() + np.uint64(n)], np.uint64))
    total = words[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        total = total + words[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(mix(total))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; empty for null and for texts without words."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    words, starts = word_hashes(data)
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    cuts = np.searchsorted(starts, begins)
    return [_shingles(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def set_hash(h: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(mix(np.array([mix(h + _BASE).sum() + np.uint64(len(h))], np.uint64)).view(np.int64)[0])
