"""Word shingle hashes of many texts at once, in numpy; used inside tasks."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation.
_BREAKS = _SPACE.copy()
_BREAKS[[i for i in range(128) if not chr(i).isalnum()]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_N = 1 << 16
_UP, _DOWN = _powers(_BASE, _N), _powers(_INVERSE, _N)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str], punctuation: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower case for A-Z, split at ASCII white space), and the text of each.

    Without punctuation, words are split at ASCII punctuation as well.
    """
    joined = b"\n".join(x.encode().lower() for x in texts)
    sizes = np.array([len(x.encode()) if not x.isascii() else len(x) for x in texts], dtype=np.int64)
    starts_of = np.cumsum(sizes + 1) - (sizes + 1)
    raw = np.frombuffer(joined, dtype=np.uint8)
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = (_SPACE if punctuation else _BREAKS)[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    values = raw.astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(starts), dtype=np.uint64)
    if (ends - starts).max() > _N // 2:  # words longer than the table of powers
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            out[i] = _long_word(values[a:b])
    else:
        # powers restart in each block; words that cross a border are in the block of their start
        step = _N // 2
        for at in range(0, len(raw), step):
            own = slice(*np.searchsorted(starts, [at, at + step]))
            if own.start == own.stop:
                continue
            part = values[at : min(len(raw), at + _N)]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * _UP[: len(part)], out=sums[1:])
            out[own] = (sums[ends[own] - at] - sums[starts[own] - at]) * _DOWN[starts[own] - at]
    return mix(out + (ends - starts).astype(np.uint64)), np.searchsorted(starts_of, starts, side="right") - 1


def _long_word(values: np.ndarray) -> np.uint64:
    total, scale = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), _N):
            part = values[at : at + _N]
            total += (part * _UP[: len(part)]).sum(dtype=np.uint64) * scale
            scale *= _UP[-1] * _BASE
    return total


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of one text; the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    m = len(words) - k + 1
    out = words[:m] + np.uint64(k)
    for j in range(1, k):
        # words are mixed already, so a polynomial of them is enough
        out *= _BASE
        out += words[j : j + m]
    return mix(out)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(shingles(words[a:b], n)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def text_batches(texts: list, most: int = 1 << 20):
    """Pairs of bounds of runs of texts with some million characters together."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
