"""Hashes of words and word shingles of many texts at once, over byte arrays."""

from __future__ import annotations

import functools

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` reproducible 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _MULTIPLIER)


_LETTER = stream(1, 256)
_PLACE = stream(2, 64) | np.uint64(1)


def _word_bytes() -> np.ndarray:
    held = np.zeros(256, dtype=bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        held[a:b] = True
    return held


_IS_WORD = _word_bytes()


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (base, inverse))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word: a run of ASCII letters and digits and of bytes from 128 on."""
    whole = np.frombuffer(data, dtype=np.uint8)
    inside = _IS_WORD[whole]
    hashes, starts = [], []
    at = 0
    while at < len(whole):
        end = min(at + _BLOCK, len(whole))
        if end < len(whole) and inside[end - 1] and inside[end]:  # do not cut a word
            back = np.flatnonzero(~inside[at:end])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(~inside[end:])
                end = end + int(ahead[0]) if len(ahead) else len(whole)
        part, word = whole[at:end], inside[at:end]
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            size = _BLOCK if len(part) <= _BLOCK else 1 << int(len(part) - 1).bit_length()
            power, inverse = _powers(size)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[part] * power[: len(part)])])
                own = (total[past] - total[first]) * inverse[first] + (past - first).astype(np.uint64)
                hashes.append(mix(own))
            starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def unit_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, lower-cased, and where each text's words begin (one more entry)."""
    coded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    hashes, starts = word_hashes(b"\n".join(coded))
    begins = np.cumsum([0] + [len(c) + 1 for c in coded])
    return hashes, np.searchsorted(starts, begins)


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of ``word_hashes``."""
    edge = np.diff(np.concatenate([[0], _IS_WORD[np.frombuffer(data, dtype=np.uint8)].view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on that has as many."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(max(_BLOCK, 1 << int(n).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n])])
        return mix((total[width:] - total[:-width]) * inverse[: n - width + 1])


def window_keys(words: np.ndarray, begin: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and first words of all windows of ``width`` words inside a unit: the smallest hash of the runs of ``gram`` words in it."""
    low, held, most = runs(words, gram), 1, width - gram + 1
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    while held < most:
        step = min(held, most - held)
        low = np.minimum(low[:-step], low[step:])
        held += step
    left = np.repeat(begin[1:], np.diff(begin)) - np.arange(len(words))
    at = np.flatnonzero(left >= width)
    return low[at], at


def shingles(words: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words of each unit, and where each unit's shingles begin.

    A unit with fewer words, but some, has one shingle of all of them.
    """
    n = np.diff(begin)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(out_begin[-1]), np.uint64)
    with np.errstate(over="ignore"):
        long = n >= width
        if long.any():
            run = len(words) - width + 1
            total = np.zeros(run, np.uint64)
            for k in range(width):
                total += words[k : k + run] * _PLACE[k]
            keep = np.zeros(len(words) + 1, np.int32)
            np.add.at(keep, begin[:-1][long], 1)
            np.add.at(keep, begin[:-1][long] + count[long], -1)
            place = np.zeros(len(out) + 1, np.int32)
            np.add.at(place, out_begin[:-1][long], 1)
            np.add.at(place, out_begin[:-1][long] + count[long], -1)
            out[np.cumsum(place[:-1]) > 0] = total[np.cumsum(keep[:-1])[:run] > 0]
        for u in np.flatnonzero((n > 0) & (n < width)):
            w = words[begin[u] : begin[u + 1]]
            out[out_begin[u]] = (w * _PLACE[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
        return mix(out), out_begin


def min_hashes(values: np.ndarray, begin: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """``k`` 32-bit minima for each unit with at least one value; others get zeros."""
    n = np.diff(begin)
    out = np.zeros((len(n), k), np.uint32)
    full = n > 0
    if full.any():
        at = begin[:-1][full]
        odd = stream(seed, k) | np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(k):
                out[full, j] = np.minimum.reduceat(((values * odd[j]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def set_digest(members: np.ndarray) -> int:
    """A signed 64-bit hash of a set of distinct values."""
    if not len(members):
        return 0
    with np.errstate(over="ignore"):
        h = mix(members + _MULTIPLIER).sum(dtype=np.uint64) ^ mix(np.array([len(members)], np.uint64))[0]
    return int(np.int64(np.uint64(h).astype(np.int64)))


def text_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, begin = shingles(*unit_words(texts), width)
    return [np.unique(values[a:b]) for a, b in zip(begin[:-1], begin[1:])]
