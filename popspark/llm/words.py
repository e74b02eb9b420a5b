"""Hashes of words and word windows of whole texts, as numpy arrays, inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once.
SLICE = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Powers that are kept; higher ones are products of two.
LOW = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _chain(factor: int, n: int) -> np.ndarray:
    """The first n powers of a number, modulo 2**64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, factor, np.uint64)]), dtype=np.uint64)


_POWERS = _chain(int(_ODD), LOW)


def powers(places: np.ndarray, first: int = 0) -> np.ndarray:
    """Powers of an odd number, modulo 2**64, for places from ``first`` on; what is kept does not grow with a word."""
    if not first and (not len(places) or int(places.max()) < LOW):
        return _POWERS[places]
    high = _chain(pow(int(_ODD), LOW, 1 << 64), (int(places.max()) >> 12) + 1)
    return _POWERS[places & (LOW - 1)] * high[places >> 12] * np.uint64(pow(int(_ODD), first, 1 << 64))


def _hashed(data: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts that end at ``ends``, and how many words each text has."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = edge[0] = True
    before = np.concatenate([[False], word])
    starts = np.flatnonzero(word & (~before[:-1] | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    stops = np.flatnonzero(word & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    lengths = stops - starts
    first = np.cumsum(lengths) - lengths
    letters = data[word]
    if lower:
        letters = _LOWER[letters]
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(first, lengths)
    value = (letters.astype(np.uint64) + np.uint64(1)) * powers(place)
    return mix(np.add.reduceat(value, first) ^ (lengths.astype(np.uint64) << np.uint64(40))), counts


def word_hashes(texts: pa.Array, lower: bool = False) -> Iterator[np.ndarray]:
    """For each text, in order, a 64-bit hash for each of its words; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        if stop == at + 1 and offsets[stop] - offsets[at] > SLICE:
            yield np.concatenate(list(_long(data[offsets[at] : offsets[stop]], lower)))
        else:
            found, counts = _hashed(data[offsets[at] : offsets[stop]], offsets[at + 1 : stop + 1] - offsets[at], lower)
            yield from np.split(found, np.cumsum(counts)[:-1])
        at = stop


def _long(data: np.ndarray, lower: bool) -> Iterator[np.ndarray]:
    """A long text in parts that end with white space; a word that is longer than a part is added up part by part."""
    at = 0
    while at < len(data):
        stop = min(at + SLICE, len(data))
        spaces = np.flatnonzero(_SPACE[data[at:stop]]) if stop < len(data) else np.array([stop - at - 1])
        if len(spaces):
            stop = at + int(spaces[-1]) + 1
            yield _hashed(data[at:stop], np.array([stop - at]), lower)[0]
            at = stop
            continue
        total, first = np.uint64(0), at
        while at < len(data) and not _SPACE[data[at]]:
            letters = data[at : at + SLICE]
            spaces = np.flatnonzero(_SPACE[letters])
            letters = letters[: spaces[0]] if len(spaces) else letters
            value = (_LOWER[letters] if lower else letters).astype(np.uint64) + np.uint64(1)
            total = np.add(total, (value * powers(np.arange(len(letters)), at - first)).sum(dtype=np.uint64), dtype=np.uint64)
            at += len(letters)
        yield mix(np.array([total ^ np.uint64((at - first) << 40 & 0xFFFFFFFFFFFFFFFF)]))


def windows(words: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(salt)) | np.uint64(1)
    total = words[:n] * factors[0]
    for i in range(1, size):
        total += words[i : i + n] * factors[i]
    return mix(total)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct runs of ``size`` words, sorted; fewer words make one, none make none."""
    if not len(words):
        return words
    return np.unique(windows(words, min(size, len(words)), size if len(words) >= size else 1000 + len(words)))
