"""Word shingle sets of texts as sorted 64-bit hashes, computed on whole blocks of text at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

LONG_WORD = 1 << 14
BLOCK = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(LONG_WORD, 0x9E3779B97F4A7C15, np.uint64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a buffer, A-Z in lower case."""
    raw = np.frombuffer(data.lower(), np.uint8)
    solid = ~_WHITE[raw]
    edge = np.diff(solid.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    values = _BYTE[raw[solid]] * _POWER[place % LONG_WORD]
    h = _mixed(np.add.reduceat(values, first) ^ size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].lower())
    return starts, h


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(h) - width + 1
    s = np.full(max(n, 0), width, np.uint64)
    for i in range(width if n > 0 else 0):
        s = _mixed(s * np.uint64(3) + h[i : i + n])
    return s


def _sets(h: np.ndarray, ends: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sets of texts whose words end at ``ends``; runs across two texts are passed over."""
    runs, at = _runs(h, width), 0
    for end in ends.tolist():
        k = end - at
        if k >= width:
            yield np.unique(runs[at : end - width + 1])
        else:
            yield _runs(h[at:end], k) if k else h[:0]
        at = end


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each text, ascending; a shorter text is one shingle, one without words none."""

    def flush(held: list[bytes]) -> Iterator[np.ndarray]:
        starts, h = _hash_words(b" ".join(held))
        yield from _sets(h, np.searchsorted(starts, np.cumsum([len(b) + 1 for b in held])), width)

    held, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if size + len(data) > BLOCK and held:
            yield from flush(held)
            held, size = [], 0
        if len(data) > BLOCK:
            parts, at = [], 0
            while at < len(data):
                stop = min(len(data), at + BLOCK)
                while stop < len(data) and not _WHITE[data[stop]]:
                    stop += 1
                parts.append(_hash_words(data[at:stop])[1])
                at = stop
            h = np.concatenate(parts)
            yield from _sets(h, np.array([len(h)]), width)
        else:
            held.append(data)
            size += len(data)
    if held:
        yield from flush(held)
