"""Vectorised hashing of words and word shingles, whole texts at a time.

A word is a run of bytes without ASCII white space in the UTF-8 text after A-Z are lower-cased. Its hash is a sum over a
fixed random table of (place, byte), so that no family of words collides by construction; words over PLACES bytes are
hashed by xxh3. A 64-bit mixer finishes both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
PLACES = 64
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, PLACES * 256, dtype=np.uint64)
_LENGTH = np.uint64(0xD1B54A32D192ED03)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 19
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(v: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    v = v ^ (v >> np.uint64(30))
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def _power_tables(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        size = max(size, _CHUNK + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate(([True], _SPACE[raw], [True]))
    turn = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turn[::2], turn[1::2]
    size = ends - starts
    if not len(size):
        return np.empty(0, np.uint64), starts, ends
    at = np.flatnonzero(~space[1:-1])
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    total = np.add.reduceat(_TABLE[(place & (PLACES - 1)) << 8 | raw[at]], first)
    for i in np.flatnonzero(size > PLACES):
        total[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return mix(total + size.astype(np.uint64) * _LENGTH), starts, ends


def chunks(texts: list[str | None]) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """Indices, lower-cased joined bytes and first bytes of runs of whole texts, about half a megabyte each."""
    members, parts, starts, size = [], [], [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if parts and size + len(data) > _CHUNK:
            yield members, b"\n".join(parts), np.array(starts)
            members, parts, starts, size = [], [], [], 0
        members.append(i)
        parts.append(data)
        starts.append(size)
        size += len(data) + 1
    if parts:
        yield members, b"\n".join(parts), np.array(starts)


def chunk_shingles(texts: list[str | None], width: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: their indices, the bounds of each among the run's words, the hash of every width words, and of each word."""
    weights = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]
    for members, data, starts in chunks(texts):
        words, first, _ = word_hashes(data)
        bounds = np.append(np.searchsorted(first, starts), len(words))
        n = max(0, len(words) - width + 1)
        wide = np.zeros(n, np.uint64)
        for k in range(width):
            wide += words[k : k + n] * weights[k]
        yield members, bounds, mix(wide), words


def shingle_arrays(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text: index, hashes of its shingles in order (its whole sequence if shorter; none without words), and of its words."""
    weights = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]
    for members, bounds, wide, words in chunk_shingles(texts, width):
        for j, i in enumerate(members):
            a, b = bounds[j], bounds[j + 1]
            if b - a >= width:
                yield i, wide[a : b - width + 1], words[a:b]
            elif b > a:
                short = np.array([np.uint64(b - a)])
                for k in range(b - a):
                    short = mix(short + words[a + k : a + k + 1] * weights[k])
                yield i, short, words[a:b]
            else:
                yield i, wide[:0], words[:0]


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))] if len(hashes) else hashes
