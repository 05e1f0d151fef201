"""Words of UTF-8 texts and their 64-bit hashes, worked out over whole byte arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

# bytes that are hashed at once, and the longest word that the array formula hashes
PIECE, SHORT = 1 << 16, 64
# bytes of texts that are hashed together
HELD_BYTES = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1), modulo 2^64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


# a value for every byte, and an odd base whose neighbours hold few factors of two, so that exchanged letters don't cancel out
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_UP = _powers(_BASE, PIECE + SHORT)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), PIECE)


def places(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word (run of bytes other than the six ASCII spaces)."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def hashes_at(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word.

    A word's bytes b stand for sum(value[b] * base^i), i from its start; sums of
    all words come from one running sum. Such sums could be made to agree by
    long words of a special build, so long words are hashed one by one.
    """
    out = np.empty(len(starts), np.uint64)
    data = np.frombuffer(raw, np.uint8)
    first = 0
    while first < len(starts):
        at = int(starts[first])
        last = int(np.searchsorted(starts, at + PIECE, "left"))
        a, b = starts[first:last] - at, np.minimum(ends[first:last] - at, PIECE + SHORT)
        part = data[at : at + int(b[-1])]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * _UP[: len(part)], out=total[1:])
        out[first:last] = (total[b] - total[a]) * _DOWN[a] + (ends[first:last] - starts[first:last]).astype(np.uint64)
        first = last
    out = mix(out)
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return out


def word_hashes(raw: bytes | None) -> np.ndarray:
    starts, ends = places(raw)
    return hashes_at(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)


def hashed_rows(rows: Iterable[tuple], at: int, lower: bool = False) -> Iterator[tuple]:
    """(row, starts, ends, hashes) for every row, whose text in UTF-8 is its column `at`; `lower` lowers A-Z first.

    Short texts are worked out together, some HELD_BYTES at a time.
    """
    held: list[tuple] = []
    size = 0

    def done() -> Iterator[tuple]:
        texts = [r[at] or b"" for r in held]
        raw = b" ".join(texts)
        raw = raw.lower() if lower else raw
        starts, ends = places(raw)
        hashes = hashes_at(raw, starts, ends)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        cut = np.searchsorted(starts, begin).tolist()
        for row, off, a, b in zip(held, begin.tolist(), cut, cut[1:]):
            yield row, starts[a:b] - off, ends[a:b] - off, hashes[a:b]

    for row in rows:
        held.append(row)
        size += len(row[at] or b"")
        if size >= HELD_BYTES:
            yield from done()
            held, size = [], 0
    if held:
        yield from done()
