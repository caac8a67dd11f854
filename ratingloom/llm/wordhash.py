"""Words of whole batches of texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from ratingloom.llm.tables import mix

PIECE = 1 << 21  # bytes hashed at a time
BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])


class SpanHasher:
    """Hashes of byte spans from prefix sums, so the cost does not depend on the number of spans."""

    def __init__(self) -> None:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        self.power, self.inverse = _powers(BASE, PIECE), _powers(inverse, PIECE)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of bytes."""
        return self.of_values(_VALUE[data], starts, ends)

    def of_values(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of 64-bit values."""
        if len(data) > len(self.power):
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.power, self.inverse = _powers(BASE, len(data)), _powers(inverse, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.power[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _VALUE[7])


def cuts(data: np.ndarray, bounds: np.ndarray, size: int = PIECE) -> list[int]:
    """Offsets that cut ``data`` into pieces of about ``size`` bytes, at spaces or between rows."""
    found, at = [0], 0
    while len(data) - at > size:
        row = int(bounds[np.searchsorted(bounds, at + size, "right") - 1])
        if row <= at:
            spaces = np.flatnonzero(_SPACE[data[at + size // 2 : at + size]])
            row = at + size // 2 + int(spaces[-1]) if len(spaces) else 0
            if not row:
                later, end = at + size, int(bounds[np.searchsorted(bounds, at + size, "left")])
                while later < end and not _SPACE[data[later]]:
                    later += 1
                row = later
        at = row
        found.append(at)
    return [*found, len(data)] if found[-1] < len(data) else found


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False, hasher: SpanHasher | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of anything but space and 9-13) of all rows: hashes, starts, ends, and each row's first word."""
    hasher = hasher or SpanHasher()
    hashes, starts, ends = [], [], []
    edges = cuts(data, bounds)
    for a, b in zip(edges, edges[1:], strict=False):
        part = data[a:b]
        plain = ~_SPACE[part]
        inner = bounds[np.searchsorted(bounds, a, "left") : np.searchsorted(bounds, b, "left")] - a
        begins = plain.copy()
        begins[1:] &= ~plain[:-1]
        begins[inner] = plain[inner]
        finish = plain.copy()
        finish[:-1] &= ~plain[1:]
        inner = inner[inner > 0]
        finish[inner - 1] = plain[inner - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(finish) + 1
        hashes.append(hasher(_LOWER[part] if lower else part, s, e))
        starts.append(s + a)
        ends.append(e + a)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(bounds), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, bounds)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words at every position that has them, across rows as well."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - k + 1].copy()
    for n in range(1, k):
        out = mix(out) * BASE + hashes[n : len(hashes) - k + 1 + n]
    return mix(out)


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the positions that ``grams`` hashes lie within one row."""
    ok = np.zeros(max(total - k + 1, 0) + 1, np.int32)
    lengths = np.diff(first)
    full = lengths >= k
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, (first[1:] - k + 1)[full], -1)
    return np.cumsum(ok[:-1]) > 0
