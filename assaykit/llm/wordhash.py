"""Vectorised words and word hashes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes that end a word: space and the controls 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and nothing else.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random-looking 64-bit value for each byte, with upper case folded.
BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))[ASCII_LOWER]
_powers: dict[str, np.ndarray] = {"up": np.ones(1, dtype=_U), "down": np.ones(1, dtype=_U)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, PIECE + 4096), base, dtype=_U)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers[name]


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about a megabyte that never split a word."""
    at, end = 0, len(raw)
    while at < end:
        to = min(end, at + PIECE)
        while to < end and not space[raw[to]]:  # a text's end cuts as well
            nearest = offsets[np.searchsorted(offsets, to)]
            gap = np.flatnonzero(space[raw[to : to + 4096]])
            to = min(to + (int(gap[0]) if len(gap) else 4096), int(nearest), end)
            if to == nearest:
                break
        yield at, to
        at = to


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """``hash, first``: a 64-bit hash of every word in order, and each text's first word (one more entry than texts)."""
    (h,), _, first = words_and_prefixes(raw, offsets, space)
    return h, first


def words_and_prefixes(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, lengths: tuple[int, ...] = ()) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes, word numbers, first words: for whole words, then for the first ``n`` bytes of longer words, for each ``n``."""
    hashes: list[list[np.ndarray]] = [[] for _ in range(1 + len(lengths))]
    numbers: list[list[np.ndarray]] = [[] for _ in lengths]
    starts, count = [], 0
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    for a, b in _pieces(raw, offsets, space):
        part = raw[a:b]
        inside = ~space[part]
        before = np.zeros(b - a, dtype=bool)
        before[1:] = inside[:-1]
        before &= ~edge[a:b]
        s = np.flatnonzero(inside & ~before)
        after = np.zeros(b - a, dtype=bool)
        after[:-1] = inside[1:]
        after &= ~edge[a + 1 : b + 1]
        e = np.flatnonzero(inside & ~after) + 1
        up, down = _power("up", _BASE, b - a + 1), _power("down", _INVERSE, b - a + 1)
        prefix = np.zeros(b - a + 1, dtype=_U)
        np.cumsum(BYTE_VALUE[part] * up[: b - a], out=prefix[1:])
        hashes[0].append(mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)))
        for i, n in enumerate(lengths):
            long_ = np.flatnonzero(e - s > n)
            t = s[long_]
            hashes[1 + i].append(mix((prefix[t + n] - prefix[t]) * down[t] + _U((n * 0xFF51AFD7ED558CCD + 0x5851F42D4C957F2D) & _MASK)))
            numbers[i].append(long_ + count)
        starts.append(s + a)
        count += len(s)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    at = join(starts, np.int64)
    return [join(h, _U) for h in hashes], [np.arange(count), *(join(x, np.int64) for x in numbers)], np.searchsorted(at, offsets)


_K = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53), _U(0x27D4EB2F165667C5), _U(0x85EBCA77C2B2AE63)]


def _gram(h: np.ndarray, n: int) -> np.ndarray:
    total = np.full(len(h) - n + 1, (n * 0x2545F4914F6CDD1D) & _MASK, dtype=_U)
    for i in range(n):
        total += mix(h[i : len(h) - n + 1 + i] + _U((int(_K[i % 8]) * (i + 1)) & _MASK)) * _K[(i + 3) % 8]
    return mix(total)


def slices(column: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """Consecutive slices of a string column of about ``most`` bytes, or one text each where texts are longer."""
    _, offsets = string_buffer(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield column.slice(at, to - at)
        at = to


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct ``n``-word shingle hashes; fewer words give one, none give none."""
    for part in slices(column):
        h, first = words(*string_buffer(part))
        grams = _gram(h, n) if len(h) >= n else np.zeros(0, _U)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield _gram(h[a:b], int(b - a))
            else:
                yield h[:0]
