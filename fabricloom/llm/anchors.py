"""Windows of a sequence grouped by their minimizer: runs of windows that share one are 'super k-mers'.

Every window of `size` symbols holds size - grain + 1 grains (short k-mers); its minimizer is the grain with the
least hash, the leftmost of equals. Equal windows have equal minimizers wherever they stand, so two equal windows
always meet at one key, though only every (size - grain) / 2 th position is sent there.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Windows looked at in one go: bounds memory on texts of any length.
SEGMENT = 1 << 17
U = np.uint64
A, B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * B
    return x ^ (x >> U(29))


def grain_hashes(symbols: np.ndarray, grain: int) -> np.ndarray:
    """Hashes of every run of `grain` symbols (a power of two), doubling the run at each step."""
    h, n = symbols, 1
    while n < grain:
        h = mix(h[:-n] * A + h[n:])
        n *= 2
    return h


def byte_symbols(data: np.ndarray) -> np.ndarray:
    """Each run of 8 bytes as one number; data needs 7 bytes more than there are results."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return mix(view * A)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def runs(symbols: np.ndarray, ends: np.ndarray, size: int, grain: int, in_bytes: bool = False, level: int = 0):
    """Yields (first window, last window, minimizer hash) arrays over consecutive texts; ends: where each text ends.

    Windows that cross the end of a text are left out. in_bytes: symbols are bytes and the grain counts bytes.
    Each level orders the grains by another hash.
    """
    total = len(symbols)
    end_of = np.repeat(ends, np.diff(ends, prepend=0))
    width = size - grain + 1
    for begin in range(0, total - size + 1, SEGMENT):
        stop = min(begin + SEGMENT, total - size + 1)
        part = symbols[begin : stop - 1 + size]
        if in_bytes:
            h, n = byte_symbols(part), 8
            while n < grain:
                h = mix(h[:-n] * A + h[n:])
                n *= 2
        else:
            h = grain_hashes(part, grain)
        if level:
            h = mix(h + U(level) * A)
        place = np.arange(len(h), dtype=np.uint64)
        least = sliding_least((h & ~U(0xFFFFF)) | place, width)
        at = (least & U(0xFFFFF)).astype(np.int64)
        window = np.arange(begin, stop)
        valid = window + size <= end_of[begin:stop]
        change = np.empty(len(at), bool)
        change[0] = True
        np.not_equal(at[1:], at[:-1], out=change[1:])
        change[1:] |= ~valid[:-1]
        first = np.flatnonzero(change & valid)
        if not len(first):
            continue
        stop_run = change | ~valid
        nexts = np.append(np.flatnonzero(stop_run), len(at))
        last = nexts[np.searchsorted(nexts, first, side="right")] - 1
        yield first + begin, last + begin, h[at[first]]


def texts_of(column):
    """A string column as one array of bytes and the place where each text ends; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


@lru_cache(8)
def _tables(n: int, seed: int):
    """Random numbers for bytes, and powers of an odd number and of its inverse modulo 2**64."""
    spell = mix(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=np.uint64) * A)
    inverse = pow(int(B), -1, 1 << 64)
    up, down = np.full(n, B), np.full(n, U(inverse))
    up[0] = down[0] = 1
    return spell, np.cumprod(up), np.cumprod(down)


def rolled(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of stretches of bytes, each byte spelled as a random number."""
    n = len(data)
    spell, up, down = _tables(1 << max(16, int(n).bit_length()), seed)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(spell[data] * up[:n], out=total[1:])
    return (total[stops] - total[begins]) * down[begins]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_symbols(data: np.ndarray, ends: np.ndarray):
    """64-bit hashes of all words, where each begins and ends in the bytes, and where each text ends in words."""
    n = len(data)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)  # texts meet without a space between
    edge[ends] = True
    edge[0] = True
    before = np.concatenate([[False], solid[:-1]]) if n else solid
    after = np.concatenate([solid[1:], [False]]) if n else solid
    begins = np.flatnonzero(solid & (~before | edge[:-1]))
    stops = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return mix(rolled(data, begins, stops)), begins, stops, np.searchsorted(begins, ends)


def window_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of every run of `size` symbols."""
    n = len(symbols)
    _, up, down = _tables(1 << max(16, int(n).bit_length()), 0)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=total[1:])
    count = max(0, n - size + 1)
    return mix((total[size : size + count] - total[:count]) * down[:count])
