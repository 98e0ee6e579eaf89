"""Arrow string columns as flat numpy code-point arrays, and back.

A batch of texts is one array of code points and one array of row offsets. One decode and one
encode call per batch replace all per-row string calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled whole, alone.
SLICE_BYTES = 2 << 20
MAX_CP = 0x110000


def _bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    arr = arr.cast(pa.large_string()) if not pa.types.is_large_string(arr.type) else arr
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def to_codepoints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all rows and the rows' offsets; a null row is empty."""
    raw, offs = _bytes_of(arr)
    try:
        cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # a string that is not UTF-8: its bad bytes become U+FFFD
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])]
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        cps = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        return cps, np.concatenate([[0], np.cumsum(lens)])
    if len(cps) == len(raw):
        return cps, offs
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cps, first[offs]


def utf8_lengths(cps: np.ndarray) -> np.ndarray:
    return 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)


def to_utf8(cps: np.ndarray) -> np.ndarray:
    return np.frombuffer(cps.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8"), np.uint8)


def from_codepoints(cps: np.ndarray, offs: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string array; rows that ``valid`` calls false are null."""
    cps = np.where((cps >= 0xD800) & (cps < 0xE000), 0xFFFD, cps)
    ends = np.concatenate([[0], np.cumsum(utf8_lengths(cps))])[offs].astype(np.int64)
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    out = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(to_utf8(cps).tobytes()), mask)
    return out.cast(pa.string())


def slices(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``most`` bytes; every row is in one range."""
    _, offs = _bytes_of(arr)
    start, n = 0, len(arr)
    while start < n:
        stop = min(n, max(start + 1, int(np.searchsorted(offs, offs[start] + most, "right")) - 1))
        yield start, stop
        start = stop


def ragged_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of the concatenated ranges ``starts[i] .. starts[i]+lens[i]``."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def offsets(lens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, applied element by element."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (int(_M2), _inverse(int(_M2))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            tables.append(np.multiply.accumulate(step))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of segments of a flat array: polynomial prefix sums, one pass whatever the number of segments."""
    n = len(values)
    up, down = _power_table(n + 1)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values.astype(np.uint64) * _M1 + np.uint64(1)) * up[:n], out=pre[1:])
    return mix((pre[ends] - pre[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M1)
