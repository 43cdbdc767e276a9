"""Words and shingles of Arrow text columns as 64-bit hashes, computed on whole buffers with numpy.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased; no Python object is made per word.
Work arrays are bounded by ``BLOCK`` bytes of text whatever the length of a document; what stays is 8 bytes a word.
"""

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_BASE = 0x9E6C63D0876A9A47


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers (two multiply-xorshift rounds)."""
    x = x ^ U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += U(32)
_BYTE = mix(_LOWER, 77)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(pow(_BASE, -1, 2**64), BLOCK + 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _block_words(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of a block; ``cuts`` are positions where a new row begins."""
    solid = ~_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(raw) <= BLOCK:
        up, down = _UP, _DOWN
    else:  # one word longer than a block
        up, down = _powers(_BASE, len(raw) + 1), _powers(pow(_BASE, -1, 2**64), len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + mix((ends - starts).astype(np.uint64), 5)), starts


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of a text column in order, and the n + 1 offsets of its rows into them."""
    raw, at = buffers(column)
    hashes, places, low = [], [], 0
    while low < len(raw):
        high = min(low + BLOCK, len(raw))
        if high < len(raw):  # end a block behind a space or at the end of a row, never within a word
            space = np.flatnonzero(_SPACE[raw[low:high]])
            cut = at[np.searchsorted(at, high, "right") - 1]
            end = max(low + space[-1] + 1 if len(space) else low, cut)
            while end <= low:  # a word longer than a block
                more = np.flatnonzero(_SPACE[raw[high:high + BLOCK]])
                row_end = at[np.searchsorted(at, low, "right")]
                end = min(high + more[0] + 1 if len(more) else (high + BLOCK if high + BLOCK < len(raw) else len(raw)), row_end)
                if not len(more) and end < min(row_end, len(raw)):
                    high, end = high + BLOCK, low
            high = end
        found, where = _block_words(raw[low:high], at[np.searchsorted(at, low):np.searchsorted(at, high, "right")] - low)
        hashes.append(found)
        places.append(where + low)
        low = high
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), at).astype(np.int64)


def runs(hashes: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, 1 to k, that begin at ``start``."""
    total, least = mix(size.astype(np.uint64), 11), int(size.min()) if len(size) else k
    for j in range(k):
        if j < least:
            total = (total ^ hashes[start + j]) * U(0xC2B2AE3D27D4EB4F) + U(j + 1)
        else:
            inside = j < size
            total = np.where(inside, (total ^ hashes[np.where(inside, start + j, 0)]) * U(0xC2B2AE3D27D4EB4F) + U(j + 1), total)
        total ^= total >> U(29)
    return mix(total, 3)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each row, in order; a row of 1 to k - 1 words has one, its whole sequence."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.zeros(len(at), dtype=np.int64)
    np.cumsum(count, out=out_at[1:])
    start = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - at[:-1], count)
    return runs(hashes, start, np.repeat(np.minimum(n, k), count), k), out_at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    parts = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    out_at = np.zeros(len(at), dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=out_at[1:])
    return (np.concatenate(parts) if parts else values[:0]), out_at


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each row's values, 0 for an empty row."""
    sums = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 * BLOCK):
    """Runs of rows with at most ``limit`` bytes in a text column; a longer text comes alone."""
    index = batch.schema.get_field_index(column)
    _, at = buffers(batch.column(index))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def long_lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), longs(values))


def blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Each row's values as one binary value."""
    raw = np.ascontiguousarray(values)
    places = pa.py_buffer((at * raw.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, places, pa.py_buffer(raw.tobytes())])
