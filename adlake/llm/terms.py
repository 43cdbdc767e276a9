"""Terms of Arrow text columns: runs of ASCII digits and letters (A-Z lower-cased) and of all non-ASCII signs.

Works on whole buffers with numpy; no Python object is made per term. Callers cut batches into slices of bounded
bytes (``words.slices``), so that the work arrays are bounded by the slice, or by one text that is longer.
"""

import zlib

import numpy as np
import pyarrow as pa

from adlake.llm.words import buffers, mix

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_SIGN = mix(np.arange(256, dtype=np.uint64), 41)
_BASE = 0xB5297A4D3F84D5B5


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes of a text column, the starts and ends of its terms, and the n + 1 offsets of rows into them."""
    raw, at = buffers(column)
    inside = _LETTER[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < len(raw))]  # a term ends with its row
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _FOLDED[raw], starts, ends, np.searchsorted(starts, at).astype(np.int64)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of terms: polynomials in an odd base, taken from running sums."""
    powers = np.full((2, len(raw) + 1), _BASE, dtype=np.uint64)
    powers[1] = pow(_BASE, -1, 2**64)
    powers[:, 0] = 1
    up, down = np.multiply.accumulate(powers, axis=1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_SIGN[raw] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + mix((ends - starts).astype(np.uint64), 7), 9)


# --- CRC-32 of terms and of neighbours joined by a space -----------------------

_LONG = 64  # longer terms are rare and take zlib's own function


def _step_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, np.uint32(0xEDB88320) ^ (value >> np.uint32(1)), value >> np.uint32(1))
    return value


_STEP = _step_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: the register after n zero bytes, if byte k of it was b and the others 0."""
    out = np.empty((_LONG + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_LONG):
        out[n + 1] = _STEP[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


_SHIFT = _shift_tables()
_ONES = np.uint32(0xFFFFFFFF)


def _shifted(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = _SHIFT[n, 0, register & 255]
    for k in (1, 2, 3):
        out = out ^ _SHIFT[n, k, (register >> np.uint32(8 * k)) & 255]
    return out


def crc_of_terms(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned CRC-32 of each term, and of each term and the next one with a space between (last: meaningless)."""
    size = ends - starts
    long = size > _LONG
    length = np.where(long, 0, size)
    order = np.argsort(-length, kind="stable")
    place, ordered = starts[order], length[order]
    plain = np.zeros(len(starts), dtype=np.uint32)  # registers that began with 0
    for j in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-ordered, -j, "left"))  # terms longer than j
        plain[:n] = _STEP[(plain[:n] ^ raw[place[:n] + j]) & 255] ^ (plain[:n] >> np.uint32(8))
    own = np.empty_like(plain)
    own[order] = plain
    register = own ^ _shifted(np.full(len(starts), _ONES), length)
    for i in np.flatnonzero(long):
        register[i] = np.uint32(zlib.crc32(raw[starts[i]:ends[i]].tobytes())) ^ _ONES
    spaced = _STEP[(register ^ np.uint32(32)) & 255] ^ (register >> np.uint32(8))
    pair = np.zeros_like(register)
    pair[:-1] = _shifted(spaced[:-1], length[1:]) ^ own[1:] ^ _ONES
    for i in np.flatnonzero(long[1:]):
        pair[i] = zlib.crc32(raw[starts[i + 1]:ends[i + 1]].tobytes(), int(spaced[i] ^ _ONES))
    return register ^ _ONES, pair


def runs_of(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each row with their counts, and the n + 1 offsets of rows into them."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(begin, len(values)))
    return values[begin], counts, np.searchsorted(row[begin], np.arange(len(at))).astype(np.int64)

