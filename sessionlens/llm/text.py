"""Vectorised text primitives over Arrow string columns.

Every function works on the UTF-8 buffer of a whole Arrow column: no Python
string is made per row.  Chunks are cut at row borders near a byte bound, so
memory follows the bound (or one longest text), not the batch.
"""

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix64(h):
    """Finaliser of a 64-bit hash: spreads every input bit over the word."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def utf8_chunks(column, max_bytes=1 << 20):
    """Yield (first row, bytes as uint8, row offsets) over a string column.

    Nulls count as empty.  `offsets` has one entry more than rows and starts at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.string()), np.int32
    rows = len(column)
    if not rows:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, kind)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(rows, max(hi, lo + 1))
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _powers(n, base):
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def span_hashes(buf, starts, ends):
    """64-bit hashes of buf[starts[i]:ends[i]]; equal bytes give equal hashes."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + U64(1)) * _powers(n, _BASE), out=sums[1:])
    back = _powers(n + 1, _INVERSE)
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * U64(0x632BE59BD9B4E019))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf, offsets):
    """Starts, ends and row of every maximal run of non-space bytes; no run crosses a row."""
    space = SPACE[buf]
    first, last = np.ones(len(buf), bool), np.ones(len(buf), bool)
    first[1:] = space[:-1]
    last[:-1] = space[1:]
    filled = offsets[:-1] < offsets[1:]
    first[offsets[:-1][filled]] = True
    last[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(first & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), counts), counts


def ngram_hashes(hashes, rows, n, skip=0, seed=0):
    """Hashes of n consecutive items of one row (`skip`: items left out between each two), and their rows."""
    reach = (n - 1) * (skip + 1)
    m = len(hashes) - reach
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(m, (seed * 0x2545F4914F6CDD1D + n * 31 + skip) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(n):
        at = k * (skip + 1)
        out = out * U64(0x9FB21C651E98DF25) + hashes[at : at + m]
    same = rows[:m] == rows[reach : reach + m]
    return mix64(out)[same], rows[:m][same]


def row_sums(values, rows, n):
    """Sum of values per row number, 0 to n - 1."""
    return np.bincount(rows, weights=values, minlength=n)[:n]
