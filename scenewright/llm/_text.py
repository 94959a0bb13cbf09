"""Vectorised text kernels shared by the operators: words, word hashes and shingles of a whole Arrow batch.

Everything works on the UTF-8 bytes of a string column without making Python strings.  Texts are taken whole;
long columns are walked in segments that end at a word's end, so the working memory is bounded by the segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; about 40 bytes of working memory for each.
SEGMENT = 1 << 20

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
for _c in range(26):
    _BYTE[65 + _c] = _BYTE[97 + _c]
_R = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        m = max(n, 256)
        _POW = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, _R, np.uint64), dtype=np.uint64)])
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def doc_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows with at most `limit` bytes each, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def spans(buf: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = _ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't `is_space`; no run crosses a row."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~is_space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word
    stop = end.copy()
    stop[:-1] &= ~end[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of the byte runs, a polynomial over random byte values, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(length[:-1], out=first[1:])
    rel = np.arange(first[-1] + length[-1], dtype=np.int64)
    rel -= np.repeat(first, length)
    at = np.repeat(starts, length)
    at += rel
    value = table[buf[at]]
    value *= _powers(int(length.max()))[rel]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64))


#: Bytes that belong to no word of `ALNUM` words: letters, digits and everything beyond ASCII do.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(buf: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = _ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (by default `[^\\x20\\x09-\\x0D]+`) with A-Z lower-cased, and the n + 1 offsets of each row's words."""
    starts, ends = spans(buf, offsets, is_space)
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SEGMENT, "right")))
        out[a:b] = hash_runs(buf, starts[a:b], ends[a:b])
        a = b
    return out, np.searchsorted(starts, offsets, "left")


_SHINGLE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(words: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and the n + 1 offsets.

    A row with fewer than `width` words has one shingle, the whole sequence; a row without words has none."""
    n = len(offsets) - 1
    count = np.diff(offsets)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(n), made)
    at = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made) + offsets[:-1][row]
    value = np.full(len(row), width, np.uint64)
    short = count[row] < width
    if short.any():
        value[short] = count[row][short].astype(np.uint64)
    last = max(len(words) - 1, 0)
    for k in range(width):
        part = words[np.minimum(at + k, last)] if len(words) else np.zeros(len(at), np.uint64)
        part = part * _SHINGLE[k % 5] + np.uint64(k)
        if short.any():
            part[short & (count[row] <= k)] = 0
        value = value * np.uint64(0x9E3779B97F4A7C15) + part
    value = mix(value)
    return distinct_rows(value, row, n)


def distinct_rows(value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted within it; `row` is ascending."""
    if not len(value):
        return value, np.zeros(n + 1, np.int64)
    bounds = np.searchsorted(row, np.arange(n + 1))
    out = value.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[keep], np.searchsorted(row[keep], np.arange(n + 1))


def ngram_counts(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, width: int, dims: int, skip: int | None = None) -> np.ndarray:
    """How often each row has each hashed n-gram of the bytes' classes, as an array (rows, dims) of float32.

    `table` gives each byte's class.  N-grams with two classes `skip` in a row don't count; none crosses a row."""
    n = len(offsets) - 1
    out = np.zeros(n * dims, np.float32)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    row, a = 0, 0
    size = int(offsets[-1])
    while a + width <= size:
        b = min(size, a + SEGMENT + width - 1)
        cls = table[buf[a:b]]
        m = len(cls) - width + 1
        code = cls[:m].astype(np.uint32)
        for k in range(1, width):
            code *= np.uint32(0x01000193)
            code ^= cls[k : k + m]
        code *= np.uint32(0x9E3779B1)
        code >>= shift
        good = np.ones(m, bool)
        if skip is not None:
            blank = cls == skip
            for k in range(width - 1):
                good &= ~(blank[k : k + m] & blank[k + 1 : k + 1 + m])
        last = int(np.searchsorted(offsets, b, "left"))
        inner = offsets[row : last + 1]
        for k in range(1, width):
            gone = inner - k - a
            good[gone[(gone >= 0) & (gone < m)]] = False
        length = np.diff(np.clip(inner, a, a + m))
        key = np.repeat(np.arange(row, row + len(length), dtype=np.int64) * dims, length) + code
        base = row * dims
        part = np.bincount(key[good] - base, minlength=0)
        out[base : base + len(part)] += part
        a += m
        row = max(int(np.searchsorted(offsets, a, "right")) - 1, 0)
    return out.reshape(n, dims)


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with so many underscores before it that no column is named like it in any case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
