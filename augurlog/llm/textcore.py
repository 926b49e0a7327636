"""Array-at-a-time work on text columns: Arrow batches in, numpy over their bytes.

Spark partitions the rows; the helpers here turn the UTF-8 bytes of one Arrow batch into word
positions and 64-bit hashes without a Python loop over words.  Memory is bounded by ``PIECE``
bytes of text (or one document, if longer).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text handled at once; about 40 bytes of arrays stand for each.
PIECE = 1 << 19

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_ODD_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def seeds(n: int, start: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(n, dtype=U64) + U64(start)) * _ODD + U64(1))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over byte values, True within the given inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
LETTER_OR_DIGIT = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

#: A value per byte; capital and small ASCII letters share one.
FOLDED = seeds(256, 1000)
FOLDED[0x41:0x5B] = FOLDED[0x61:0x7B]
EXACT = seeds(256, 1000)

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        up, down = np.full(size, _ODD), np.full(size, _ODD_INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)]
    return _powers[0], _powers[1]


def pieces(column: pa.Array, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end row, their bytes, row bounds in these.

    A null counts as an empty text.
    """
    limit = limit or PIECE
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def runs(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the longest runs of bytes in ``inside`` that stay within a row."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    member = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    n = len(data)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(values[data] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) in order, and the row bounds among the words."""
    starts, ends, row = runs(data, bounds, inside)
    counts = np.bincount(row, minlength=len(bounds) - 1)
    return span_hashes(data, starts, ends), np.concatenate([[0], np.cumsum(counts)])


def with_columns(docs: DataFrame, text: str, compute: Callable, fields: list[tuple[str, T.DataType]], keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the columns that ``compute`` makes of the text column, batch-wise.

    ``compute(text column) -> list of arrays``, one per field, one value per row.  No row is
    dropped and none is moved, so no shuffle is needed.
    """
    read = list(dict.fromkeys([*keep, text]))
    at, names = read.index(text), [*keep, *(name for name, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in compute(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *extra], names=names)

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in fields)])
    return docs.select(*[f"`{c}`" for c in read]).mapInArrow(run, schema)


def unused(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column has it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
