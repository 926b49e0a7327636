"""Truncated SVD of a sparse matrix that is a table, with factors that are tables.

The matrix is ``rid, idx, w`` (row, column, value), the right factor ``idx, v`` with one array
of components per column.  A round of block power iteration multiplies by the matrix and its
transpose: the factor is handed to blocks of rows, each block makes its part of the product,
and the parts are summed by column.  What the driver sees are matrices of components x
components - inner products of the factor's columns - whose size no input changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurlog.session import materialise

#: Most rows and (about) entries of a block; a task holds a block's entries and one array of components per row.
BLOCK_ROWS, BLOCK_ENTRIES = 16_384, 1 << 20
#: Entries are multiplied as a dense matrix if it has at most so many cells an entry.
DENSE_CELLS = 16
#: Most parts of the factor, and columns of one; each gives the driver three matrices of components x components.
PARTS, PART_COLUMNS = 32, 1024
#: Residuals below are measured exactly.
ROUGH = 1e-6
#: Extra components that are iterated along and dropped; they speed up the last wanted ones.
EXTRA_LEAST, EXTRA_MOST = 10, 64

_FACTOR = "idx bigint, v array<double>"


@dataclass
class Svd:
    """``factor``: idx, v (orthonormal columns, strongest first); singular values; and for each
    the norm of ``A'A v - s^2 v`` relative to the largest ``s^2``."""

    factor: DataFrame
    values: list[float]
    residuals: list[float]


def _arrays(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _listed(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(values.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(rows[order], first, axis=0)


def _products(keys: np.ndarray, at: np.ndarray, w: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and for each the sum of ``w * vectors[at]`` over its entries."""
    rows, i = np.unique(keys, return_inverse=True)
    columns, j = np.unique(at, return_inverse=True)
    if len(rows) * len(columns) > DENSE_CELLS * len(w):
        return _summed(keys, w[:, None] * vectors[at])
    cells = np.bincount(i * len(columns) + j, weights=w, minlength=len(rows) * len(columns))
    return rows, cells.reshape(len(rows), len(columns)) @ vectors[columns]


def in_blocks(entries: DataFrame, n_rows: int) -> DataFrame:
    """The entries, written, with the block of their row."""
    entries = materialise(entries.select("rid", F.col("idx").cast("bigint").alias("idx"), "w"), "svd-entries")
    blocks = max(1, -(-n_rows // BLOCK_ROWS), min(n_rows, -(-entries.count() // BLOCK_ENTRIES)))
    return entries.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("block"), "rid", "idx", "w")


def _handed(entries: DataFrame, factor: DataFrame) -> DataFrame:
    """Per block, in order of idx: the factor's row, then the entries of that column."""
    used = entries.select("block", "idx").distinct().join(factor, "idx")
    no_row, no_array = F.lit(None).cast("bigint"), F.lit(None).cast("array<double>")
    rows = used.select("block", "idx", F.lit(0).alias("kind"), no_row.alias("rid"), F.lit(0.0).alias("w"), "v")
    rows = rows.unionByName(entries.select("block", "idx", F.lit(1).alias("kind"), F.col("rid").cast("bigint").alias("rid"), "w", no_array.alias("v")))
    # a task each: by size, a few tasks would get them all
    tasks = (entries.agg(F.max("block")).first()[0] or 0) + 1
    return rows.repartitionById(tasks, F.col("block").cast("int")).sortWithinPartitions("block", "idx", "kind").select("block", "idx", "kind", "rid", "w", "v")


def _block_products(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """For each block its row ids, their products with the factor, and the entries."""
    block, last, held, done = None, None, {}, []
    for batch in batches:
        blocks = np.asarray(batch.column(0))
        for b in np.unique(blocks):
            lo, hi = np.searchsorted(blocks, b), np.searchsorted(blocks, b, "right")
            part = batch.slice(lo, hi - lo)
            if b != block:
                if block is not None:
                    yield _closed(held, width, done)
                block, last, held, done = b, None, {}, []
            idx, kind = np.asarray(part.column(1)), np.asarray(part.column(2))
            is_entry = kind == 1
            vectors = _arrays(part.column(5).filter(pa.array(~is_entry)), width)
            columns = idx[~is_entry]
            if last is not None:  # entries whose column's vector came with the batch before
                columns, vectors = np.r_[last[0], columns], np.concatenate([last[1][None], vectors])
            if len(columns):
                last = (columns[-1], vectors[-1].copy())
            rid, w, at = np.asarray(part.column(3).filter(pa.array(is_entry)), np.int64), np.asarray(part.column(4))[is_entry], idx[is_entry]
            if len(rid):
                keys, sums = _products(rid, np.searchsorted(columns, at), w, vectors)
                for i, k in enumerate(keys.tolist()):
                    if k in held:
                        held[k] += sums[i]
                    else:
                        held[k] = sums[i].copy()
                done.append((rid, w, at))
    if block is not None:
        yield _closed(held, width, done)


def _closed(held: dict, width: int, done: list) -> tuple[np.ndarray, np.ndarray, list]:
    rids = np.array(sorted(held), np.int64)
    return rids, np.array([held[r] for r in rids.tolist()]).reshape(-1, width), done


def product(entries: DataFrame, factor: DataFrame, width: int) -> DataFrame:
    """``rid, y``: the matrix times the factor, for rows with entries.  ``entries`` come from ``in_blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rids, y, _ in _block_products(batches, width):
            for at in range(0, len(rids), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(rids[at : at + 4096]), _listed(y[at : at + 4096])], names=["rid", "y"])

    return _handed(entries, factor).mapInArrow(run, "rid bigint, y array<double>")


def gram_product(entries: DataFrame, factor: DataFrame, width: int, parts_of_factor: int = 8) -> DataFrame:
    """``idx, v``: the transposed matrix times the matrix times the factor, written."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rids, y, done in _block_products(batches, width):
            for rid, w, at in done:
                keys, sums = _products(at, np.searchsorted(rids, rid), w, y)
                yield pa.RecordBatch.from_arrays([pa.array(keys), _listed(sums)], names=["idx", "v"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            keys, rows = np.asarray(batch.column(0)), _arrays(batch.column(1), width)
            if carry is not None:
                keys, rows = np.r_[carry[0], keys], np.concatenate([carry[1][None], rows])
            keys, rows = _summed(keys, rows)
            carry = (keys[-1], rows[-1].copy())
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), _listed(rows[:-1])], names=["idx", "v"])
        if carry is not None:
            yield pa.RecordBatch.from_arrays([pa.array([carry[0]]), _listed(carry[1][None])], names=["idx", "v"])

    by_column = _handed(entries, factor).mapInArrow(parts, _FACTOR).repartition(parts_of_factor, "idx").sortWithinPartitions("idx")
    return materialise(by_column.mapInArrow(sums, _FACTOR), "svd-product")


def _inner(table: DataFrame, width: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over a table's batches of a matrix with ``width`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = of(batch) if total is None else total + of(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([_listed(total.reshape(1, -1))], names=["m"])

    rows = table.mapInArrow(run, "m array<double>").collect()
    return np.sum([np.array(r.m).reshape(-1, width) for r in rows], axis=0) if rows else np.zeros((width, width))


def _times(factor: DataFrame, matrix: np.ndarray, name: str) -> DataFrame:
    """The factor times a small matrix, written."""
    width = matrix.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed(_arrays(batch.column(1), width) @ matrix)], names=["idx", "v"])

    return materialise(factor.select("idx", "v").mapInArrow(run, _FACTOR), name)


def inner_products(factor: DataFrame, width: int) -> np.ndarray:
    """Inner products of all pairs of the factor's columns."""
    return _inner(factor.select("v"), width, lambda b: (lambda x: x.T @ x)(_arrays(b.column(0), width)))


def _whitening(gram: np.ndarray) -> np.ndarray:
    """Turns columns with these inner products into an orthonormal basis of their span."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(values.max(), 0) * 1e-13
    return vectors[:, keep] / np.sqrt(values[keep])


def truncated_svd(entries: DataFrame, columns: DataFrame, n_rows: int, k: int, max_rounds: int = 30, tolerance: float = 1e-10, seed: int = 7) -> Svd:
    """The ``k`` strongest right singular vectors of ``entries`` (rid, idx, w), or as many as there are.

    ``columns`` has every ``idx``.  Rounds end when every wanted residual is below
    ``tolerance`` or after ``max_rounds``; the residuals tell how far they came.
    """
    blocks = in_blocks(entries, n_rows)
    width = k + max(EXTRA_LEAST, min(k, EXTRA_MOST))
    parts = max(1, min(PARTS, -(-columns.count() // PART_COLUMNS)))
    start = columns.select(F.col("idx").cast("bigint").alias("idx")).repartition(parts, "idx")
    noise = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.pmod(F.xxhash64(F.col("idx"), i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1.0)
    basis = materialise(start.select("idx", noise.alias("v")), "svd-start")
    values, residuals, turn = np.zeros(0), np.zeros(0), np.zeros((width, 0))
    for round_no in range(max_rounds):
        image = gram_product(blocks, basis, width, parts)
        pairs = basis.select("idx", F.col("v").alias("a")).join(image.select("idx", F.col("v").alias("b")), "idx", "left").select("a", F.coalesce("b", F.array_repeat(F.lit(0.0), width)).alias("b"))

        def products(batch: pa.RecordBatch) -> np.ndarray:
            a, b = _arrays(batch.column(0), width), _arrays(batch.column(1), width)
            return np.concatenate([a.T @ a, a.T @ b, b.T @ b])

        own, mixed, of_image = np.split(_inner(pairs, width, products), 3) if not pairs.isEmpty() else [np.zeros((width, width))] * 3
        # Ritz values and vectors; the basis need not be exactly orthonormal for them
        white = _whitening(own)
        values, turn = np.linalg.eigh(white.T @ (mixed + mixed.T) @ white / 2)
        order = np.argsort(-values)
        values, turn = np.maximum(values[order], 0), white @ turn[:, order]
        largest = max(values.max(initial=0), 1e-300)
        residuals = np.sqrt(np.maximum(((turn.T @ of_image) * turn.T).sum(1) - values * values, 0)) / largest
        last = round_no == max_rounds - 1
        if last or (residuals[:k] <= max(tolerance, ROUGH)).all():
            # the difference above is exact to about half the digits only

            def distance(batch: pa.RecordBatch) -> np.ndarray:
                gap = _arrays(batch.column(1), width) @ turn - (_arrays(batch.column(0), width) @ turn) * values
                return (gap * gap).sum(0)[None]

            residuals = np.sqrt(_inner(pairs, len(values), distance)[0]) / largest
            if last or (residuals[:k] <= tolerance).all():
                break
        following = _whitening(of_image)
        basis, width = _times(image, following, "svd-basis"), following.shape[1]
        if not width:
            break
    real = min(k, int((values > largest * 1e-12).sum())) if len(values) and values[0] > 0 else 0
    factor = _times(basis, turn[:, :real], "svd-factor")
    return Svd(factor, np.sqrt(values[:real]).tolist(), residuals[:real].tolist())
