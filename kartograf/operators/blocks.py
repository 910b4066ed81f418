"""Moving windows over blocks of consecutive rows, at a cost that does not grow with the window.

Rows come laid out by ``ordering.framed``: blocks with the few rows around them that windows reach.  A partition's blocks
are read in order, several at a time; columns that a window does not need stay Arrow and are never converted.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DataType, StructField, StructType

#: Given a table of whole blocks and the number of each row's block, new columns in order.
Work = Callable[[pa.Table, np.ndarray], list[pa.Array]]


def over_blocks(laid: DataFrame, group: list[str], order: str, home: Column, work: Work, new: list[tuple[str, DataType]]) -> DataFrame:
    """``laid`` with the new columns, home copies only."""
    rows = laid.withColumn("_home", home).repartition(*group).sortWithinPartitions(*group, order)
    schema = StructType([*rows.schema.fields, *[StructField(name, kind) for name, kind in new]])

    def numbers(table: pa.Table) -> np.ndarray:
        begins = np.zeros(table.num_rows, dtype=bool)
        for name in group:
            column = table.column(name).combine_chunks()
            a, b = column.slice(0, len(column) - 1), column.slice(1)
            begins[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            if column.null_count:
                begins[1:] |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        return np.cumsum(begins)

    def done(table: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = work(table, block)
        for name, column in zip(schema.names[-len(columns):], columns):
            table = table.append_column(name, column)
        yield from table.filter(table.column("_home")).combine_chunks().to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held < 50_000:
                continue
            table = pa.Table.from_batches(held)
            block = numbers(table)
            whole = int(np.searchsorted(block, block[-1]))  # the last block may go on
            if whole:
                yield from done(table.slice(0, whole), block[:whole])
            held = table.slice(whole).to_batches()
            rows_held = table.num_rows - whole
        if rows_held:
            table = pa.Table.from_batches(held)
            yield from done(table, numbers(table))

    return rows.mapInArrow(run, schema).drop("_home")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column; NaN where a list or a value is missing."""
    column = column.combine_chunks()
    full = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    out = np.full((len(column), width), np.nan)
    out[full.to_numpy(zero_copy_only=False)] = column.filter(full).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return out


def lists(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    """A list column of matrix rows; NaN and missing rows become NULL."""
    n, width = values.shape
    flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat, mask=pa.array(missing))


def spaced(block: np.ndarray, gap: int) -> np.ndarray:
    """Places of the rows in an array where ``gap`` empty rows stand before each block."""
    return np.arange(len(block)) + (block + 1) * gap


def decayed(x: np.ndarray, length: int, ratio: float = 1.0) -> np.ndarray:
    """For each row i the sum of ``ratio**j * x[i + j]`` over 0 <= j < length; rows past the end are zero.

    The array is cut every ``length`` rows.  A window is the end of one piece and the beginning of the
    next, so two running sums give all windows, each with the rounding of its own terms only.
    """
    n, pieces = len(x), -(-len(x) // length) + 1
    cut = np.zeros((pieces * length, x.shape[1]))
    cut[:n] = x
    cut = cut.reshape(pieces, length, x.shape[1])
    ends, begins = cut.copy(), cut.copy()
    for k in range(length - 2, -1, -1):
        ends[:, k] += ratio * ends[:, k + 1]
    power = 1.0
    for k in range(1, length):
        power *= ratio
        begins[:, k] = begins[:, k - 1] + power * cut[:, k]
    out = ends
    for k in range(1, length):
        out[:-1, k] += ratio ** (length - k) * begins[1:, k - 1]
    return out.reshape(-1, x.shape[1])[:n]


class Windows:
    """Sums over the windows of rows ``before`` to ``after`` of each row of its block."""

    def __init__(self, block: np.ndarray, reach: int):
        self.place = spaced(block, reach)
        self.rows = (int(self.place[-1]) if len(block) else 0) + reach + 1

    def total(self, x: np.ndarray, before: int, after: int, ratio: float = 1.0) -> np.ndarray:
        """The oldest row weighs 1, each later one ``ratio`` times the one before."""
        wide = np.zeros((self.rows, x.shape[1]))
        wide[self.place] = x
        return decayed(wide, before + after + 1, ratio)[self.place - before]

    def centred(self, x: np.ndarray, half: int, ratio: float) -> np.ndarray:
        """The row itself weighs 1, others ``ratio`` to the number of rows they are away."""
        wide = np.zeros((self.rows, x.shape[1]))
        wide[self.place] = x
        ahead, back = decayed(wide, half + 1, ratio), decayed(wide[::-1], half + 1, ratio)[::-1]
        return ahead[self.place] + back[self.place] - x


def medians(values: np.ndarray, block: np.ndarray, before: int, after: int, at: int) -> np.ndarray:
    """The value in place ``at`` of each sorted window; NaN are left out, and stand where there are too few.

    A sorted list is carried along: a row that enters is inserted, a row that leaves is taken out.
    """
    out, known, numbers = np.full(len(values), np.nan), (~np.isnan(values)).tolist(), values.tolist()
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist() if len(block) else []
    for first, last in zip(starts, [*starts[1:], len(block)]):
        window: list[float] = []
        for i in range(first, min(first + after, last)):
            if known[i]:
                insort(window, numbers[i])
        for i in range(first, last):
            new, old = i + after, i - before - 1
            if new < last and known[new]:
                insort(window, numbers[new])
            if old >= first and known[old]:
                del window[bisect_left(window, numbers[old])]
            if at < len(window):
                out[i] = window[at]
    return out
