"""Vectors as arrays: which of them count, and how they travel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null, empty or zero and whose components are all finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column without nulls, as arrays of their own type."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The groups of equal keys of a partition sorted by them, each whole, one at a time."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        k = np.stack([rows[c].to_numpy().astype(np.int64) for c in keys], 1)
        cuts = (np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()
        for a, b in zip([0, *cuts[:-1]], cuts):
            yield rows.slice(a, b - a)
        held = rows.slice(cuts[-1]) if cuts else rows
    if held is not None and held.num_rows:
        yield held


def in_batches(found: Iterator[tuple[np.ndarray, ...]], names: Sequence[str], types: Sequence[pa.DataType], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Many small results as few batches."""
    held, n = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held), types)], names=list(names))

    for one in found:
        held.append(one)
        n += len(one[0])
        if n >= rows:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()
