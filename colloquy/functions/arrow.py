"""Helpers for kernels that see Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codes(column: pa.Array) -> np.ndarray:
    """Equal values get equal integers; null gets -1."""
    indices = column.dictionary_encode().indices
    return np.asarray(pc.fill_null(indices, -1)).astype(np.int64)


def integers(column: pa.Array, null: int = 0) -> np.ndarray:
    return np.asarray(pc.fill_null(column, null)).astype(np.int64)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before in any key."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def concat_batches(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of several batches with columns of the same types as one batch. Whether a field may be null is left aside: batches made here say yes where Spark's may say no."""
    names = batches[0].schema.names
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(len(names))], names)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    """A list column of the given row lengths over a flat array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
