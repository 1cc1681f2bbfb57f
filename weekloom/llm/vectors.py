"""Reading vector columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        at = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) + 0.0  # nulls are NaN here, -0 becomes 0
        starts, lengths = at[:-1], np.diff(at)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        some = np.concatenate([[0], np.cumsum(values != 0)])
        fine = (bad[at[1:]] == bad[starts]) & (some[at[1:]] > some[starts]) & (lengths > 0) & ~np.asarray(column.is_null()) & ~np.asarray(batch.column(0).is_null())
        rows = np.flatnonzero(fine)
        data = [values[starts[i] : at[i + 1]].tobytes() for i in rows]
        keep = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(2).take(keep), pa.array(lengths[rows].astype(np.int32)), pa.array(data, pa.binary())], names=["vec_id", "label", "dim", "vec"])


def clean(vectors: DataFrame, label: str | None = None) -> DataFrame:
    """(vec_id, label, dim, vec): the rows with an id and a usable vector, vec holding its components as float64.

    Null and zero vectors and those with null or non-finite components are left out. label is null without that column.
    """
    tag = F.lit(None).cast("string") if label is None else F.col(label).cast("string")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", tag.alias("label")).mapInArrow(_clean, "vec_id long, label string, dim int, vec binary")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """One row for each vec of equal dim."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
