"""What the operators on vectors share: embeddings as whole numbers, and batches of them as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this, either way, count as it.
LIMIT = 1 << 40


def whole(df: DataFrame, scale: int, *keep: str) -> DataFrame:
    """vec_id, v (array of long: floor(scale * component), components as double) and the columns to keep, of the rows
    whose vector and all its components are there and finite."""
    number = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    within = lambda x: F.greatest(F.least(number(x), F.lit(LIMIT)), F.lit(-LIMIT))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    good = df.filter(F.col("embedding").isNotNull() & finite)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", within).alias("v"), *keep)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and a matrix of whole numbers for each length of vector in the batch."""
    lists = batch.column("v")
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    ends = ends - ends[0]
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[ends[rows][:, None] + np.arange(size)]


def dtype_for(bound: float) -> type:
    """A type in which sums and products of whole numbers are exact as long as none of them passes bound."""
    return np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else object
