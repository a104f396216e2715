"""Arrays of numbers as rows of numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str, extra: list[str] | None = None) -> DataFrame:
    """(id, v array<double>, *extra): rows with an id and a vector that is neither null, empty nor zero and holds only finite numbers."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *(extra or []))
    huge = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < huge)) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    n = len(column)
    values = np.asarray(column.flatten())
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def dots(E: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of E with q, each summed from the first component to the last, so equal rows have equal products."""
    return np.add.reduce(np.ascontiguousarray(E.T) * q[:, None], axis=0) if len(E) else np.zeros(0)
