"""What passes between the JVM and Python workers, and what workers keep."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Texts may be long, so no operator of this package wants larger batches. All lower to the same number, so their order doesn't matter.
MOST_ROWS = 256
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def limit_rows(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to MOST_ROWS, which bounds what executors hold outside their heap; a lower number stays."""
    now = int(spark.conf.get(_KEY))
    if now <= 0 or now > MOST_ROWS:
        spark.conf.set(_KEY, MOST_ROWS)


def _released(run: Arrow) -> Arrow:
    """Afterwards the worker, which waits for further tasks, gives back what it no longer needs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return go


def map_arrow(df: DataFrame, run: Arrow, schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches of at most MOST_ROWS rows."""
    limit_rows(df.sparkSession)
    return df.mapInArrow(_released(run), schema)
