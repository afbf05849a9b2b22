"""Glue between Arrow batches and plain Python functions over lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_columns(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str) -> DataFrame:
    """Map batches of columns to batches of columns.

    ``make()`` runs once in each task and returns a function that gets one Python list per
    input column and returns one list (or Arrow array) per column of ``schema``. The number
    of rows may change. Batches are bounded by spark.sql.execution.arrow.maxRecordsPerBatch,
    so no task holds more than one batch.
    """
    parsed: StructType = _parse_datatype_string(schema)
    out = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = work(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out)], schema=out
            )

    return df.mapInArrow(run, parsed)
