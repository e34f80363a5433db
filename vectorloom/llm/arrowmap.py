"""Runs a function over Arrow batches of a DataFrame's columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


#: Rows that a kernel gets at once, so its results stay small whatever the size of Spark's batches.
ROWS = 512


def arrow_map(df: DataFrame, columns: dict[str, str], schema: str, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | dict]) -> DataFrame:
    """``kernel`` sees only ``columns`` (new name -> SQL expression), so others neither travel nor clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = kernel(batch.slice(at, ROWS))
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.select(*(F.expr(e).alias(c) for c, e in columns.items())).mapInArrow(run, schema)
