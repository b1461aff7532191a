"""Rows on their way to Python and back, a few megabytes at a time whatever their number: a batch that is bounded by rows alone grows with them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH = 4 << 20  # bytes of rows that leave the JVM at once
PIECE = 1 << 20  # bytes of texts or files that are worked on at once
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_bytes(spark: SparkSession) -> None:
    """Batches to Python end at ``BATCH`` bytes too, unless the session has a limit of its own."""
    if spark.conf.get(_KEY, None) is None:
        spark.conf.set(_KEY, str(BATCH))


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Start and number of neighbours whose sizes are at most so much together, or that are alone."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k - start
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes) - start


def pieces(rows: pa.RecordBatch, column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """rows in runs whose values of a column (text or bytes) have at most so many bytes together, or that are one row."""
    for start, n in runs(pc.fill_null(pc.binary_length(rows.column(column)), 0).to_pylist(), most):
        yield rows.slice(start, n)
