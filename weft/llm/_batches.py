"""Bounds on what a Python worker gets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS, BYTES = 2000, 4 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after setting its session to hand rows to Python workers in batches of at most ``BYTES`` (one row at least) and ``ROWS``.

    Texts differ in length by orders of magnitude, so a number of rows alone bounds no memory, neither the worker's nor the buffers of the JVM
    that feeds it. Every row is still handed over.
    """
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    return docs
