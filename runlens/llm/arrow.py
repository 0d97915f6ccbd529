"""Small helpers around ``mapInArrow`` and bounded results on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from runlens.session import shared_dir


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; batches for which it returns None give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null text counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def stored(df: DataFrame, purpose: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write once to the cluster's shared folder and read back: cuts the lineage for good.

    Reading back from files survives lost executors, and what lies before is not computed again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(df: DataFrame, rows: int = 256) -> Iterator[list[Row]]:
    """The rows of a stored table of bounded size, in its order, so many at a time.

    Partitions are fetched one after the other: on its way to Python no more than one of them is in the
    driver's memory.
    """
    left = df.toLocalIterator()
    while piece := list(islice(left, rows)):
        yield piece


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of a value's text, modulo; what train/held-out splits are defined by."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
