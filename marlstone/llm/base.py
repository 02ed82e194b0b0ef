"""What the operators of this package share: table reading and Arrow batch mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import shared_dir

#: Bytes of one Arrow batch handed to a Python worker; whole texts vary from bytes to megabytes.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: a row that was delivered again has the same content."""
    return df.dropDuplicates([key])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """Map each Arrow batch of ``df`` by ``fn``; the batches are bounded in bytes as well as in rows."""
    limit = BATCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, batch.nbytes))))
            for start in range(0, batch.num_rows, rows):
                out = fn(batch.slice(start, rows))
                if isinstance(out, pa.Table):
                    yield from out.combine_chunks().to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared checkpoint folder and read again: it outlives lost executors
    and, in columns, takes a fraction of a checkpoint's room."""
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
