"""Appending to a table once for each batch, whatever is replayed.

A batch is written to a folder of its own, named by its number, which is put in place whole: a batch that is
played again replaces its own rows and adds nothing. Readers see the batches that are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

BATCH = "append_batch"


def append_batch(rows: DataFrame, folder: str, batch: int) -> None:
    """Write ``rows`` as batch ``batch`` of the table; again with the same number: in its place."""
    if BATCH in rows.columns:
        raise ValueError(f"a column is named {BATCH}")
    numbered = rows.withColumn(BATCH, F.lit(batch).cast("long"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(folder)


def append_stream(rows: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A stream that is appended to the table; a batch that was written before a failure is not added twice."""
    return rows.writeStream.foreachBatch(lambda df, i: append_batch(df, folder, i)).option("checkpointLocation", checkpoint)


def read_appended(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(folder).select(*schema.fieldNames())
