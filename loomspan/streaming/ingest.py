"""Continuous ingestion: new Parquet files of points are appended to a table as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.functions.vectors import valid_vectors


def append_points(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, dim: int) -> StreamingQuery:
    """Starts a query that adds valid points of new files to target and stops when all present are done."""
    stream = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, number: int) -> None:
        rows = valid_vectors(batch, "vector", dim, strict=False).withColumn("batch", F.lit(number))
        # A batch that runs again replaces its own partition, so every point lands once.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
