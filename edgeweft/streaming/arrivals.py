"""Counts over hyperedge lines that arrive as files, kept up to date by Structured Streaming.

The batch operators need whole graphs; what can be kept incrementally are the counts they start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.lines import line_records


def read_lines(spark: SparkSession, path: str, schema: StructType, max_files: int = 100) -> DataFrame:
    """A stream of line files (id, edge, dataset, loaded_at)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def arrivals(lines: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, dataset, n_records, n_incidences) of lines by arrival; later ones than ``late`` behind the newest are dropped."""
    records = line_records(lines.withWatermark("loaded_at", late), "dataset", "loaded_at")
    return records.groupBy(F.window("loaded_at", window), "dataset").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.size("vs")).alias("n_incidences"))


def keep_incidence(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the incidences of arriving lines to a Parquet table, from which any batch operator can start."""
    inc = line_records(lines).select(F.col("id").alias("e"), F.explode("vs").alias("v"))
    return inc.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
