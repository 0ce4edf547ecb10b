"""Raw hyperedge lines as exported by different tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship

# Fixed value: a vertex token is optional letters, then digits; the digits are the id.
TOKEN = "[A-Za-z]*([0-9]+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_ids(line: Column) -> Column:
    """Vertex ids of a line in the order written, repetitions kept.

    Numbers beyond the range of BIGINT are no ids and are left out. A null line gives null.
    """
    found = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(1))
    return F.array_compact(found.try_cast("array<bigint>"))


def line_records(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines that hold at least one vertex token, as ``id``, ``tokens`` (sorted multiset) and ``vs`` (sorted set).

    Lines with a null edge or without a token are no records. ``keep`` names further
    columns to carry. Other columns, whatever their names, are ignored.
    """
    picked = lines.select("id", *keep, F.sort_array(token_ids(F.col("edge"))).alias("tokens"))
    return picked.where(F.size("tokens") > 0).withColumn("vs", F.array_distinct("tokens"))
