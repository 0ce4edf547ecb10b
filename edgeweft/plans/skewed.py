"""Problem 7: members per component though a few components hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import skew
from ..sources.lines import table


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cc_per_hyperedge").select("s", "e", "cc").where(F.col("cc") >= 0)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(_members(spark, sf_dir), ["s", "cc"], "e", 0.01).select("s", "cc")


def p7_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.distinct_sizes(_members(spark, sf_dir), ["s", "cc"], "e")


def p7_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.modes(_members(spark, sf_dir), ["s", "cc"], "e")


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.percentiles(_members(spark, sf_dir), ["s", "cc"], "e", [0.5, 0.9])


QUERIES = {"p7_found": p7_found, "p7_sizes": p7_sizes, "p7_modes": p7_modes, "p7_percentiles": p7_percentiles}

SQL = {
    "p7_found": """
        WITH d AS (SELECT DISTINCT s, e, cc FROM cc_per_hyperedge WHERE cc >= 0)
        SELECT s, cc FROM d GROUP BY s, cc HAVING count(*) >= 0.01 * (SELECT count(*) FROM d)""",
    "p7_sizes": """
        WITH f AS (SELECT s, cc, e, count(*) AS freq FROM cc_per_hyperedge WHERE cc >= 0 GROUP BY s, cc, e)
        SELECT s, cc, count(*) AS n_values, CAST(sum(freq) AS BIGINT) AS n_rows FROM f GROUP BY s, cc""",
    "p7_modes": """
        WITH f AS (SELECT s, cc, e, count(*) AS freq FROM cc_per_hyperedge WHERE cc >= 0 AND e IS NOT NULL GROUP BY s, cc, e)
        SELECT s, cc, e AS mode, freq AS mode_freq FROM f
        QUALIFY row_number() OVER (PARTITION BY s, cc ORDER BY freq DESC, e) = 1""",
    "p7_percentiles": """
        WITH f AS (SELECT s, cc, e, row_number() OVER (PARTITION BY s, cc ORDER BY e) AS r,
                          count(*) OVER (PARTITION BY s, cc) AS n
                   FROM cc_per_hyperedge WHERE cc >= 0 AND e IS NOT NULL),
        p AS (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE]) AS p)
        SELECT s, cc, p, e AS percentile FROM f, p WHERE r = greatest(1, ceil(p * n))""",
}
