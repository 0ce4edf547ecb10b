"""Statistics of graphs, runs and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import overlap


def mean_median_geometric(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, mean, median, geometric): null values don't count, values of at most 0 not for the geometric mean."""
    log = F.when(F.col(x) > 0, F.ln(F.col(x)))
    return rows.groupBy(*keys).agg(F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.exp(F.avg(log)).alias("geometric"))


def error_metrics(rows: DataFrame, keys: list[str], real: str, estimate: str, penalty: float = 1.5) -> DataFrame:
    """(keys, n, mae, rmse, l1): an estimate of less than 0 counts as ``penalty`` times the largest real value of the group.

    Rows whose real value is null or less than 0 don't count.
    """
    if penalty < 1:
        raise ValueError("penalty must be at least 1")
    known = rows.where(F.col(real) >= 0)
    # one pass: sums over rows with an estimate, and sums of powers of the real values of the others
    bad = (F.col(estimate) < 0) | F.col(estimate).isNull()
    off, x = F.abs(F.col(real) - F.col(estimate)).cast("double"), F.col(real).cast("double")
    sums = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(~bad, off).otherwise(0.0)).alias("_o"), F.sum(F.when(~bad, off * off).otherwise(0.0)).alias("_oo"),
        F.sum(F.when(bad, 1.0).otherwise(0.0)).alias("_k"), F.sum(F.when(bad, x).otherwise(0.0)).alias("_x"), F.sum(F.when(bad, x * x).otherwise(0.0)).alias("_xx"), F.max(x).alias("_most"),
    ).where("n > 0")
    # with a penalty of 1 or more, the estimate that counts for the others is at least as large as every real value
    h = F.lit(penalty) * F.col("_most")
    l1 = F.col("_o") + F.col("_k") * h - F.col("_x")
    square = F.col("_oo") + F.col("_k") * h * h - 2 * h * F.col("_x") + F.col("_xx")
    return sums.select(*keys, "n", (l1 / F.col("n")).alias("mae"), F.sqrt(F.greatest(square, F.lit(0.0)) / F.col("n")).alias("rmse"), l1.alias("l1"))


def graph_stats(inc: DataFrame, max_k: int = 10) -> DataFrame:
    """One row of counts over different hyperedges: n_vertices, n_edges, dimension, mean_degree, and size_k, those with at least k vertices."""
    sets = inc.groupBy("e").agg(F.sort_array(F.collect_list("v")).alias("vs")).select("vs").distinct().withColumn("size", F.size("vs"))
    sized = [F.sum(F.when(F.col("size") >= k, 1).otherwise(0)).alias(f"size_{k}") for k in range(1, max_k + 1)]
    edges = sets.agg(F.count(F.lit(1)).alias("n_edges"), F.max("size").cast("bigint").alias("dimension"), F.sum("size").alias("n_inc"), *sized)
    one = F.lit(1).alias("one")
    vertices = inc.agg(F.countDistinct("v").alias("n_vertices"))
    both = edges.select("*", one).join(F.broadcast(vertices.select("*", one)), "one")
    return both.select("n_vertices", "n_edges", "dimension", (F.col("n_inc") / F.col("n_vertices")).alias("mean_degree"), *[f"size_{k}" for k in range(1, max_k + 1)])


def label_histogram(labels: DataFrame, least: int) -> DataFrame:
    """(label, n) of labels with at least ``least`` rows."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def share_of_total(rows: DataFrame, keys: list[str], within: list[str], x: str) -> DataFrame:
    """(keys, total, share): sums per key, and their share of the sum over ``within``."""
    total = rows.groupBy(*keys).agg(F.sum(x).cast("double").alias("total"))
    return total.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy(*within)))


def run_summary(runs: DataFrame) -> DataFrame:
    """Per dataset, strategy and assignment, all without case and blanks: runs, landmarks, sizes and the time of a query.

    Rows sent more than once count once.
    """
    clean = runs.distinct().select(
        F.lower(F.trim("dataset")).alias("dataset"), F.lower(F.trim("ls")).alias("ls"), F.lower(F.trim("la")).alias("la"), "offline", "online", "num_landmarks", "oracle_size", "num_queries"
    )
    per_query = F.when(F.col("num_queries") > 0, F.col("online") / F.col("num_queries"))
    return clean.groupBy("dataset", "ls", "la").agg(
        F.count(F.lit(1)).alias("runs"), F.min("num_landmarks").alias("min_landmarks"), F.max("num_landmarks").alias("max_landmarks"),
        F.avg("num_landmarks").alias("mean_landmarks"), F.avg("oracle_size").alias("mean_size"), F.avg("offline").alias("mean_offline"), F.avg(per_query).alias("query_time"),
    )


def line_graph_growth(inc: DataFrame, ov: DataFrame, max_s: int) -> DataFrame:
    """(s, n_edges, growth): edges of each s-line graph, and their number per hyperedge."""
    lines = overlap.line_graph(ov, max_s).groupBy("s").agg(F.count(F.lit(1)).alias("n_edges"))
    n = inc.select("e").distinct().agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(1).alias("one")
    return lines.select("*", one).join(F.broadcast(n.select("*", one)), "one").select("s", "n_edges", (F.col("n_edges") / F.col("n")).alias("growth"))


def penalised(estimate: Column, unreachable: float) -> Column:
    return F.when(estimate < 0, F.lit(unreachable)).otherwise(estimate)
