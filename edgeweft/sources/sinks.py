"""Writers for the text formats; null becomes -1 here and nowhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import schema
from ..functions.scalars import or_none


def _csv(df: DataFrame, path: str, sep: str = " ", mode: str = "overwrite", by: str | None = None) -> None:
    writer = df.write.mode(mode).option("sep", sep)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_statistics(runs: DataFrame, path: str) -> None:
    """Append run statistics as TSV."""
    _csv(runs.select(*schema.RUN_STATISTICS.names), path, "\t", "append")


def write_line_graph_statistics(rows: DataFrame, path: str) -> None:
    """Append (dataset, ts, seconds, s) as TSV."""
    _csv(rows.select("dataset", "ts", "seconds", "s"), path, "\t", "append")


def write_landmarks(landmarks: DataFrame, sizes: DataFrame, path: str) -> None:
    """landmark s cc size"""
    _csv(landmarks.join(sizes, ["s", "cc"]).select("landmark", "s", "cc", "size"), path)


def merged_profiles(approx: DataFrame, real: DataFrame | None) -> DataFrame:
    """(p, q, s, d, lb, ub, d_hat): the real profiles with what is estimated for them; without real ones the estimates for both."""
    if real is None:
        return approx.select("p", "q", "s", F.col("d_hat").alias("d"), "lb", "ub", "d_hat")
    joined = real.select("p", "q", "s", F.col("d").cast("double").alias("d")).join(approx.select("p", "q", "s", "lb", "ub", "d_hat"), ["p", "q", "s"], "left")
    return joined.select("p", "q", "s", *[or_none(F.col(c)).alias(c) for c in ("d", "lb", "ub", "d_hat")])


def write_profiles(approx: DataFrame, real: DataFrame | None, path: str) -> None:
    """u v s real lb ub approx"""
    _csv(merged_profiles(approx, real), path)


def merged_centralities(approx: DataFrame, real: DataFrame | None) -> DataFrame:
    """(id, real, approx): approx drives, real defaults to it."""
    if real is None:
        return approx.select("id", F.col("value").alias("real"), F.col("value").alias("approx"))
    joined = approx.select("id", F.col("value").alias("approx")).join(real.select("id", F.col("value").alias("real")), "id", "left")
    return joined.select("id", F.coalesce("real", "approx").alias("real"), "approx")


def write_centralities(approx: DataFrame, real: DataFrame | None, path: str) -> None:
    """id real approx"""
    _csv(merged_centralities(approx, real), path)


def write_reachable(found: DataFrame, path: str) -> None:
    """src dst s dist"""
    _csv(found.select("src", "dst", "s", "dist"), path)


def merged_top_k(approx: DataFrame, real: DataFrame, k: int) -> DataFrame:
    """(q, rank, approx, real, s) from two (s, q, rank, e): a row for each rank up to ``k``, -1 where there is no element."""
    asked = approx.select("s", "q").union(real.select("s", "q")).distinct()
    ranks = asked.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    a, r = approx.select("s", "q", "rank", F.col("e").alias("approx")), real.select("s", "q", "rank", F.col("e").alias("real"))
    both = ranks.join(a, ["s", "q", "rank"], "left").join(r, ["s", "q", "rank"], "left")
    none = F.lit(-1).cast("bigint")
    return both.select("q", "rank", F.coalesce("approx", none).alias("approx"), F.coalesce("real", none).alias("real"), "s")


def write_top_k(approx: DataFrame, real: DataFrame, k: int, path: str) -> None:
    """q approx real s, a line for each rank"""
    _csv(merged_top_k(approx, real, k).orderBy("s", "q", "rank").drop("rank"), path)


def write_line_graph(lines: DataFrame, path: str) -> None:
    """u v, a folder for each s"""
    _csv(lines.select("u", "v", "s"), path, by="s")


def write_overlaps(ov: DataFrame, path: str) -> None:
    """src dst weight as TSV"""
    _csv(ov.select("e1", "e2", "w"), path, "\t")


def write_id_map(ids: DataFrame, path: str) -> None:
    """old new"""
    _csv(ids.select("old", "new"), path)


def profile_maps(profiles: DataFrame) -> DataFrame:
    """(p, q, profile): a map from s to (lb, ub, d_hat) of each pair."""
    entry = F.struct("s", F.struct("lb", "ub", "d_hat").alias("b"))
    return profiles.groupBy("p", "q").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("profile"))


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with their rank in the group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
