"""Readers for the text formats of hypergraphs, queries and results. All schemas are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..functions import scalars
from ..session import materialize


def read_hypergraph(spark: SparkSession, path: str) -> DataFrame:
    """(file, e, v): one hyperedge a line, its id the line number from 0; a vertex repeated in a line counts once.

    Empty lines keep their number but have no rows. Several files are numbered each for itself. A file is read in splits like any other:
    lines are numbered within their split, and the numbers of the splits before, in the order of the file, are added.
    """
    place = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("start"), F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"), F.rtrim("value", F.lit("\r")).alias("line"))
    lines = materialize(lines, "lines")
    # a row for each split of a file: its first line, and the lines of the splits before
    splits = lines.groupBy("file", "start", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    # splits are as few as files have blocks; their size decides how they are joined
    numbered = lines.join(splits, ["file", "start"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("e"), "line")
    vertices = F.array_distinct(F.array_compact(F.split(F.trim("line"), r"\s+").try_cast("array<bigint>")))
    return numbered.select("file", "e", F.explode(vertices).alias("v"))


def read_vertex_map(spark: SparkSession, path: str) -> DataFrame:
    """(v, edges) without building anything else."""
    return read_hypergraph(spark, path).groupBy("v").agg(F.sort_array(F.collect_set("e")).alias("edges"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of a TSV whose ids may be of the form x-y-id."""
    rows = spark.read.csv(path, sep="\t", schema="raw string, label string")
    return rows.select(scalars.label_id(F.col("raw")).alias("id"), "label")


def _delimited(spark: SparkSession, path: str, kinds: StructType, sep: str = " ") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=kinds)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(p, q) without repetitions."""
    return _delimited(spark, path, schema.PAIRS).distinct()


def read_s_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(p, q, s), repetitions kept."""
    return _delimited(spark, path, schema.S_PAIRS)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(id), repetitions kept."""
    return spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("id"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Saved results p q s d lb ub [d_hat]; -1 becomes null in d."""
    rows = _delimited(spark, path, schema.PROFILES)
    return rows.withColumn("d", F.when(F.col("d") >= 0, F.col("d")))


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, schema.RUN_STATISTICS, "\t")


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, schema.LANDMARKS)


def read_centralities(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, schema.CENTRALITIES)


def read_reachable(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, schema.REACHABLE)


def read_top_k(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, schema.TOP_K)


def read_edge_list(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """(u, v), u < v, of an undirected edge list: without loops, negative ids, repetitions and lines that aren't two numbers."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"[\s,]+" if sep == " " else sep).alias("x")).where(F.size("x") == 2)
    ends = rows.select(F.col("x")[0].try_cast("bigint").alias("a"), F.col("x")[1].try_cast("bigint").alias("b")).where("a >= 0 and b >= 0 and a <> b")
    return ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def read_distance_queries(spark: SparkSession, path: str) -> DataFrame:
    """(p, q) of different nodes, repetitions kept."""
    return _delimited(spark, path, schema.PAIRS).where("p <> q")


def dense_ids(edges: DataFrame) -> DataFrame:
    """(old, new): nodes of an edge list (u, v), numbered from 0 in the order of their ids.

    Numbers are places in the sorted ids: each range-sorted task counts its own, and adds the counts of the tasks before.
    """
    from ..operators.landmarks import running_total

    nodes = edges.select(F.explode(F.array("u", "v")).alias("old")).distinct().withColumn("one", F.lit(1.0))
    return running_total(nodes, ["old"], "one").select("old", (F.col("upto") - 1).cast("bigint").alias("new"))


def remapped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (u, v), u < v, under new ids; edges of unknown nodes are dropped."""
    a = ids.select(F.col("old").alias("u"), F.col("new").alias("a"))
    b = ids.select(F.col("old").alias("v"), F.col("new").alias("b"))
    both = edges.join(a, "u").join(b, "v").where("a <> b")
    return both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def ranked_ids(edges: DataFrame) -> DataFrame:
    """(old, new): nodes by descending degree, ties by the smaller id, numbered from 0."""
    from ..operators.landmarks import running_total

    both = edges.select(F.explode(F.array("u", "v")).alias("old"))
    degree = both.groupBy("old").agg((-F.count(F.lit(1))).alias("d")).withColumn("one", F.lit(1.0))
    return running_total(degree, ["d", "old"], "one").select("old", (F.col("upto") - 1).cast("bigint").alias("new"))


def first_seen_ids(edges: DataFrame, order: str) -> DataFrame:
    """(old, new): nodes numbered by where they come first, ``order`` giving the place of an edge; u before v."""
    ends = edges.select(F.col("u").alias("old"), (F.col(order) * 2).alias("at")).union(edges.select(F.col("v").alias("old"), (F.col(order) * 2 + 1).alias("at")))
    from ..operators.landmarks import running_total

    first = ends.groupBy("old").agg(F.min("at").alias("at")).withColumn("one", F.lit(1.0))
    return running_total(first, ["at", "old"], "one").select("old", (F.col("upto") - 1).cast("bigint").alias("new"))


def same_width_lines(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of an edge list whose lines may have further columns: only lines with as many columns as most of the first ten, whose first two
    are numbers; without loops, negative ids and repetitions."""
    cells = spark.read.text(path).select(F.split(F.trim("value"), r"[\s,;]+").alias("x"))
    widths = cells.limit(10).groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), F.col("n").desc()).first()
    if widths is None or widths["n"] < 2:
        return spark.createDataFrame([], schema.EDGE_LIST)
    ends = cells.where(F.size("x") == widths["n"]).select(F.col("x")[0].try_cast("bigint").alias("a"), F.col("x")[1].try_cast("bigint").alias("b")).where("a >= 0 and b >= 0 and a <> b")
    return ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An edge list (u, v) without the nodes that have the same neighbours as a smaller one, under ids by descending degree; and (old, new) of
    all nodes, where a node left out has the id of its twin."""
    from ..operators import overlap

    twins = materialize(overlap.twins(edges), "twins")
    kept = edges
    for end in ("u", "v"):
        kept = kept.join(twins.select(F.col("node").alias(end)), end, "left_anti")
    ids = materialize(ranked_ids(kept), "ids")
    of_twins = twins.join(ids.withColumnRenamed("old", "twin"), "twin").select(F.col("node").alias("old"), "new")
    return remapped(kept, ids), ids.union(of_twins)


def read_highway_log(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a highway index, as its log has them: (graph, landmarks, index_ms, query_ms, d) from a file with a header."""
    rows = spark.read.csv(path, sep=" ", header=True)
    return rows.select(
        F.col("HyperGraph").alias("graph"), F.col("L").try_cast("int").alias("landmarks"), F.col("IndexTime(ms)").try_cast("double").alias("index_ms"),
        F.col("QueryTime(ms)").try_cast("double").alias("query_ms"), F.col("HL-d").try_cast("int").alias("d"),
    )


def read_core_tree_log(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Queries of a core-tree index: (graph, s, micros, d, src, dst, width) from a file with a header of any names."""
    rows = spark.read.csv(path, sep=" ", header=True, schema="graph string, s int, micros double, d int, src bigint, dst bigint", enforceSchema=True)
    return rows.withColumn("width", F.lit(width))
