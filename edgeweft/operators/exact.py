"""Exact distance profiles, closeness and nearest elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import bfs
from .overlap import edges_of_vertices

KINDS = ("edge", "vertex", "both")


def with_s(rows: DataFrame, s_values: list[int]) -> DataFrame:
    """Each row once for every s."""
    return rows.withColumn("s", F.explode(F.array(*[F.lit(int(s)) for s in s_values])))


def edge_profiles(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s, p, q, d) for ``pairs(s, p, q)`` of hyperedges that are connected; p = q gives 0."""
    asked = materialize(pairs.select("s", "p", "q").distinct(), "asked")
    sources, targets = asked.select("s", F.col("p").alias("src")), asked.select("s", F.col("p").alias("src"), F.col("q").alias("e"))
    found = bfs.distances(adj, sources, targets=targets).select("s", F.col("src").alias("p"), F.col("e").alias("q"), F.col("dist").alias("d"))
    return asked.join(found, ["s", "p", "q"])


def vertex_profiles(adj: DataFrame, inc: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s, u, v, d) for ``pairs(s, u, v)`` of vertices: the smallest positive distance between a hyperedge of u and one of v.

    u = v gives 0. A hyperedge that holds both vertices gives no distance by itself, as in the reference.
    """
    asked = materialize(pairs.select("s", "u", "v").distinct(), "asked")
    ends = []
    for end, name in (("u", "p"), ("v", "q")):
        mine = asked.select("s", F.col(end).alias("v")).distinct()
        sized = inc.join(inc.groupBy("e").agg(F.count(F.lit(1)).alias("size")), "e")
        ends.append(mine.join(sized, "v").where("size >= s").select("s", F.col("v").alias(end), F.col("e").alias(name)))
    both = asked.where("u <> v").join(ends[0], ["s", "u"]).join(ends[1], ["s", "v"]).where("p <> q")
    both = materialize(both.select("s", "u", "v", "p", "q"), "ends")
    # the distance is symmetric: each unordered pair is searched once
    lo, hi = F.least("p", "q"), F.greatest("p", "q")
    found = edge_profiles(adj, both.select("s", lo.alias("p"), hi.alias("q")))
    near = both.select("s", "u", "v", lo.alias("p"), hi.alias("q")).join(found, ["s", "p", "q"]).groupBy("s", "u", "v").agg(F.min("d").alias("d"))
    return near.union(asked.where("u = v").select("s", "u", "v", F.lit(0).alias("d")))


def vertex_edge_profiles(adj: DataFrame, inc: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s, v, q, d) for ``pairs(s, v, q)``: the smallest positive distance from a hyperedge of vertex v to hyperedge q."""
    asked = materialize(pairs.select("s", "v", "q").distinct(), "asked")
    sized = inc.join(inc.groupBy("e").agg(F.count(F.lit(1)).alias("size")), "e")
    both = asked.join(sized, "v").where("size >= s and e <> q").select("s", "v", "q", F.col("e").alias("p"))
    both = materialize(both, "ends")
    found = edge_profiles(adj, both.select("s", F.col("q").alias("p"), F.col("p").alias("q"))).select("s", F.col("q").alias("p"), F.col("p").alias("q"), "d")
    return both.join(found, ["s", "p", "q"]).groupBy("s", "v", "q").agg(F.min("d").alias("d"))


def profiles(kind: str, adj: DataFrame, inc: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact profiles by kind: edge (s, p, q), vertex (s, u, v) or both (s, v, q)."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind}")
    if kind == "edge":
        return edge_profiles(adj, pairs)
    return vertex_profiles(adj, inc, pairs) if kind == "vertex" else vertex_edge_profiles(adj, inc, pairs)


def edge_closeness(adj: DataFrame, sources: DataFrame, compat: bool = False) -> DataFrame:
    """(s, src, closeness): reached nodes without the source over the sum of their distances, 0 if there are none.

    ``compat`` counts one node less, as the reference does.
    """
    reached = bfs.distances(adj, sources).groupBy("s", "src").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("total"))
    top = F.col("n") - (2 if compat else 1)
    return reached.select("s", "src", F.when((F.col("total") > 0) & (top > 0), top / F.col("total")).otherwise(F.lit(0.0)).alias("closeness"))


def vertex_closeness(adj: DataFrame, inc: DataFrame, vertices: DataFrame, s: int, compat: bool = False) -> DataFrame:
    """(s, v, closeness): the largest closeness of a hyperedge of the vertex with at least s vertices; 0 if it has none."""
    mine = materialize(edges_of_vertices(inc, vertices, s), "mine")
    close = edge_closeness(adj, mine.select(F.lit(s).alias("s"), F.col("e").alias("src")).distinct(), compat)
    best = mine.join(close.select(F.col("src").alias("e"), "closeness"), "e").groupBy("v").agg(F.max("closeness").alias("closeness"))
    return vertices.select("v").distinct().join(best, "v", "left").select(F.lit(s).alias("s"), "v", F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def ranked_nearest(found: DataFrame, k: int) -> DataFrame:
    """(s, q, rank, e, dist): the first k of ``found(s, src, e, dist)`` for each source, ties by the smaller id."""
    rank = F.row_number().over(Window.partitionBy("s", "src").orderBy("dist", "e"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("s", F.col("src").alias("q"), "rank", "e", "dist")


def nearest(adj: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(s, q, rank, e, dist): the k nearest hyperedges of ``queries(s, q)``, ties by the smaller id, without q itself."""
    found = bfs.distances(adj, queries.select("s", F.col("q").alias("src")), max_reached=k).where("dist > 0")
    return ranked_nearest(found, k)


def nearest_with_label(adj: DataFrame, queries: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(s, q, rank, e, dist): the k nearest hyperedges with the label of q."""
    wanted = queries.select(F.col("q").alias("e")).distinct().join(labels, "e").select(F.col("e").alias("src"), "label")
    found = bfs.nearest_labelled(adj, queries.select("s", F.col("q").alias("src")), labels, wanted, k)
    return ranked_nearest(found, k)
