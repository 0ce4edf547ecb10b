"""Incidence, sizes and overlaps of hyperedges.

The canonical form of a hypergraph is ``inc(e, v)``, one row per hyperedge and vertex.
Overlaps are computed once; every s-line graph is a filter on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .skew import group_pairs


def incidence(rows: DataFrame, e: str, v: str) -> DataFrame:
    """Distinct (e, v) of any table; rows with a null in either column don't count."""
    pairs = rows.select(F.col(e).cast("bigint").alias("e"), F.col(v).cast("bigint").alias("v"))
    return pairs.where("e is not null and v is not null").distinct()


def edge_sizes(inc: DataFrame) -> DataFrame:
    """(e, size)."""
    return inc.groupBy("e").agg(F.count(F.lit(1)).alias("size"))


def vertex_degrees(inc: DataFrame) -> DataFrame:
    """(v, degree): the number of hyperedges of each vertex."""
    return inc.groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


def vertex_map(inc: DataFrame) -> DataFrame:
    """(v, edges): the sorted hyperedges of each vertex."""
    return inc.groupBy("v").agg(F.sort_array(F.collect_list("e")).alias("edges"))


def edge_sets(inc: DataFrame) -> DataFrame:
    """(e, vertices, size): the sorted vertices of each hyperedge."""
    return inc.groupBy("e").agg(F.sort_array(F.collect_list("v")).alias("vertices")).withColumn("size", F.size("vertices"))


def graph_counts(inc: DataFrame) -> DataFrame:
    """One row: n_edges, n_vertices, n_incidences, dimension (largest size)."""
    sizes = edge_sizes(inc).agg(
        F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_incidences"), F.max("size").alias("dimension")
    )
    vertices = inc.agg(F.countDistinct("v").alias("n_vertices"))
    one = F.lit(1).alias("one")
    return sizes.select("*", one).join(F.broadcast(vertices.select("*", one)), "one").select("n_edges", "n_vertices", "n_incidences", "dimension")


def edges_of_min_size(inc: DataFrame, s: int) -> DataFrame:
    """(e, size) of hyperedges with at least ``s`` vertices; all for s = 1."""
    return edge_sizes(inc).where(F.col("size") >= s)


def min_size_counts(inc: DataFrame, max_s: int) -> DataFrame:
    """(s, n_edges): how many hyperedges have at least s vertices, s = 1..max_s."""
    sizes = edge_sizes(inc).withColumn("s", F.explode(F.sequence(F.lit(1), F.least(F.col("size").cast("int"), F.lit(max_s)))))
    return sizes.groupBy("s").agg(F.count(F.lit(1)).alias("n_edges"))


#: A vertex is a hub if it has this many times the mean number of hyperedges.
HUB = 8
#: Hyperedges are joined on pairs of vertices if these are fewer than the pairs of hyperedges with a common vertex by this factor.
PAIRS_PAY = 3
#: Hyperedges of a vertex from which on they are joined in pairs of blocks.
BLOCK_EDGES = 20_000


def _method(inc: DataFrame, degrees: DataFrame, min_overlap: int) -> tuple[str, int]:
    """How overlaps of at least ``min_overlap`` are found, from sums over vertices and hyperedges; and the largest degree."""
    pairs = F.col("n") * (F.col("n") - 1.0)
    mean, most, total = degrees.agg(F.avg("n"), F.max("n"), F.sum(pairs)).first()
    if mean is None or min_overlap <= 1:
        return "vertices", most or 0
    within = inc.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_overlap).agg(F.sum(pairs)).first()[0] or 0
    if PAIRS_PAY * within <= total:
        return "pairs", most
    hubs = degrees.agg(F.sum(F.when(F.col("n") >= HUB * mean, pairs).otherwise(0.0))).first()[0]
    return "prefix" if 2 * hubs >= total > 0 else "vertices", most


def overlaps(inc: DataFrame, min_overlap: int = 1, by_prefix: bool | None = None, method: str | None = None) -> DataFrame:
    """(e1, e2, w), e1 < e2: the number of common vertices of all pairs that share at least ``min_overlap``.

    There are three ways with the same result; which is taken follows from counts, or is named by ``method`` (or ``by_prefix``):

    * ``vertices``: hyperedges that are large enough are joined on their vertices and counted, always for min_overlap = 1.
    * ``pairs``, for small hyperedges over frequent vertices: they are joined on pairs of vertices. Two with w common vertices
      share w (w - 1) / 2 pairs, so counting these gives w, and pairs with one common vertex never meet.
    * ``prefix``, where hubs make half of all pairs: for min_overlap = s only pairs are looked at that share one of the |e| - s + 1
      least frequent vertices of both, in one global order: a pair with s common vertices can't have all of them among the s - 1 most
      frequent. The overlap of these pairs is counted on the whole sets.

    Vertices and pairs with more than BLOCK_EDGES hyperedges are joined in pairs of blocks, over many tasks.
    """
    degrees = inc.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    if method is None and by_prefix is not None:
        method = "prefix" if by_prefix and min_overlap > 1 else "vertices"
    if method is None:
        degrees = materialize(degrees, "degrees")
        method, most = _method(inc, degrees, min_overlap)
    else:
        most = degrees.agg(F.max("n")).first()[0] or 0
    able = inc.join(edges_of_min_size(inc, min_overlap).select("e"), "e").select("e", "v") if min_overlap > 1 else inc.select("e", "v")
    if method == "vertices":
        met = _meetings(able, ["v"], most, degrees.select("v", F.col("n").alias("_rows")))
        return met.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= min_overlap)
    if method == "pairs":
        if min_overlap < 2:
            raise ValueError("pairs of vertices only find overlaps of two or more")
        within = group_pairs(able, ["e"], "v").select("e", F.col("a").alias("v1"), F.col("b").alias("v2"))
        met = _meetings(within, ["v1", "v2"], most, None)
        w = ((F.lit(1) + F.sqrt(F.lit(1) + F.lit(8) * F.count(F.lit(1)))) / 2).cast("bigint")
        return met.groupBy("e1", "e2").agg(w.alias("w")).where(F.col("w") >= min_overlap)
    if method != "prefix":
        raise ValueError(f"no method {method}")
    ranked = inc.join(degrees, "v").groupBy("e").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("o"))
    sets = materialize(ranked.where(F.size("o") >= min_overlap).select("e", F.col("o.v").alias("o")), "sets")
    prefix = sets.select("e", F.explode(F.slice("o", F.lit(1), F.size("o") - min_overlap + 1)).alias("v"))
    pairs = _meetings(prefix, ["v"], most, None).select("e1", "e2").distinct()
    x, y = sets.select(F.col("e").alias("e1"), F.col("o").alias("x")), sets.select(F.col("e").alias("e2"), F.col("o").alias("y"))
    both = pairs.join(x, "e1").join(y, "e2").select("e1", "e2", F.size(F.array_intersect("x", "y")).cast("bigint").alias("w"))
    return both.where(F.col("w") >= min_overlap)


def met_in_blocks(inc: DataFrame, block_edges: int) -> DataFrame:
    """(e1, e2) once for each vertex that hyperedges e1 < e2 share; vertices with more than ``block_edges`` of them are joined in pairs of blocks."""
    return group_pairs(inc.select("e", "v"), ["v"], "e", max(1, block_edges)).select(F.col("a").alias("e1"), F.col("b").alias("e2"))


def _meetings(rows: DataFrame, keys: list[str], most: int, counts: DataFrame | None) -> DataFrame:
    """(e1, e2) once for each key that hyperedges e1 < e2 share; none has more than ``most`` of them."""
    if most > BLOCK_EDGES:
        return group_pairs(rows, keys, "e", BLOCK_EDGES, counts).select(F.col("a").alias("e1"), F.col("b").alias("e2"))
    a, b = rows.withColumnRenamed("e", "e1"), rows.withColumnRenamed("e", "e2")
    return a.join(b, keys).where("e1 < e2").select("e1", "e2")


def overlap_of(pairs: DataFrame, ov: DataFrame) -> DataFrame:
    """``pairs(p, q)`` with w, -1 where they share nothing; the order within a pair doesn't matter."""
    known = ov.select(F.col("e1").alias("lo"), F.col("e2").alias("hi"), "w")
    asked = pairs.select("p", "q", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))
    return asked.join(known, ["lo", "hi"], "left").select("p", "q", F.coalesce("w", F.lit(-1).cast("bigint")).alias("w"))


def neighbours(ov: DataFrame) -> DataFrame:
    """Both directions of the overlaps: (e, nb, w)."""
    return ov.select(F.col("e1").alias("e"), F.col("e2").alias("nb"), "w").union(ov.select(F.col("e2").alias("e"), F.col("e1").alias("nb"), "w"))


def s_neighbours(ov: DataFrame, edges: DataFrame, s: int, among: DataFrame | None = None) -> DataFrame:
    """(e, nb, w): s-neighbours of ``edges(e)``, only those in ``among(e)`` if given."""
    found = neighbours(ov.where(F.col("w") >= s)).join(edges.select("e").distinct(), "e", "left_semi")
    return found if among is None else found.join(among.select(F.col("e").alias("nb")).distinct(), "nb", "left_semi").select("e", "nb", "w")


def adjacency(ov: DataFrame, s_values: list[int]) -> DataFrame:
    """(s, e, nb): both directions of the s-line graphs of all given s at once."""
    each = F.explode(F.filter(F.array(*[F.lit(int(s)) for s in s_values]), lambda s: s <= F.col("w")))
    return neighbours(ov.where(F.col("w") >= min(s_values))).select(each.alias("s"), "e", "nb")


def s_degrees(inc: DataFrame, ov: DataFrame, s: int) -> DataFrame:
    """(e, degree) of every hyperedge with at least s vertices; 0 if it has no s-neighbour."""
    counted = neighbours(ov.where(F.col("w") >= s)).groupBy("e").agg(F.count(F.lit(1)).alias("degree"))
    return edges_of_min_size(inc, s).join(counted, "e", "left").select("e", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def line_graph(ov: DataFrame, max_s: int) -> DataFrame:
    """(s, u, v), u < v: the edges of the s-line graphs, s = 1..max_s."""
    each = F.explode(F.sequence(F.lit(1), F.least(F.col("w").cast("int"), F.lit(max_s))))
    return ov.select(each.alias("s"), F.col("e1").alias("u"), F.col("e2").alias("v"))


def line_graph_projection(inc: DataFrame, ov: DataFrame, s: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (e, size) and edges (e1, e2, w) of the s-line graph."""
    return edges_of_min_size(inc, s), ov.where(F.col("w") >= s)


def edges_of_vertices(inc: DataFrame, vertices: DataFrame, s: int) -> DataFrame:
    """(v, e) for the hyperedges of ``vertices(v)`` with at least s vertices; unknown vertices have none."""
    mine = inc.join(vertices.select("v").distinct(), "v", "left_semi")
    return mine.join(edges_of_min_size(inc, s).select("e"), "e").select("v", "e")


def in_common_edge(pairs: DataFrame, inc: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with ``common``: whether some hyperedge holds both vertices."""
    left = pairs.select("u", "v").distinct()
    x = inc.select(F.col("v").alias("u"), "e")
    hit = left.join(x, "u").join(inc, ["v", "e"], "left_semi").select("u", "v").distinct().withColumn("common", F.lit(True))
    return pairs.join(hit, ["u", "v"], "left").select("u", "v", F.coalesce("common", F.lit(False)).alias("common"))


def set_relations(pairs: DataFrame, sets: DataFrame, cap: int) -> DataFrame:
    """For ``pairs(p, q)`` of hyperedges: intersects, contains, same_set, n_common and capped (at ``cap``)."""
    x = sets.select(F.col("e").alias("p"), F.col("vertices").alias("x"))
    y = sets.select(F.col("e").alias("q"), F.col("vertices").alias("y"))
    both = pairs.join(x, "p").join(y, "q")
    common = F.size(F.array_intersect("x", "y"))
    return both.select(
        "p", "q", F.arrays_overlap("x", "y").alias("intersects"), (F.size(F.array_except("y", "x")) == 0).alias("contains"),
        (F.col("x") == F.col("y")).alias("same_set"), common.cast("bigint").alias("n_common"), F.least(common, F.lit(cap)).cast("bigint").alias("capped"),
    )


def max_membership(inc: DataFrame, max_s: int) -> DataFrame:
    """(e, max_s): the largest s for which the hyperedge exists, at most ``max_s`` and at least 1."""
    return edge_sizes(inc).select("e", F.greatest(F.lit(1), F.least(F.col("size").cast("int"), F.lit(max_s))).alias("max_s"))


def twins(ov_edges: DataFrame) -> DataFrame:
    """(node, twin): nodes of an edge list (u, v) with the same neighbours as a smaller node, the smallest such node."""
    both = ov_edges.select("u", "v").union(ov_edges.select("v", "u")).where("u <> v").distinct()
    signature = both.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("n"))
    return signature.withColumn("twin", F.min("u").over(Window.partitionBy("n"))).where("u <> twin").select(F.col("u").alias("node"), "twin")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
