"""s-connected components for all s, from the largest s down, by alternating star contraction on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize
from . import overlap

#: More rounds than any graph needs: they grow with the logarithm of the largest component.
MAX_ROUNDS = 100
#: Up to this many edges one task finds all components; rounds over many tasks only pay beyond.
ONE_TASK_EDGES = 1_000_000


def _hook(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Roots after joining all x[i] with y[i]: larger roots are hooked below smaller ones and ways up are halved."""
    while True:
        hi, lo = np.maximum(up[x], up[y]), np.minimum(up[x], up[y])
        if (hi == lo).all():
            return up
        np.minimum.at(up, hi, lo)
        while not np.array_equal(up, up[up]):
            up = up[up]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest node of the component of each node, for each s by itself."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    s, a, b = (pa.Table.from_batches(held).column(k).to_numpy() for k in range(3))
    for level in np.unique(s):
        mine = s == level
        nodes, at = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
        up = _hook(np.arange(len(nodes)), at[: mine.sum()], at[mine.sum() :])
        yield pa.RecordBatch.from_pydict({"s": np.full(len(nodes), level, np.int32), "e": nodes, "cc": nodes[up]})


def _levels_in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same where a link of level s also holds for all smaller levels: from the largest level down, each link is joined once."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    s, a, b = (pa.Table.from_batches(held).column(k).to_numpy() for k in range(3))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up, linked = np.arange(len(nodes)), np.zeros(len(nodes), bool)
    for level in np.unique(s)[::-1]:
        mine = s == level
        linked[x[mine]] = linked[y[mine]] = True
        up = _hook(up, x[mine], y[mine])
        yield pa.RecordBatch.from_pydict({"s": np.full(linked.sum(), level, np.int32), "e": nodes[linked], "cc": nodes[up[linked]]})


def connect(edges: DataFrame, one_task_edges: int | None = None) -> DataFrame:
    """(s, e, cc) of all nodes of ``edges(s, e, nb)``: cc is the smallest node of the component.

    Up to ``one_task_edges`` different edges, ONE_TASK_EDGES if not given, are one task's work.

    Each round replaces every edge by one to the smallest neighbour, first from all larger
    neighbours, then from all smaller ones. Minima are partial aggregates; the edges are
    joined back with AQE splitting hot nodes. Rounds end when the edges are stars.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("s", "a").agg(F.min("b").alias("m"))

    pairs = edges.select("s", F.greatest("e", "nb").alias("a"), F.least("e", "nb").alias("b")).where("a <> b").distinct()
    pairs = materialize(pairs.select(F.col("s").cast("int").alias("s"), "a", "b"), "cc")
    if pairs.count() <= (ONE_TASK_EDGES if one_task_edges is None else one_task_edges):
        return pairs.coalesce(1).mapInArrow(_in_one_task, "s int, e bigint, cc bigint")
    before = None
    for _ in range(MAX_ROUNDS):
        # large star: neighbours above a node go to its smallest neighbour
        both = pairs.union(pairs.select("s", F.col("b").alias("a"), F.col("a").alias("b")))
        least = minima(both).select("s", F.col("a"), F.least("a", "m").alias("m"))
        up = both.where("b > a").join(least, ["s", "a"]).select("s", F.col("b").alias("a"), F.col("m").alias("b"))
        large = up.where("a <> b").distinct()
        # small star: neighbours below a node, and itself, go to the smallest
        low = minima(large).select("s", F.col("a").alias("n"), "m")
        joined = large.select("s", F.col("a").alias("n"), "b").join(low, ["s", "n"])
        links = joined.select("s", F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("n").alias("a"), F.col("m").alias("b")))).alias("x"))
        after = materialize(links.select("s", "x.a", "x.b").where("a <> b").distinct(), "cc")
        discard(pairs)
        pairs = after
        # sums of hashes tell whether anything changed
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("s", "a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components aren't found after {MAX_ROUNDS} rounds")
    roots = pairs.select("s", "b").distinct().select("s", F.col("b").alias("e"), F.col("b").alias("cc"))
    return pairs.select("s", F.col("a").alias("e"), F.col("b").alias("cc")).union(roots)


def connect_levels(ov: DataFrame, s_values: list[int], one_task_edges: int | None = None) -> DataFrame:
    """(s, e, cc) of all nodes with an overlap of at least s in ``ov(e1, e2, w)``, for all given s.

    A pair that overlaps in s vertices also does in fewer. So the largest s comes first, and what it
    connects is one node for the next: every pair is looked at once, at the largest s it reaches, and only between components.
    Up to ``one_task_edges`` pairs are one task's work.
    """
    values = sorted(s_values)
    level = F.element_at(F.filter(F.array(*[F.lit(int(s)) for s in values]), lambda s: s <= F.col("w")), -1)
    pairs = materialize(ov.where(F.col("w") >= values[0]).select(level.cast("int").alias("s"), F.col("e1").alias("a"), F.col("e2").alias("b")), "pairs")
    if pairs.count() <= (ONE_TASK_EDGES if one_task_edges is None else one_task_edges):
        found = materialize(pairs.coalesce(1).mapInArrow(_levels_in_one_task, "s int, e bigint, cc bigint"), "found")
        # a level without pairs of its own has the components of the next larger one
        return _with_empty_levels(found, values)
    known, out = None, []
    for s in reversed(values):
        new = pairs.where(F.col("s") == s).select("a", "b")
        if known is not None:
            for end in ("a", "b"):
                new = new.join(known.select(F.col("e").alias(end), F.col("cc").alias("_cc")), end, "left").withColumn(end, F.coalesce("_cc", end)).drop("_cc")
        joined = materialize(connect(new.select(F.lit(s).alias("s"), F.col("a").alias("e"), F.col("b").alias("nb")), one_task_edges).select("e", "cc"), "joined")
        if known is None:
            known = joined
        else:
            moved = known.join(joined.select(F.col("e").alias("cc"), F.col("cc").alias("_to")), "cc", "left").select("e", F.coalesce("_to", "cc").alias("cc"))
            fresh = joined.join(known.select(F.col("cc").alias("e")).distinct(), "e", "left_anti")
            known = materialize(moved.union(fresh.select("e", "cc")), "known")
        out.append(known.select(F.lit(s).cast("int").alias("s"), "e", "cc"))
    discard(pairs)
    return reduce(DataFrame.union, out)


def _with_empty_levels(found: DataFrame, values: list[int]) -> DataFrame:
    have = sorted(r[0] for r in found.select("s").distinct().collect())
    for s in values:
        larger = [x for x in have if x > s]
        if s not in have and larger:
            found = found.union(found.where(F.col("s") == larger[0]).select(F.lit(s).cast("int").alias("s"), "e", "cc"))
    return found


def s_components(inc: DataFrame, ov: DataFrame, s_values: list[int], linked: DataFrame | None = None) -> DataFrame:
    """(s, e, cc): the s-component of every hyperedge with at least s vertices, for all given s.

    cc is the smallest hyperedge of the component; a hyperedge without s-neighbours is its own. ``linked`` may give the components of
    :func:`connect_levels`.
    """
    return with_singletons(inc, connect_levels(ov, s_values) if linked is None else linked, s_values)


def with_singletons(inc: DataFrame, linked: DataFrame, s_values: list[int]) -> DataFrame:
    """Components (s, e, cc) of linked hyperedges and of all others that have s vertices."""
    each = F.explode(F.filter(F.array(*[F.lit(int(s)) for s in s_values]), lambda s: s <= F.col("size")))
    members = overlap.edge_sizes(inc).select(each.alias("s"), "e")
    return members.join(linked, ["s", "e"], "left").select("s", "e", F.coalesce("cc", "e").alias("cc"))


def component_sizes(components: DataFrame, inc: DataFrame | None = None) -> DataFrame:
    """(s, cc, size), and n_vertices, the distinct vertices of the component, if ``inc`` is given."""
    sizes = components.groupBy("s", "cc").agg(F.count(F.lit(1)).alias("size"))
    if inc is None:
        return sizes
    seen = components.join(inc, "e").select("s", "cc", "v").distinct()
    return sizes.join(seen.groupBy("s", "cc").agg(F.count(F.lit(1)).alias("n_vertices")), ["s", "cc"])


def nontrivial_levels(sizes: DataFrame) -> DataFrame:
    """(s, n_components, largest) of every s with a component of more than one hyperedge."""
    return sizes.groupBy("s").agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest")).where("largest > 1")


def component_ratio(components: DataFrame, inc: DataFrame, max_s: int) -> DataFrame:
    """(s, ratio): components, and hyperedges too small for s, over all hyperedges."""
    counts = components.groupBy("s").agg(F.countDistinct("cc").alias("n_cc"), F.count(F.lit(1)).alias("n_members"))
    n = overlap.edge_sizes(inc).agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(1).alias("one")
    return counts.select("*", one).join(F.broadcast(n.select("*", one)), "one").where(F.col("s") <= max_s).select(
        "s", ((F.col("n_cc") + F.col("n") - F.col("n_members")) / F.col("n")).alias("ratio")
    )


def lookup(elements: DataFrame, components: DataFrame, sizes: DataFrame) -> DataFrame:
    """(e, s, cc, size) for ``elements(e, s)``: -1 and 0 where the hyperedge has no component."""
    known = components.join(sizes.select("s", "cc", "size"), ["s", "cc"])
    return elements.join(known, ["s", "e"], "left").select(
        "e", "s", F.coalesce("cc", F.lit(-1).cast("bigint")).alias("cc"), F.coalesce("size", F.lit(0).cast("bigint")).alias("size")
    )
