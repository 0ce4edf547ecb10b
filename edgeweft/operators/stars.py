"""s-connected components from incidences alone, where listing all overlaps would cost far more than the components hold.

All hyperedges of a vertex are connected at s = 1, and all hyperedges of a pair of vertices at s = 2: a star over them says as
much as all their pairs. Overlaps are only counted from s = 3 on, among hyperedges that share a pair of vertices.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize, shuffle_width
from . import components, overlap
from .skew import skewed_lookup

#: Incidences, or pairs of vertices, that a Python worker holds at once; about 100 bytes of memory each.
ROWS_PER_TASK = 1_000_000
#: Up to this many vertices one task joins the trees of all others.
ONE_TASK_VERTICES = 4_000_000
#: Pairs of vertices are listed if there are at most so many for each incidence, and no hyperedge has more vertices than MOST_VERTICES.
PAIRS_EACH, MOST_VERTICES = 20, 2_000
#: Hyperedges or nodes in one batch of a Python worker's output.
BATCH = 50_000

Batches = Iterator[pa.RecordBatch]


def _ends(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before, and the end."""
    new = np.zeros(len(columns[0]) + 1, bool)
    new[[0, -1]] = True
    for x in columns:
        new[1:-1] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _collected(batches: Batches) -> Batches:
    """(e, vertices) of a partition that holds whole hyperedges as rows (e, v)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    e, v = (pa.Table.from_batches(held).column(k).to_numpy() for k in range(2))
    held.clear()
    order = np.lexsort((v, e))
    e, v = e[order], v[order]
    kept = _ends(e, v)[:-1]
    e, v = e[kept], v[kept]
    at = _ends(e)
    for k in range(0, len(at) - 1, BATCH):
        part = at[k : k + BATCH + 1]
        sets = pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(v[part[0] : part[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(e[part[:-1]]), sets], ["e", "vertices"])


def sets_of(rows: DataFrame) -> DataFrame:
    """(e, vertices): the distinct sorted vertices of each hyperedge of ``rows(e, v)``, by one shuffle; rows may repeat and hold nulls."""
    real = rows.select("e", "v").where("e is not null and v is not null")
    width = shuffle_width(rows.sparkSession, real.count(), ROWS_PER_TASK)
    return materialize(real.repartition(width, "e").mapInArrow(_collected, "e bigint, vertices array<bigint>"), "sets")


def _flat(batches: Batches, weight: Callable[[np.ndarray], np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hyperedges, where their vertices begin and end, and these vertices, cut so that the weights (by size) of a part add up to about ``most``."""

    def joined(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, sizes, v = (np.concatenate(x) for x in zip(*held, strict=True))
        return e, np.concatenate([[0], np.cumsum(sizes)]), v

    held, total = [], 0
    for batch in batches:
        e, sets = batch.column(0).to_numpy(), batch.column(1)
        v, sizes = sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy())
        at, upto = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(weight(sizes.astype(np.int64)))
        begin = 0
        while begin < len(e):
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + most - total, "right")))
            held.append((e[begin:end], sizes[begin:end], v[at[begin] : at[end]]))
            total += int(upto[end - 1] - before)
            begin = end
            if total >= most or begin < len(e):
                yield joined(held)
                held, total = [], 0
    if held:
        yield joined(held)


# s = 1


def _trees(most: int) -> Callable[[Batches], Batches]:
    """(v, root, m): the tree of every vertex of a part of the hyperedges, and the smallest hyperedge of the tree."""

    def trees(batches: Batches) -> Batches:
        for e, at, v in _flat(batches, lambda sizes: sizes, most):
            nodes, of = np.unique(v, return_inverse=True)
            first = of[at[:-1]]
            up = components._hook(np.arange(len(nodes)), of, np.repeat(first, np.diff(at)))
            yield _labelled(nodes, up, up[first], e)

    return trees


def _labelled(nodes: np.ndarray, up: np.ndarray, roots: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, e)
    return pa.RecordBatch.from_pydict({"v": nodes, "root": nodes[up], "m": least[up]})


def _joined_trees(most: int) -> Callable[[Batches], Batches]:
    """The same of all trees, in one task: trees are added in parts, and only one row for each vertex is kept."""

    def joined(batches: Batches) -> Batches:
        def add(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            v, root, m = (pa.Table.from_batches(parts).column(k).to_numpy() for k in range(3))
            nodes, of = np.unique(np.concatenate([v, root]), return_inverse=True)
            up = components._hook(np.arange(len(nodes)), of[: len(v)], of[len(v) :])
            return _labelled(nodes, up, up[of[: len(v)]], m)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                held, n = [add(held)], 0
        if held:
            whole = add(held)
            for k in range(0, whole.num_rows, BATCH):
                yield whole.slice(k, BATCH)

    return joined


def vertex_components(sets: DataFrame, one_task_vertices: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """(v, cc): the smallest hyperedge of the 1-component of every vertex of ``sets(e, vertices)``.

    Union-find over the vertices runs inside the tasks and leaves a tree each. Up to ``one_task_vertices`` vertices, ONE_TASK_VERTICES if not
    given, the trees are joined in one task, else by the rounds of :func:`components.connect`.
    """
    schema, most = "v bigint, root bigint, m bigint", rows_per_task or 2 * ROWS_PER_TASK
    trees = materialize(sets.mapInArrow(_trees(most), schema), "trees")
    n = trees.agg(F.approx_count_distinct("v")).first()[0]
    if n <= (ONE_TASK_VERTICES if one_task_vertices is None else one_task_vertices):
        found = materialize(trees.coalesce(1).mapInArrow(_joined_trees(most), schema).select("v", F.col("m").alias("cc")), "vertex_components")
        discard(trees)
        return found
    linked = components.connect(trees.select(F.lit(1).alias("s"), F.col("v").alias("e"), F.col("root").alias("nb")), 0)
    linked = materialize(linked.select(F.col("e").alias("v"), F.col("cc").alias("top")), "linked")
    known = trees.join(linked, "v", "left").select("v", F.coalesce("top", "v").alias("top"), "m")
    least = known.groupBy("top").agg(F.min("m").alias("cc"))
    found = materialize(skewed_lookup(known.select("v", "top").distinct(), least, ["top"], "v").select("v", "cc"), "vertex_components")
    discard(trees)
    return found


# s = 2 and more


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, all second bytes and so on: equal ones stand together, so that the shuffle's codec takes them away."""
    return np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(len(x), 8).T.tobytes()


def _of_planes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, e = (np.ascontiguousarray(x.T).view(np.int64).ravel() for x in np.frombuffer(blob, np.uint8).reshape(3, 8, -1))
    return np.cumsum(a), b, e


def _pair_blocks(buckets: int, most: int) -> Callable[[Batches], Batches]:
    """(k, pairs): all pairs of vertices of each hyperedge with it, in blocks by a hash of the pair."""

    def blocks(batches: Batches) -> Batches:
        for e, at, v in _flat(batches, lambda sizes: sizes * (sizes - 1) // 2, most):
            later = np.repeat(at[1:], np.diff(at)) - np.arange(len(v)) - 1
            left = np.repeat(np.arange(len(v)), later)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
            a, b, e = v[left], v[right], np.repeat(np.repeat(e, np.diff(at)), later)
            h = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            k = ((h ^ h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((a, k))
            a, b, e, k = a[order], b[order], e[order], k[order]
            ends = _ends(k) if len(k) else np.zeros(1, np.int64)
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                blob = _planes(np.diff(a[i:j], prepend=0)) + _planes(b[i:j]) + _planes(e[i:j])
                yield pa.RecordBatch.from_arrays([pa.array([k[i]], pa.int32()), pa.array([blob], pa.binary())], ["k", "pairs"])

    return blocks


def _repeated(batches: Batches) -> Batches:
    """(v1, v2, e, least) of the pairs that more than one hyperedge holds; least is the smallest of these."""
    held = defaultdict(list)
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[k].append(blob)
    for k in list(held):
        a, b, e = (np.concatenate(x) for x in zip(*map(_of_planes, held.pop(k)), strict=True))
        order = np.lexsort((b, a))
        a, b, e = a[order], b[order], e[order]
        ends = _ends(a, b)
        sizes = np.diff(ends)
        least, kept = np.repeat(np.minimum.reduceat(e, ends[:-1]), sizes), np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_pydict({"v1": a[kept], "v2": b[kept], "e": e[kept], "least": least[kept]})


def shared_pairs(sets: DataFrame, n_pairs: int, rows_per_task: int | None = None) -> DataFrame:
    """(v1, v2, e, least): every pair of vertices that several hyperedges hold, with each of these and the smallest.

    ``n_pairs`` is the number of pairs of vertices within hyperedges. They are shuffled as blocks of 24 bytes a pair, most of them zeros.
    """
    most = rows_per_task or ROWS_PER_TASK
    width = shuffle_width(sets.sparkSession, n_pairs, most)
    blocks = sets.where(F.size("vertices") > 1).mapInArrow(_pair_blocks(2 * width, most), "k int, pairs binary")
    return materialize(blocks.repartition(width, "k").mapInArrow(_repeated, "v1 bigint, v2 bigint, e bigint, least bigint"), "shared_pairs")


def _linked(sets: DataFrame, values: list[int], rows_per_task: int | None) -> list[DataFrame]:
    """(s, e, cc) of the hyperedges with s-neighbours, for all given s from 2 on."""
    n = F.size("vertices").cast("bigint")
    largest, incidences, n_pairs = sets.agg(F.max(n), F.sum(n), F.sum(n * (n - 1) / 2).cast("bigint")).first()
    if not n_pairs:
        return []
    if largest > MOST_VERTICES or n_pairs > PAIRS_EACH * incidences:
        inc = sets.select("e", F.explode("vertices").alias("v"))
        return [components.connect_levels(materialize(overlap.overlaps(inc, values[0]), "ov"), values)]
    shared = shared_pairs(sets, n_pairs, rows_per_task)
    found = [components.connect(shared.select(F.lit(2).alias("s"), "e", F.col("least").alias("nb")))] if values[0] == 2 else []
    if more := [s for s in values if s > 2]:
        # the common vertices of two hyperedges with more than one are all in pairs that both hold
        inc = shared.select("e", F.explode(F.array("v1", "v2")).alias("v")).distinct()
        found.append(components.connect_levels(overlap.overlaps(materialize(inc, "inc"), more[0]), more))
    return found


def s_components(rows: DataFrame, s_values: list[int], one_task_vertices: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """(s, e, cc) as :func:`components.s_components` gives it, without the overlaps: rows (e, v) may repeat, those with a null don't count.

    Pairs of vertices within hyperedges are listed for s from 2 on; where hyperedges are so large that these are too many, overlaps of at least
    the smallest such s are counted instead. ``rows_per_task`` bounds what one task holds; it doesn't change the result.
    """
    values = sorted(set(s_values))
    sets = sets_of(rows)
    members = sets.select("e", F.size("vertices").alias("size"), F.col("vertices")[0].alias("v"))
    if values[0] == 1:
        members = members.join(vertex_components(sets, one_task_vertices, rows_per_task), "v").select("e", "size", F.col("cc").alias("first"))
    else:
        members = members.select("e", "size", F.col("e").alias("first"))
    first, level = F.when(F.col("s") == 1, F.col("first")), F.col("e")
    if found := _linked(sets, [s for s in values if s > 1], rows_per_task) if values[-1] > 1 else []:
        at = reduce(DataFrame.union, found).groupBy("e").agg(F.map_from_entries(F.collect_list(F.struct("s", "cc"))).alias("at"))
        members = members.join(materialize(at, "linked"), "e", "left")
        level = F.coalesce(F.try_element_at("at", F.col("s")), "e")
    each = F.explode(F.filter(F.array(*[F.lit(int(s)) for s in values]), lambda s: s <= F.col("size")))
    return members.withColumn("s", each).select("s", "e", first.otherwise(level).alias("cc"))
