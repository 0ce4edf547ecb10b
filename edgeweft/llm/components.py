"""Groups of records that are linked directly or indirectly.

Union-find runs inside partitions and leaves only a spanning forest of each. Forests are
merged level by level: the tree edges are hashed by child into partitions of a bounded
number of rows, merged there, and only the edges between vertices that others still hang
from go to the next level. When a level's forest fits one bounded partition, its components
are global, and the labels are handed down again level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import skewed_lookup
from ..session import materialize, shuffle_width
from .blocks import mix

#: Tree edges in one task; about 100 bytes of memory each while merging.
ROWS_PER_TASK = 1_000_000


def _roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Root of each of n vertices after joining all x[i] with y[i]; a root is the smallest of its tree."""
    parent = np.arange(n)
    while len(x):
        px, py = parent[x], parent[y]
        live = px != py
        if not live.any():
            break
        x, y, px, py = x[live], y[live], px[live], py[live]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def forest(s: np.ndarray, a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every vertex of the links with the root of its tree, as arrays s, vertex, root.

    The root is the first vertex in an order that is random but fixed for the level, so that
    chains with ascending ids shrink as fast as any other.
    """
    groups, gi = np.unique(s, return_inverse=True)
    ids, vi = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys, ki = np.unique(np.concatenate([gi, gi]) * len(ids) + vi, return_inverse=True)
    vertex, group = ids[keys % len(ids)], groups[keys // len(ids)]
    order = np.argsort(mix(vertex, level), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    root = _roots(rank[ki[: len(a)]], rank[ki[len(a) :]], len(order))
    return group, vertex, vertex[order[root[rank]]]


def _columns(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    table = pa.Table.from_batches(batches)
    return [table.column(k).to_numpy() for k in range(3)]


def _out(s: np.ndarray, v: np.ndarray, root: np.ndarray, kind: np.ndarray | None = None) -> pa.RecordBatch:
    columns = {"s": pa.array(s.astype(np.int32)), "v": pa.array(v), "root": pa.array(root)}
    if kind is not None:
        columns["own"] = pa.array(kind)
    return pa.RecordBatch.from_pydict(columns)


def _solve(links: DataFrame, level: int, bound: int) -> DataFrame:
    spark = links.sparkSession

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= bound:
                s, v, root = forest(*_columns(held), level)
                yield _out(s[v != root], v[v != root], root[v != root])
                held, n = [], 0
        if n:
            s, v, root = forest(*_columns(held), level)
            yield _out(s[v != root], v[v != root], root[v != root])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield _out(*forest(*_columns(held), level))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            s, a, b = _columns(held)
            gs, v, root = forest(s, a, b, level)
            own = _among(gs, v, s, a)
            keep = own | (v != root)
            yield _out(gs[keep], v[keep], root[keep], own[keep])

    schema = "s int, v bigint, root bigint"
    trees_of = materialize(links.mapInArrow(trees, schema), f"forest{level}")
    rows = trees_of.count()
    if rows <= bound:
        return trees_of.repartition(1).mapInArrow(whole, schema)
    width = shuffle_width(spark, rows, bound // 2)
    joined = materialize(trees_of.repartition(width, "s", "v").mapInArrow(merged, schema + ", own boolean"), f"merged{level}")
    own, free = joined.where("own"), joined.where("not own")
    hold = own.where("v <> root").select("s", F.col("root").alias("v")).union(free.select("s", "v")).union(free.select("s", F.col("root").alias("v"))).distinct()
    hold = materialize(hold, f"hold{level}")
    up = free.select("s", "v", "root").union(own.where("v <> root").join(hold, ["s", "v"], "left_semi").select("s", "v", "root"))
    top = _solve(up, level + 1, bound)
    labels = materialize(hold.join(top.select("s", "v", F.col("root").alias("label")), ["s", "v"], "left").select(
        "s", "v", F.coalesce("label", "v").alias("label")
    ), f"labels{level}")
    rest = own.join(hold, ["s", "v"], "left_anti").select("s", F.col("v").alias("child"), F.col("root").alias("v"))
    below = skewed_lookup(rest, labels, ["s", "v"], "child", how="left")
    return labels.select("s", "v", F.col("label").alias("root")).union(
        below.select("s", F.col("child").alias("v"), F.coalesce("label", "v").alias("root"))
    )


def _among(gs: np.ndarray, v: np.ndarray, s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whether (gs, v) is one of (s, a)."""
    ids, codes = np.unique(np.concatenate([v, a]), return_inverse=True)
    groups, gcodes = np.unique(np.concatenate([gs, s]), return_inverse=True)
    keys = gcodes * len(ids) + codes
    return np.isin(keys[: len(v)], keys[len(v) :])


def linked_groups(links: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Component of every vertex of ``links(s INT, u BIGINT, v BIGINT)``, as (s, e, cc).

    For each ``s`` separately, ``cc`` is the smallest id of all vertices linked with ``e``
    directly or indirectly. A link counts if s is not null and both ids are different,
    non-null and not negative; direction and repetition don't matter. Vertices that occur
    in no such link have no row; empty input gives no rows; other columns are ignored.
    ``rows_per_task`` bounds what one task holds; it changes the number of levels, not the
    result.
    """
    real = links.where("s is not null and u >= 0 and v >= 0 and u <> v").select(
        F.col("s").cast("int").alias("s"), F.col("u").cast("bigint").alias("a"), F.col("v").cast("bigint").alias("b")
    )
    labels = materialize(_solve(real, 0, rows_per_task), "labels")
    least = labels.groupBy("s", "root").agg(F.min("v").alias("cc"))
    return skewed_lookup(labels, least, ["s", "root"], "v").select("s", F.col("v").alias("e"), "cc")
