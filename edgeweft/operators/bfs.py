"""Breadth-first search from many sources at once.

No search leaves the component of its source. Components of up to SMALL_LINKS links are hashed into
partitions together with their sources, and searched there. Larger ones are searched level by
level, for all sources at once, a level being one table. In an undirected graph the neighbours of a level lie in
the level before, in it, or in the next one, so only the last two levels are needed to tell new nodes
from old ones, however many were visited.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import discard, materialize, shuffle_width
from .components import connect
from .skew import skewed_lookup

#: A search ends by itself when a level is empty; this only guards against broken input.
MAX_LEVELS = 10_000
#: Links of a component that one task may hold.
SMALL_LINKS = 50_000
#: Links of one task with many small components.
LINKS_PER_TASK = 500_000


def tagged(adj: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """``adj(s, e, nb)`` with ``cc``, the component of the link, and ``links``, how many it has.

    ``linked(s, e, cc)`` may give the components where they are known already.
    """
    if "links" in adj.columns:
        return adj
    found = materialize(connect(adj), "found") if linked is None else linked
    placed = materialize(adj.select("s", "e", "nb").join(found.select("s", "e", "cc"), ["s", "e"]), "placed")
    counts = materialize(placed.groupBy("s", "cc").agg(F.count(F.lit(1)).alias("links")), "links")
    # a giant component is one key: its rows are spread
    both = skewed_lookup(placed, counts, ["s", "cc"], "e", counts=counts.select("s", "cc", F.col("links").alias("_rows")))
    out = materialize(both.select("s", "e", "nb", "cc", "links"), "tagged")
    discard(placed)
    return out


def _near(nodes: np.ndarray, others: np.ndarray) -> dict[int, list[int]]:
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in zip(nodes.tolist(), others.tolist()):
        near[a].append(b)
    return near


def _search(near: dict, src, max_depth: int | None, max_reached: int | None) -> dict:
    seen, level, depth = {src: 0}, [src], 0
    while level and (max_depth is None or depth < max_depth) and (max_reached is None or len(seen) <= max_reached):
        depth += 1
        fresh = []
        for x in level:
            for y in near.get(x, ()):
                if y not in seen:
                    seen[y] = depth
                    fresh.append(y)
        level = fresh
    return seen


def _by_component(adj: DataFrame, sources: DataFrame, answer, schema: str) -> DataFrame:
    """``answer(s, near, rows)`` for the sources (s, e, x, y) of each partition, which holds their whole components."""
    small = adj.where(F.col("links") <= SMALL_LINKS)
    placed = small.groupBy("s", "e").agg(F.first("cc").alias("cc"))
    asked = sources.join(placed, ["s", "e"], "left")
    none = F.lit(None).cast("bigint")
    rows = small.select("s", "cc", "e", "nb", none.alias("x"), none.alias("y")).union(asked.select("s", F.coalesce("cc", "e"), "e", none, "x", "y"))
    width = shuffle_width(adj.sparkSession, adj.count(), LINKS_PER_TASK)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        s, e = table.column("s").to_numpy(), table.column("e").to_numpy()
        link = table.column("nb").is_valid().to_numpy()
        nb = table.column("nb").fill_null(0).to_numpy()
        x, y = table.column("x").fill_null(0).to_numpy(), table.column("y").fill_null(0).to_numpy()
        for level in np.unique(s):
            near = _near(e[link & (s == level)], nb[link & (s == level)])
            mine = ~link & (s == level)
            yield from answer(int(level), near, list(zip(e[mine].tolist(), x[mine].tolist(), y[mine].tolist())))

    named = rows.toDF("s", "cc", "e", "nb", "x", "y").select(F.col("s").cast("int").alias("s"), "cc", "e", "nb", "x", "y")
    return named.repartition(width, "s", "cc").mapInArrow(work, schema)


def _small_distances(adj: DataFrame, sources: DataFrame, max_depth: int | None, max_reached: int | None) -> DataFrame:
    def answer(s: int, near: dict, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for src, _, _ in rows:
            out += [(src, e, d) for e, d in _search(near, src, max_depth, max_reached).items()]
            if len(out) > 100_000:
                yield batch(s, out)
                out = []
        if out:
            yield batch(s, out)

    def batch(s: int, out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        src, e, d = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array([s] * len(out), pa.int32()), pa.array(src, pa.int64()), pa.array(e, pa.int64()), pa.array(d, pa.int32())], names=["s", "src", "e", "dist"])

    none = F.lit(None).cast("bigint")
    asked = sources.select("s", F.col("src").alias("e")).distinct().select("s", "e", none.alias("x"), none.alias("y"))
    return _by_component(adj, asked, answer, "s int, src bigint, e bigint, dist int")


def _split(adj: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Tagged links, sources in small components, and those in large ones if there are any."""
    adj = tagged(adj)
    large = adj.where(F.col("links") > SMALL_LINKS)
    if large.isEmpty():
        return adj, sources, None
    nodes = large.select("s", F.col("e").alias("src")).distinct()
    return adj, sources.join(nodes, ["s", "src"], "left_anti"), sources.join(nodes, ["s", "src"], "left_semi")


def distances(adj: DataFrame, sources: DataFrame, max_depth: int | None = None, targets: DataFrame | None = None, max_reached: int | None = None) -> DataFrame:
    """(s, src, e, dist) of nodes reached from ``sources(s, src)`` in ``adj(s, e, nb)``, the source itself with 0.

    With ``max_depth`` farther nodes are left out. With ``max_reached`` a source is followed until it has
    reached that many other nodes; a level is always finished. With ``targets(s, src, e)`` a source may be
    given up once it has reached all its targets. Sources that aren't in the graph reach themselves.
    """
    adj, few, many = _split(adj, sources.select("s", "src"))
    found = _small_distances(adj, few, max_depth, max_reached)
    if many is None:
        return found
    return found.union(level_distances(adj.where(F.col("links") > SMALL_LINKS), many, max_depth, targets, max_reached))


def level_distances(adj: DataFrame, sources: DataFrame, max_depth: int | None = None, targets: DataFrame | None = None, max_reached: int | None = None) -> DataFrame:
    """The same for components of any size, level by level."""
    level = materialize(sources.select("s", "src", F.col("src").alias("e")).distinct(), "level")
    levels, depth, before = [level], 0, None
    left = materialize(targets.select("s", "src", "e").distinct().where("src <> e"), "left") if targets is not None else None
    while max_depth is None or depth < max_depth:
        front = level
        if left is not None:
            front = level.join(left.select("s", "src").distinct(), ["s", "src"], "left_semi")
        if max_reached is not None and depth:
            counts = reduce(DataFrame.union, levels[1:]).groupBy("s", "src").agg(F.count(F.lit(1)).alias("n"))
            front = front.join(counts.where(F.col("n") >= max_reached).select("s", "src"), ["s", "src"], "left_anti")
        found = front.join(adj, ["s", "e"]).select("s", "src", F.col("nb").alias("e")).distinct()
        old = level if before is None else level.union(before)
        fresh = materialize(found.join(old, ["s", "src", "e"], "left_anti"), "level")
        if fresh.isEmpty():
            break
        if depth >= MAX_LEVELS:
            raise RuntimeError(f"nodes farther than {MAX_LEVELS} levels are left")
        before, level, depth = level, fresh, depth + 1
        levels.append(level)
        if left is not None:
            left = materialize(left.join(level, ["s", "src", "e"], "left_anti"), "left")
    return reduce(DataFrame.union, [x.select("s", "src", "e", F.lit(d).alias("dist")) for d, x in enumerate(levels)])


def _level_labelled(adj: DataFrame, sources: DataFrame, labels: DataFrame, wanted: DataFrame, max_reached: int) -> DataFrame:
    level = materialize(sources.select("s", "src", F.col("src").alias("e")).distinct(), "level")
    marked = labels.select("e", F.lower("label").alias("label")).distinct()
    looks_for = wanted.select("src", F.lower("label").alias("label")).distinct()
    hits, before, depth = [], None, 0
    counts = None
    while True:
        front = level if counts is None else level.join(counts.where(F.col("n") >= max_reached).select("s", "src"), ["s", "src"], "left_anti")
        found = front.join(adj, ["s", "e"]).select("s", "src", F.col("nb").alias("e")).distinct()
        old = level if before is None else level.union(before)
        fresh = materialize(found.join(old, ["s", "src", "e"], "left_anti"), "level")
        if fresh.isEmpty():
            break
        if depth >= MAX_LEVELS:
            raise RuntimeError(f"nodes farther than {MAX_LEVELS} levels are left")
        before, level, depth = level, fresh, depth + 1
        hits.append(materialize(level.join(marked, "e").join(looks_for, ["src", "label"]).select("s", "src", "e", F.lit(depth).alias("dist")).distinct(), "hits"))
        counts = reduce(DataFrame.union, hits).groupBy("s", "src").agg(F.count(F.lit(1)).alias("n"))
    if not hits:
        return level.select("s", "src", "e", F.lit(0).alias("dist")).where("false")
    return reduce(DataFrame.union, hits)


def nearest_labelled(adj: DataFrame, sources: DataFrame, labels: DataFrame, wanted: DataFrame, max_reached: int) -> DataFrame:
    """Labelled nodes around each source: (s, src, e, dist), without the source.

    ``labels(e, label)`` are compared without case; ``wanted(src, label)`` says what each source looks for. A source is followed until
    it has reached at least ``max_reached`` such nodes; a level is always finished, so ties are complete.
    """
    adj, few, many = _split(adj, sources.select("s", "src"))
    marked = labels.select("e", F.lower("label").alias("label")).distinct()
    looks_for = wanted.select("src", F.lower("label").alias("label")).distinct()
    found = _small_distances(adj, few, None, None).where("dist > 0").join(marked, "e").join(looks_for, ["src", "label"]).select("s", "src", "e", "dist").distinct()
    # levels that begin with fewer than max_reached nodes
    before = F.count(F.lit(1)).over(Window.partitionBy("s", "src").orderBy("dist").rangeBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("before", before).where(F.col("before") < max_reached).drop("before")
    if many is None:
        return found
    return found.union(_level_labelled(adj.where(F.col("links") > SMALL_LINKS).select("s", "e", "nb"), many, labels, wanted, max_reached))


def shortest_path_counts(adj: DataFrame, reached: DataFrame) -> DataFrame:
    """(s, src, e, parent): every predecessor of each reached node on a shortest path, from ``distances``."""
    up = reached.select("s", "src", F.col("e").alias("parent"), (F.col("dist") + 1).alias("dist"))
    back = adj.select("s", "e", F.col("nb").alias("parent"))
    return reached.where("dist > 0").join(back, ["s", "e"]).join(up, ["s", "src", "parent", "dist"]).select("s", "src", "e", "parent")


def shortest_paths(adj: DataFrame, pairs: DataFrame, all_paths: bool) -> DataFrame:
    """(s, p, q, path ARRAY<BIGINT>) for ``pairs(s, p, q)``: paths of hyperedges from p to q.

    With ``all_paths`` every shortest path has a row, else the one whose reverse is smallest (from q on,
    always the smallest predecessor). A pair that isn't connected has no row; p = q gives [p].
    """
    adj, few, many = _split(adj, pairs.select("s", F.col("p").alias("src"), "q").distinct())

    def answer(s: int, near: dict, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        by_source: dict[int, list[int]] = defaultdict(list)
        for p, q, _ in rows:
            by_source[p].append(q)
        for p, ends in by_source.items():
            seen = _search(near, p, None, None)
            out = []
            for q in ends:
                if q not in seen:
                    continue
                todo = [[q]]
                while todo:
                    path = todo.pop()
                    if path[0] == p:
                        out.append((p, q, path))
                        continue
                    before = sorted(x for x in near[path[0]] if seen[x] == seen[path[0]] - 1)
                    todo += [[x, *path] for x in (before if all_paths else before[:1])]
            if out:
                a, b, paths = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(out), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], names=["s", "p", "q", "path"])

    asked = few.select("s", F.col("src").alias("e"), F.col("q").alias("x"), F.lit(None).cast("bigint").alias("y"))
    found = _by_component(adj, asked, answer, "s int, p bigint, q bigint, path array<bigint>")
    if many is None:
        return found
    return found.union(_level_paths(adj.where(F.col("links") > SMALL_LINKS), many.select("s", F.col("src").alias("p"), "q"), all_paths))


def _level_paths(adj: DataFrame, pairs: DataFrame, all_paths: bool) -> DataFrame:
    asked = materialize(pairs.select("s", "p", "q").distinct(), "asked")
    reached = materialize(level_distances(adj, asked.select("s", F.col("p").alias("src")), targets=asked.select("s", F.col("p").alias("src"), F.col("q").alias("e"))), "reached")
    parents = shortest_path_counts(adj, reached)
    if not all_paths:
        parents = parents.groupBy("s", "src", "e").agg(F.min("parent").alias("parent"))
    parents = materialize(parents, "parents")
    ends = reached.select("s", F.col("src").alias("p"), F.col("e").alias("q"), "dist")
    open_paths = asked.join(ends, ["s", "p", "q"]).select("s", "p", "q", F.array("q").alias("path"), F.col("q").alias("at"))
    done = [materialize(open_paths.where("at = p").select("s", "p", "q", "path"), "paths")]
    level = materialize(open_paths.where("at <> p"), "open")
    step = parents.select("s", F.col("src").alias("p"), F.col("e").alias("at"), "parent")
    while not level.isEmpty():
        longer = level.join(step, ["s", "p", "at"]).select("s", "p", "q", F.concat(F.array("parent"), "path").alias("path"), F.col("parent").alias("at"))
        longer = materialize(longer, "open")
        done.append(longer.where("at = p").select("s", "p", "q", "path"))
        level = longer.where("at <> p")
    return reduce(DataFrame.union, done)


def level_counts(reached: DataFrame) -> DataFrame:
    """(s, src, dist, n): nodes of each level, and ``upto``, those up to it."""
    counts = reached.groupBy("s", "src", "dist").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("s", "src").orderBy("dist").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("n").over(over))
