"""Labels for exact distances: highway labels, pruned hub labels and bit-parallel labels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import bfs
from .landmarks import numbered


def rank_by_degree(adj: DataFrame, larger_id_first: bool = False) -> DataFrame:
    """(s, e, rank): nodes of each s by descending degree, ties by the smaller id, or the larger. Ranks are places in a range sort."""
    tie = -F.col("e") if larger_id_first else F.col("e")
    degree = adj.groupBy("s", "e").agg((-F.count(F.lit(1))).alias("d")).withColumn("t", tie)
    return numbered(degree, "s", ["d", "t"]).select("s", "e", F.col("number").alias("rank"))


def without_nodes(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph without ``nodes(s, e)``."""
    kept = adj.join(nodes.select("s", "e"), ["s", "e"], "left_anti")
    return kept.join(nodes.select("s", F.col("e").alias("nb")), ["s", "nb"], "left_anti").select("s", "e", "nb")


def highway_labels(adj: DataFrame, landmarks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (s, e, hub, d) and highway (s, hub, hub2, h) of ``landmarks(s, landmark)``.

    A label is kept only if no other landmark lies on a shortest path to it.
    """
    hubs = materialize(landmarks.select("s", F.col("landmark").alias("hub")).distinct(), "hubs")
    full = bfs.distances(adj, hubs.select("s", F.col("hub").alias("src"))).select("s", F.col("src").alias("hub"), "e", F.col("dist").alias("d"))
    full = materialize(full, "full")
    highway = materialize(full.join(hubs.select("s", F.col("hub").alias("e")), ["s", "e"], "left_semi").select("s", "hub", F.col("e").alias("hub2"), F.col("d").alias("h")), "highway")
    via = highway.where("hub <> hub2").join(full.select("s", F.col("hub").alias("hub2"), "e", F.col("d").alias("d2")), ["s", "hub2"])
    covered = via.join(full, ["s", "hub", "e"]).where("h + d2 = d").select("s", "hub", "e").distinct()
    return full.join(covered, ["s", "hub", "e"], "left_anti").select("s", "e", "hub", "d"), highway


def highway_bounds(pairs: DataFrame, labels: DataFrame, highway: DataFrame) -> DataFrame:
    """(s, p, q, ub) for ``pairs(s, p, q)``: the shortest way over landmarks; pairs without one have no row."""
    asked = pairs.select("s", "p", "q").distinct()
    l1 = labels.select("s", F.col("e").alias("p"), "hub", F.col("d").alias("d1"))
    l2 = labels.select("s", F.col("e").alias("q"), F.col("hub").alias("hub2"), F.col("d").alias("d2"))
    met = asked.join(l1, ["s", "p"]).join(highway, ["s", "hub"]).join(l2, ["s", "q", "hub2"])
    return met.groupBy("s", "p", "q").agg(F.min(F.col("d1") + F.col("h") + F.col("d2")).alias("ub"))


def highway_distances(adj: DataFrame, pairs: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(s, p, q, d), exact: the bound over landmarks, or a shorter way in the graph without them."""
    labels, highway = highway_labels(adj, landmarks)
    return around_highway(labels, highway, without_nodes(adj, landmarks.select("s", F.col("landmark").alias("e"))), pairs)


def around_highway(labels: DataFrame, highway: DataFrame, rest: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same from labels, highway and the graph without landmarks."""
    asked = materialize(pairs.select("s", "p", "q").distinct(), "asked")
    upper = materialize(highway_bounds(asked, labels, highway), "upper")
    rest = materialize(rest, "rest")
    sources, targets = asked.select("s", F.col("p").alias("src")), asked.select("s", F.col("p").alias("src"), F.col("q").alias("e"))
    # a way around the landmarks must be shorter than the bound, so no search goes deeper than the largest
    deepest = upper.agg(F.max("ub")).first()[0]
    loose = asked.join(upper, ["s", "p", "q"], "left_anti").where("p <> q").isEmpty()
    around = bfs.distances(rest, sources, targets=targets, max_depth=deepest if loose and deepest else None)
    found = around.select("s", F.col("src").alias("p"), F.col("e").alias("q"), F.col("dist").alias("around"))
    both = asked.join(upper, ["s", "p", "q"], "left").join(found, ["s", "p", "q"], "left")
    d = F.when(F.col("p") == F.col("q"), F.lit(0)).otherwise(F.least("ub", "around"))
    return both.select("s", "p", "q", d.alias("d")).where("d is not null")


def _pruned(near: dict[int, list[int]], rank: dict[int, int]) -> dict[int, dict[int, int]]:
    """Hub labels of each node: a search from every node in rank order, cut where earlier hubs give a way as short."""
    labels: dict[int, dict[int, int]] = {x: {} for x in near}
    for hub in sorted(near, key=rank.__getitem__):
        mine, seen, level, d = labels[hub], {hub}, [hub], 0
        while level:
            fresh = []
            for x in level:
                theirs = labels[x]
                few, many = (theirs, mine) if len(theirs) < len(mine) else (mine, theirs)
                if any(via in many and many[via] + dv <= d for via, dv in few.items()):
                    continue
                theirs[hub] = d
                for y in near[x]:
                    if y not in seen:
                        seen.add(y)
                        fresh.append(y)
            level, d = fresh, d + 1
    return labels


def hub_labels(adj: DataFrame, rank: DataFrame | None = None, batch: int = 16, growth: int = 16) -> DataFrame:
    """(s, e, hub, d): labels by which the distance of any two nodes is the least d1 + d2 over a common hub.

    A node is a hub of another if no node of higher rank lies on a shortest path between them; the node of
    highest rank on a shortest path is then a common hub of its ends. Ranks (s, e, rank) are by degree if not given.

    Components of up to bfs.SMALL_LINKS links are hashed into partitions and searched there, from every node in rank order, and cut where
    the labels so far give a way as short. In larger ones the hubs are taken in batches by rank, of ``batch`` nodes of each s and then ``growth`` times as many;
    all hubs of a batch search at once, level by level, and each level is cut by the labels of the batches before.
    """
    ranks = materialize((rank_by_degree(adj) if rank is None else rank).select("s", "e", "rank"), "rank")
    adj = bfs.tagged(adj)
    none = F.lit(None).cast("bigint")

    def answer(s: int, near: dict, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        place = {e: r for e, r, _ in rows}
        found = [(e, hub, d) for e, mine in _pruned(near, place).items() for hub, d in mine.items()]
        for i in range(0, len(found), 100_000):
            e, hub, d = zip(*found[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(e), pa.int32()), pa.array(e, pa.int64()), pa.array(hub, pa.int64()), pa.array(d, pa.int32())], names=["s", "e", "hub", "d"])

    small = adj.where(F.col("links") <= bfs.SMALL_LINKS)
    few = ranks.join(small.select("s", "e").distinct(), ["s", "e"], "left_semi").select("s", "e", F.col("rank").cast("bigint").alias("x"), none.alias("y"))
    out = bfs._by_component(adj, few, answer, "s int, e bigint, hub bigint, d int")
    large = adj.where(F.col("links") > bfs.SMALL_LINKS)
    if large.isEmpty():
        return out
    return out.unionByName(hub_labels_in_batches(large.select("s", "e", "nb"), ranks, batch, growth))


def hub_labels_in_batches(adj: DataFrame, rank: DataFrame, batch: int = 16, growth: int = 16) -> DataFrame:
    """The same for components of any size."""
    here = rank.join(adj.select("s", "e").distinct(), ["s", "e"], "left_semi")
    rank = materialize(numbered(here.select("s", "e", "rank"), "s", ["rank", "e"]).select("s", "e", F.col("number").alias("rank")), "rank")
    down = adj.join(rank.select("s", F.col("e").alias("nb"), F.col("rank").alias("r2")), ["s", "nb"])
    ranked = materialize(down.select("s", "e", "nb", "r2"), "down")
    most = rank.agg(F.max("rank")).first()[0] or 0
    labels, done = None, 0
    while done < most:
        hubs = rank.where((F.col("rank") > done) & (F.col("rank") <= done + batch))
        level = materialize(hubs.select("s", F.col("e").alias("hub"), F.col("rank").alias("top"), "e"), "level")
        levels, before = [], None
        while not level.isEmpty():
            d = len(levels)
            if labels is not None and d:
                # cut where an earlier hub gives a way as short; such nodes aren't searched from
                x = level.select("s", "hub", "e").join(labels.select("s", F.col("e").alias("hub"), F.col("hub").alias("via"), F.col("d").alias("d1")), ["s", "hub"])
                y = labels.select("s", "e", F.col("hub").alias("via"), F.col("d").alias("d2"))
                cut = x.join(y, ["s", "e", "via"]).where(F.col("d1") + F.col("d2") <= d).select("s", "hub", "e").distinct()
                kept = materialize(level.join(cut, ["s", "hub", "e"], "left_anti"), "kept")
            else:
                kept = level
            levels.append(kept)
            found = kept.join(ranked, ["s", "e"]).where("r2 > top").select("s", "hub", "top", F.col("nb").alias("e")).distinct()
            old = level if before is None else level.unionByName(before)
            before, level = level, materialize(found.join(old.select("s", "hub", "e"), ["s", "hub", "e"], "left_anti"), "level")
        full = materialize(reduce(DataFrame.union, [x.select("s", "e", "hub", "top", F.lit(d).alias("d")) for d, x in enumerate(levels)]).groupBy("s", "e", "hub", "top").agg(F.min("d").alias("d")), "hubs")
        # within the batch: a hub of higher rank with a way as short
        y = full.select("s", F.col("e").alias("hub"), F.col("hub").alias("via"), F.col("top").alias("t"), F.col("d").alias("dv"))
        z = full.select("s", "e", F.col("hub").alias("via"), F.col("d").alias("de"))
        worse = full.join(y.where("hub <> via"), ["s", "hub"]).join(z, ["s", "e", "via"]).where("t < top and dv + de <= d").select("s", "e", "hub").distinct()
        fresh = full.join(worse, ["s", "e", "hub"], "left_anti").select("s", "e", "hub", "d")
        labels = materialize(fresh if labels is None else labels.union(fresh), "labels")
        done, batch = done + batch, batch * growth
    return labels.select("s", "e", "hub", F.col("d").cast("int").alias("d"))


def hub_distances(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(s, p, q, d) for ``pairs(s, p, q)`` by merging hub labels; pairs that aren't connected have no row."""
    asked = pairs.select("s", "p", "q").distinct()
    l1 = labels.select("s", F.col("e").alias("p"), "hub", F.col("d").alias("d1"))
    l2 = labels.select("s", F.col("e").alias("q"), "hub", F.col("d").alias("d2"))
    met = asked.join(l1, ["s", "p"]).join(l2, ["s", "q", "hub"])
    return met.groupBy("s", "p", "q").agg(F.min(F.col("d1") + F.col("d2")).alias("d"))


def bit_parallel_labels(adj: DataFrame, roots: int = 4, width: int = 63) -> DataFrame:
    """(s, root, e, d, nearer, level): distances from ``roots`` roots of each s, and of up to ``width`` neighbours of each as bits.

    Roots are taken by rank, each with its neighbours of highest rank; no node is used twice. Bit i of ``nearer`` says that neighbour i
    is nearer to e than the root, bit i of ``level`` that it is as near.
    """
    adj = bfs.tagged(adj)
    ranks = materialize(rank_by_degree(adj), "rank")
    used, chosen = None, []
    for _ in range(roots):
        free = ranks if used is None else ranks.join(used, ["s", "e"], "left_anti")
        root = materialize(free.groupBy("s").agg(F.min_by("e", "rank").alias("root")), "root")
        near = adj.select("s", F.col("e").alias("root"), F.col("nb").alias("e")).join(root, ["s", "root"], "left_semi").join(free, ["s", "e"])
        bit = F.row_number().over(Window.partitionBy("s").orderBy("rank", "e")) - 1
        near = near.withColumn("bit", bit).where(F.col("bit") < width).select("s", "root", "e", "bit")
        chosen.append(materialize(near.unionByName(root.select("s", "root", F.col("root").alias("e"), F.lit(-1).alias("bit"))), "chosen"))
        used = reduce(DataFrame.union, [x.select("s", "e") for x in chosen])
    sources = reduce(DataFrame.union, chosen)
    found = materialize(bfs.distances(adj, sources.select("s", F.col("e").alias("src")).distinct()), "found")
    each = found.join(sources.select("s", "root", F.col("e").alias("src"), "bit"), ["s", "src"])
    top = each.where("bit < 0").select("s", "root", "e", F.col("dist").alias("d"))
    bits = each.where("bit >= 0").select("s", "root", "e", "dist", F.expr("shiftleft(1L, bit)").alias("m")).join(top, ["s", "root", "e"])
    sides = bits.groupBy("s", "root", "e").agg(
        F.bit_or(F.when(F.col("dist") < F.col("d"), F.col("m")).otherwise(F.lit(0))).alias("nearer"), F.bit_or(F.when(F.col("dist") == F.col("d"), F.col("m")).otherwise(F.lit(0))).alias("level")
    )
    none = F.lit(0).cast("bigint")
    return top.join(sides, ["s", "root", "e"], "left").select("s", "root", "e", "d", F.coalesce("nearer", none).alias("nearer"), F.coalesce("level", none).alias("level"))


def bit_parallel_bounds(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(s, p, q, ub) for ``pairs(s, p, q)``: the shortest way over a root or one of its marked neighbours; pairs without one have no row."""
    asked = pairs.select("s", "p", "q").distinct()
    l1 = labels.select("s", "root", F.col("e").alias("p"), F.col("d").alias("d1"), F.col("nearer").alias("n1"), F.col("level").alias("l1"))
    l2 = labels.select("s", "root", F.col("e").alias("q"), F.col("d").alias("d2"), F.col("nearer").alias("n2"), F.col("level").alias("l2"))
    both = F.col("n1").bitwiseAND(F.col("n2")) != 0
    one = (F.col("n1").bitwiseAND(F.col("l2")) != 0) | (F.col("l1").bitwiseAND(F.col("n2")) != 0)
    saved = F.when(both, 2).when(one, 1).otherwise(0)
    met = asked.join(l1, ["s", "p"]).join(l2, ["s", "q", "root"])
    return met.groupBy("s", "p", "q").agg(F.min(F.col("d1") + F.col("d2") - saved).cast("int").alias("ub"))
