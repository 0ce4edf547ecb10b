"""A graph split into a core and the nodes that hang from it in a tree of small bags.

Nodes with at most ``width`` neighbours are taken out one after the other; the neighbours of a node are its bag and are linked by
ways over it, so distances between the nodes left never change. What can't be taken is the core. A node's labels are its
distances to all nodes above it: those of its bag, of their bags, and so on up to the core, which has hub labels.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import bfs, hubs
from .landmarks import numbered, running_total

#: More rounds than any graph needs: in each the nodes of smallest degree among their neighbours are taken.
MAX_ROUNDS = 10_000


def _taken(near: dict[int, list[int]], width: int) -> tuple[dict[int, dict[int, int]], list[tuple[int, int, int]]]:
    """Distances of each node taken to all nodes above it and itself, and the links (e, nb, w) of the core."""
    links = {x: dict.fromkeys(ys, 1) for x, ys in near.items()}
    heap = [(len(ys), x) for x, ys in links.items() if len(ys) <= width]
    heapq.heapify(heap)
    order: list[tuple[int, dict[int, int]]] = []
    while heap:
        n, x = heapq.heappop(heap)
        if x not in links or n != len(links[x]) or not n:
            continue
        bag = links.pop(x)
        order.append((x, bag))
        for y in bag:
            del links[y][x]
        ends = list(bag.items())
        for i, (y, wy) in enumerate(ends):
            for z, wz in ends[i + 1 :]:
                if wy + wz < links[y].get(z, wy + wz + 1):
                    links[y][z] = links[z][y] = wy + wz
        for y in bag:
            if len(links[y]) <= width:
                heapq.heappush(heap, (len(links[y]), y))
    above: dict[int, dict[int, int]] = {}
    for x, bag in reversed(order):
        mine = {x: 0}
        for y, w in bag.items():
            for a, d in above.get(y, {y: 0}).items():
                if w + d < mine.get(a, w + d + 1):
                    mine[a] = w + d
        above[x] = mine
    return above, [(x, y, w) for x, ys in links.items() for y, w in ys.items()]


def split(adj: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Labels (s, e, a, d) of all nodes to the nodes above them and themselves, and the core's links (s, e, nb, w), in both directions.

    Components of up to bfs.SMALL_LINKS links are worked on in one task each, by the node of smallest degree, the smaller id first. In
    larger ones all nodes of at most ``width`` neighbours are taken at once that come before their neighbours in an order by degree and hash.
    """
    adj = bfs.tagged(adj)
    none = F.lit(None).cast("bigint")
    nodes = adj.where(F.col("links") <= bfs.SMALL_LINKS).select("s", "e").distinct().select("s", "e", none.alias("x"), none.alias("y"))

    def answer(s: int, near: dict, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        above, core = _taken(near, width)
        labels = [(e, a, d, False) for e, mine in above.items() for a, d in mine.items()]
        labels += [(e, e, 0, False) for e in near if e not in above] + [(e, nb, w, True) for e, nb, w in core]
        for i in range(0, len(labels), 100_000):
            e, a, d, in_core = zip(*labels[i : i + 100_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(e), pa.int32()), pa.array(e, pa.int64()), pa.array(a, pa.int64()), pa.array(d, pa.int32()), pa.array(in_core, pa.bool_())], names=["s", "e", "a", "d", "core"]
            )

    found = materialize(bfs._by_component(adj, nodes, answer, "s int, e bigint, a bigint, d int, core boolean"), "split")
    labels, core = found.where("not core").drop("core"), found.where("core").select("s", "e", F.col("a").alias("nb"), F.col("d").alias("w"))
    large = adj.where(F.col("links") > bfs.SMALL_LINKS)
    if large.isEmpty():
        return labels, core
    more, rest = split_in_rounds(large.select("s", "e", "nb"), width)
    return labels.unionByName(more), core.unionByName(rest)


def split_in_rounds(adj: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The same for components of any size."""
    rest = materialize(adj.select("s", "e", "nb", F.lit(1).alias("w")).distinct(), "rest")
    every = adj.select("s", "e").distinct()
    bags: list[DataFrame] = []
    while True:
        degree = rest.groupBy("s", "e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= width)
        place = degree.select("s", "e", F.struct("n", F.xxhash64("e"), "e").alias("o"))
        beaten = rest.join(place, ["s", "e"]).join(place.select("s", F.col("e").alias("nb"), F.col("o").alias("other")), ["s", "nb"]).where("other < o").select("s", "e").distinct()
        bag = materialize(rest.join(place.select("s", "e"), ["s", "e"], "left_semi").join(beaten, ["s", "e"], "left_anti"), "bag")
        if bag.isEmpty():
            break
        if len(bags) >= MAX_ROUNDS:
            raise RuntimeError(f"nodes are left to be taken after {MAX_ROUNDS} rounds")
        bags.append(bag)
        x, y = bag.select("s", F.col("e").alias("via"), F.col("nb").alias("e"), F.col("w").alias("w1")), bag.select("s", F.col("e").alias("via"), "nb", F.col("w").alias("w2"))
        ways = x.join(y, ["s", "via"]).where("e <> nb").select("s", "e", "nb", (F.col("w1") + F.col("w2")).alias("w"))
        gone = bag.select("s", "e").distinct()
        kept = rest.join(gone, ["s", "e"], "left_anti").join(gone.withColumnRenamed("e", "nb"), ["s", "nb"], "left_anti").select("s", "e", "nb", "w")
        rest = materialize(kept.unionByName(ways).groupBy("s", "e", "nb").agg(F.min("w").alias("w")), "rest")
    taken = reduce(DataFrame.union, [b.select("s", "e") for b in bags]).distinct() if bags else every.where("false")
    labels = materialize(every.join(taken, ["s", "e"], "left_anti").select("s", "e", F.col("e").alias("a"), F.lit(0).alias("d")), "labels")
    parts = [labels]
    for bag in reversed(bags):
        # all nodes above are labelled: they were taken later, or are left
        known = reduce(DataFrame.union, parts)
        over = bag.join(known.select("s", F.col("e").alias("nb"), "a", "d"), ["s", "nb"]).select("s", "e", "a", (F.col("w") + F.col("d")).alias("d"))
        own = bag.select("s", "e").distinct().select("s", "e", F.col("e").alias("a"), F.lit(0).alias("d"))
        parts.append(materialize(over.union(own).groupBy("s", "e", "a").agg(F.min("d").alias("d")), "labels"))
    return reduce(DataFrame.union, parts), rest


def unit_links(core: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The core with a chain of new nodes, with ids below 0, for each link longer than 1: (s, e, nb), and ranks (s, e, rank) with new nodes last."""
    one_way = core.where("e < nb")
    long = running_total(one_way.where("w > 1").withColumn("x", (F.col("w") - 1).cast("double")), ["s", "e", "nb"], "x")
    base = (F.col("upto") - F.col("x")).cast("bigint")
    number = F.transform(F.sequence(F.lit(1), F.col("w") - 1), lambda i: -(base + i))
    chain = long.select("s", F.concat(F.array("e"), number, F.array("nb")).alias("c"))
    steps = chain.select("s", F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("e"), F.expr("slice(c, 2, size(c) - 1)").alias("nb"))).alias("x")).select("s", "x.e", "x.nb")
    both = one_way.where("w = 1").select("s", "e", "nb").union(steps)
    both = materialize(both.union(both.select("s", F.col("nb").alias("e"), F.col("e").alias("nb"))), "units")
    degree = both.groupBy("s", "e").agg((-F.count(F.lit(1))).alias("d")).withColumn("new", (F.col("e") < 0).cast("int"))
    return both, numbered(degree, "s", ["new", "d", "e"]).select("s", "e", F.col("number").alias("rank"))


@dataclass
class CoreTree:
    """labels(s, e, a, d) up to the core, and hub labels core(s, e, hub, d) of its nodes."""

    labels: DataFrame
    core: DataFrame

    @staticmethod
    def build(adj: DataFrame, width: int = 1) -> CoreTree:
        labels, links = split(adj, width)
        labels, links = materialize(labels, "labels"), materialize(links, "core")
        units, ranks = unit_links(links)
        return CoreTree(labels, materialize(hubs.hub_labels(units, ranks).where("e >= 0"), "corelabels"))

    def distances(self, pairs: DataFrame) -> DataFrame:
        """(s, p, q, d), exact: over a node above both, or over the core; pairs that aren't connected have no row."""
        asked = materialize(pairs.select("s", "p", "q").distinct(), "asked")
        r1 = self.labels.select("s", F.col("e").alias("p"), "a", F.col("d").alias("d1"))
        r2 = self.labels.select("s", F.col("e").alias("q"), "a", F.col("d").alias("d2"))
        common = asked.join(r1, ["s", "p"]).join(r2, ["s", "q", "a"]).select("s", "p", "q", (F.col("d1") + F.col("d2")).alias("d"))
        l1 = r1.join(self.core.select("s", F.col("e").alias("a"), "hub", F.col("d").alias("h1")), ["s", "a"]).groupBy("s", "p", "hub").agg(F.min(F.col("d1") + F.col("h1")).alias("d1"))
        l2 = r2.join(self.core.select("s", F.col("e").alias("a"), "hub", F.col("d").alias("h2")), ["s", "a"]).groupBy("s", "q", "hub").agg(F.min(F.col("d2") + F.col("h2")).alias("d2"))
        mine = asked.join(l1.join(asked.select("s", "p").distinct(), ["s", "p"], "left_semi"), ["s", "p"])
        across = mine.join(l2, ["s", "q", "hub"]).select("s", "p", "q", (F.col("d1") + F.col("d2")).alias("d"))
        return common.union(across).groupBy("s", "p", "q").agg(F.min("d").cast("int").alias("d"))


def core_tree_distances(adj: DataFrame, pairs: DataFrame, width: int = 1) -> DataFrame:
    """(s, p, q, d), exact, by a core-tree split of the given width; width 1 takes away the trees that hang from the graph."""
    return CoreTree.build(adj, width).distances(pairs)
