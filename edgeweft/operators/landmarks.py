"""How many landmarks each component gets, and which of its hyperedges they are."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize, shuffle_width
from . import bfs, sampling
from .ranking import consensus
from .skew import skewed_lookup


def running_total(rows: DataFrame, order: list[str], value: str, rows_per_task: int = 2_000_000) -> DataFrame:
    """Rows with ``upto``, the sum of ``value`` up to and including each, in a total order.

    The rows are range-sorted; each task sums its own, and only the tasks' totals are added up in one place.
    """
    width = max(1, -(-rows.count() // rows_per_task))
    sorted_rows = materialize(rows.repartitionByRange(width, *order).withColumn("_pid", F.spark_partition_id()), "sorted")
    totals = sorted_rows.groupBy("_pid").agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("_pid", "_before")
    inside = F.sum(value).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sorted_rows.withColumn("_in", inside).join(F.broadcast(before), "_pid").withColumn("upto", F.col("_in") + F.col("_before")).drop("_pid", "_in", "_before")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with ``number``, their place from 1 in a total order within each of a few values of ``key``, over many tasks."""
    summed = materialize(running_total(rows.withColumn("_one", F.lit(1.0)), [key, *order], "_one"), "numbered")
    # one row for each key, of which there are as many as values of s
    first = summed.groupBy(key).agg(F.min("upto").alias("_first"))
    return summed.join(F.broadcast(first), key).withColumn("number", (F.col("upto") - F.col("_first") + 1).cast("int")).drop("_one", "upto", "_first")


def importance(sizes: DataFrame, alpha: float, beta: float) -> DataFrame:
    """``sizes(s, cc, size, n_vertices)`` with p = alpha size/Σsize + beta s/Σs + (1 - alpha - beta) n_vertices/Σn_vertices."""
    if alpha + beta > 1 + 1e-9:
        raise ValueError("alpha + beta must not exceed 1")
    total = sizes.agg(F.sum("size"), F.sum("s"), F.sum("n_vertices")).first()
    if not total[0]:
        return sizes.withColumn("p", F.lit(0.0))
    p = F.lit(alpha) * F.col("size") / F.lit(float(total[0])) + F.lit(beta) * F.col("s") / F.lit(float(total[1]))
    return sizes.withColumn("p", p + F.lit(1 - alpha - beta) * F.col("n_vertices") / F.lit(float(total[2])))


def assign_by_sampling(sizes: DataFrame, budget: int, alpha: float, beta: float, lb: int, offset: float = 0.5) -> DataFrame:
    """(s, cc, size, n): landmarks of each component with more than ``lb`` hyperedges.

    Components are drawn with probability p of :func:`importance`; a draw adds a landmark and costs as
    many pairs as the component has hyperedges. The draws are systematic: with a budget for k of
    them, those whose points (i + offset) / k fall into the component's stretch of the cumulative
    probabilities. A component gets no more landmarks than hyperedges. If the squared sizes of all components fit the
    budget, every hyperedge is a landmark.
    """
    able = materialize(sizes.where(F.col("size") > lb), "able")
    square, largest = able.agg(F.sum(F.col("size").cast("double") ** 2), F.max("size")).first()
    if largest is None or largest <= 2:
        return able.where("false").select("s", "cc", "size", F.lit(0).cast("bigint").alias("n"))
    if square <= budget:
        return able.select("s", "cc", "size", F.col("size").alias("n"))
    weighed = importance(able, alpha, beta)
    cost = weighed.agg(F.sum(F.col("p") * F.col("size"))).first()[0]
    k = max(1, int(budget / cost))
    summed = running_total(weighed, ["s", "cc"], "p")
    upto = F.floor(F.col("upto") * k + F.lit(1 - offset) - F.lit(1e-9))
    before = F.floor((F.col("upto") - F.col("p")) * k + F.lit(1 - offset) - F.lit(1e-9))
    return summed.select("s", "cc", "size", F.least("size", F.greatest(F.lit(0), upto - before)).cast("bigint").alias("n")).where("n > 0")


def assign_by_ranking(sizes: DataFrame, budget: int, lb: int, alpha: float, beta: float, max_classes: int | None = None) -> DataFrame:
    """(s, cc, size, n): landmarks go one round at a time to the components on top of a consensus ranking.

    Components of equal s, size and number of vertices are one class and rank alike; there are far fewer classes than
    components. Classes are ranked by size, vertices, s (descending, weighted alpha, 1 - alpha, beta)
    and landmarks so far (ascending). Each round gives a landmark to every component of the top bucket
    that the budget still allows. All classes are ranked, however many. Only if ``max_classes`` is given and there are more, sizes and vertices are
    rounded down to powers of two for the ranking until there are no more; within such a group the larger classes come first,
    and each is charged its own size and takes no more landmarks than that.
    """
    able = sizes.where(F.col("size") > lb)
    classes = [(r["s"], r["size"], r["n_vertices"], r["n"]) for r in able.groupBy("s", "size", "n_vertices").agg(F.count(F.lit(1)).alias("n")).collect()]
    step = 0
    while True:
        groups: dict[tuple, list[int]] = {}
        for i, (s, *counts, _) in enumerate(classes):
            rounded = [math.floor(math.log2(c) * 2.0 ** (3 - step) + 1e-9) if step else c for c in counts]
            groups.setdefault((s, *rounded), []).append(i)
        if max_classes is None or len(groups) <= max_classes:
            break
        step += 1
    found = sorted(groups)
    members = [sorted(groups[g], key=lambda i: classes[i][1:3], reverse=True) for g in found]
    given = [0] * len(classes)
    turns = [0] * len(found)
    left = budget
    scores = [([-float(g[1]) for g in found], 1.0), ([-float(g[2]) for g in found], alpha), ([-float(g[0]) for g in found], beta)]
    while True:
        open_groups = [k for k, m in enumerate(members) if any(given[i] < classes[i][1] <= left for i in m)]
        if not open_groups:
            break
        columns = [[v[k] for k in open_groups] for v, _ in scores] + [[float(turns[k]) for k in open_groups]]
        top = consensus(columns, [w for _, w in scores] + [1.0])[0]
        took = False
        for j in top:
            k = open_groups[j]
            before = left
            for i in members[k]:
                cost = classes[i][1] * classes[i][3]
                if given[i] < classes[i][1] and cost <= left:
                    given[i] += 1
                    left -= cost
            if left < before:
                turns[k] += 1
                took = True
        if not took:
            break
    rows = [(int(s), int(a), int(b), n) for (s, a, b, _), n in zip(classes, given) if n]
    table = sizes.sparkSession.createDataFrame(rows, "s int, size bigint, n_vertices bigint, n bigint")
    return able.join(table, ["s", "size", "n_vertices"]).select("s", "cc", "size", "n")


def _quota(components: DataFrame, assigned: DataFrame) -> DataFrame:
    """Members (s, cc, e, n) of components that get landmarks."""
    return components.join(assigned.select("s", "cc", "n"), ["s", "cc"])


#: Members of a component that one task ranks.
RANKED_PER_TASK = 1_000_000


def by_rank(members: DataFrame, order: list[Column], per_task: int = RANKED_PER_TASK) -> DataFrame:
    """(s, cc, landmark): the first n members of each component in the given order.

    Components with more than ``per_task`` members are salted: each salt keeps its first n, which are then ranked once more.
    """
    sizes = members.groupBy("s", "cc").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > per_task)
    large = materialize(sizes.select("s", "cc", F.ceil(F.col("_m") / per_task).cast("int").alias("_salts"), F.col("_m").alias("_rows")), "large")
    if not large.isEmpty():
        salted = skewed_lookup(members, large.drop("_rows"), ["s", "cc"], "e", how="left", counts=large.select("s", "cc", "_rows"))
        salt = F.coalesce(F.pmod(F.xxhash64("e", F.lit(7)), F.col("_salts")), F.lit(0))
        first = F.row_number().over(Window.partitionBy("s", "cc", salt).orderBy(*order))
        members = salted.withColumn("_first", first).where("_first <= n").drop("_first", "_salts")
    rank = F.row_number().over(Window.partitionBy("s", "cc").orderBy(*order))
    return members.withColumn("rank", rank).where("rank <= n").select("s", "cc", F.col("e").alias("landmark"))


def select_random(components: DataFrame, assigned: DataFrame, seed: int) -> DataFrame:
    return by_rank(_quota(components, assigned), [sampling.order_hash(F.col("e"), seed), F.col("e")])


def with_degree(members: DataFrame, adj: DataFrame) -> DataFrame:
    degree = adj.groupBy("s", "e").agg(F.count(F.lit(1)).alias("degree"))
    return members.join(degree, ["s", "e"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def select_degree(components: DataFrame, assigned: DataFrame, adj: DataFrame) -> DataFrame:
    """The n members with the most s-neighbours, ties by the smaller id."""
    return by_rank(with_degree(_quota(components, assigned), adj), [F.col("degree").desc(), F.col("e")])


def select_farthest(components: DataFrame, assigned: DataFrame, adj: DataFrame, seed: int) -> DataFrame:
    """Greedy: the first in hash order, then always the member farthest from all chosen ones, ties by the smaller id.

    Components of up to bfs.SMALL_LINKS links are worked on in one task each. For larger ones there are as many rounds as their largest n,
    each for all of them at once.
    """
    adj = bfs.tagged(adj)
    members = materialize(_quota(components, assigned), "members")
    first = sampling.ranked(members, ["s", "cc"], "e", seed).where("rank = 1").select("s", "cc", F.col("e").alias("src"), "n")
    adj, few, many = bfs._split(adj, materialize(first, "first"))

    def answer(s: int, near: dict, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for e, n, cc in rows:
            chosen, least = e, {}
            for _ in range(n):
                out.append((cc, chosen))
                for x, d in bfs._search(near, chosen, None, None).items():
                    least[x] = min(d, least.get(x, d))
                d, x = min(((-d, x) for x, d in least.items()))
                if not d:
                    break
                chosen = x
        if out:
            cc, landmark = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(out), pa.int32()), pa.array(cc, pa.int64()), pa.array(landmark, pa.int64())], names=["s", "cc", "landmark"])

    asked = few.select("s", F.col("src").alias("e"), F.col("n").cast("bigint").alias("x"), F.col("cc").alias("y"))
    found = bfs._by_component(adj, asked, answer, "s int, cc bigint, landmark bigint")
    if many is None:
        return found
    mine = members.join(many.select("s", "cc"), ["s", "cc"], "left_semi")
    return found.unionByName(farthest_in_rounds(mine, many.select("s", "cc", F.col("src").alias("landmark")), adj))


def farthest_in_rounds(members: DataFrame, first: DataFrame, adj: DataFrame) -> DataFrame:
    """The same for components of any size: ``members(s, cc, e, n)`` and the first landmark (s, cc, landmark) of each."""
    chosen = [materialize(first, "landmarks")]
    nearest = None
    for k in range(1, members.agg(F.max("n")).first()[0] or 0):
        new = chosen[-1].select("s", F.col("landmark").alias("src"))
        reached = bfs.distances(adj, new).groupBy("s", "e").agg(F.min("dist").alias("d"))
        nearest = reached if nearest is None else nearest.union(reached).groupBy("s", "e").agg(F.min("d").alias("d"))
        nearest = materialize(nearest, "nearest")
        far = members.where(F.col("n") > k).join(nearest, ["s", "e"]).where("d > 0")
        best = far.groupBy("s", "cc").agg(F.min(F.struct((-F.col("d")).alias("d"), "e")).alias("b"))
        fresh = materialize(best.select("s", "cc", F.col("b.e").alias("landmark")), "landmarks")
        if fresh.isEmpty():
            break
        chosen.append(fresh)
    return reduce(DataFrame.union, chosen)


def sampled_paths(components: DataFrame, assigned: DataFrame, adj: DataFrame, share: float, seed: int, all_paths: bool) -> DataFrame:
    """(s, cc, id, path): shortest paths between consecutive members of a sample of each component.

    The sample has max(2, ceil(share * size)) members in hash order.
    """
    members = _quota(components, assigned).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("s", "cc")))
    pairs = sampling.sample_pairs(members, ["s", "cc", "size"], "e", F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("size"))), seed)
    pairs = materialize(pairs.select("s", "cc", "p", "q"), "pairs")
    paths = bfs.shortest_paths(adj, pairs, all_paths)
    return materialize(paths.join(pairs, ["s", "p", "q"]).select("s", "cc", F.xxhash64("s", F.col("path").cast("string")).alias("id"), "path"), "paths")


def _filled(chosen: DataFrame, components: DataFrame, assigned: DataFrame, adj: DataFrame) -> DataFrame:
    """Chosen landmarks, and the members of largest degree where there are fewer than n."""
    had = chosen.groupBy("s", "cc").agg(F.count(F.lit(1)).alias("had"))
    rest = _quota(components, assigned).join(had, ["s", "cc"], "left").withColumn("n", F.col("n") - F.coalesce("had", F.lit(0))).where("n > 0").drop("had")
    rest = rest.join(chosen.select("s", "cc", F.col("landmark").alias("e")), ["s", "cc", "e"], "left_anti")
    return chosen.union(by_rank(with_degree(rest, adj), [F.col("degree").desc(), F.col("e")]))


#: Places on sampled paths of a component that one task covers.
PLACES_PER_TASK = 1_000_000


def select_bestcover(components: DataFrame, assigned: DataFrame, adj: DataFrame, share: float, seed: int, places_per_task: int = PLACES_PER_TASK) -> DataFrame:
    """Greedy: always the hyperedge on most sampled paths that aren't covered yet, ties by the smaller id; then by degree.

    Components with up to ``places_per_task`` places on paths are covered in one task each; larger ones in rounds, all of them at once.
    """
    paths = sampled_paths(components, assigned, adj, share, seed, False)
    nodes = materialize(paths.select("s", "cc", "id", F.explode("path").alias("e")).join(assigned.select("s", "cc", "n"), ["s", "cc"]), "nodes")
    sizes = materialize(nodes.groupBy("s", "cc").agg(F.count(F.lit(1)).alias("places")), "places")
    small = nodes.join(sizes.where(F.col("places") <= places_per_task), ["s", "cc"], "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[int, dict[int, list[int]], dict[int, set[int]]]] = {}
        for batch in batches:
            for s, cc, path, e, n in zip(*(batch.column(k).to_pylist() for k in ("s", "cc", "id", "e", "n"))):
                _, on, of = groups.setdefault((s, cc), (n, {}, {}))
                on.setdefault(path, []).append(e)
                of.setdefault(e, set()).add(path)
        out = []
        for (s, cc), (n, on, of) in groups.items():
            for _ in range(n):
                best = min(of, key=lambda e: (-len(of[e]), e))
                if not of[best]:
                    break
                out.append((s, cc, best))
                for path in list(of[best]):
                    for e in on[path]:
                        of[e].discard(path)
        if out:
            s, cc, landmark = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(cc, pa.int64()), pa.array(landmark, pa.int64())], names=["s", "cc", "landmark"])

    picked = small.repartition("s", "cc").mapInArrow(work, "s int, cc bigint, landmark bigint")
    large = sizes.where(F.col("places") > places_per_task)
    if not large.isEmpty():
        picked = picked.unionByName(cover_in_rounds(nodes.join(large, ["s", "cc"], "left_semi")))
    return _filled(materialize(picked, "landmarks"), components, assigned, adj)


def cover_in_rounds(nodes: DataFrame) -> DataFrame:
    """(s, cc, landmark): the greedy cover of paths (s, cc, id, e, n) of components of any size."""
    nodes = materialize(nodes.select("s", "cc", "id", "e", "n"), "nodes")
    chosen = [nodes.select("s", "cc", F.col("e").alias("landmark")).where("false")]
    for k in range(nodes.agg(F.max("n")).first()[0] or 0):
        counts = nodes.where(F.col("n") > k).groupBy("s", "cc", "e").agg((-F.count(F.lit(1))).alias("c"))
        best = counts.groupBy("s", "cc").agg(F.min(F.struct("c", "e")).alias("b")).select("s", "cc", F.col("b.e").alias("landmark"))
        best = materialize(best, "landmarks")
        if best.isEmpty():
            break
        chosen.append(best)
        hit = nodes.join(best.select("s", "cc", F.col("landmark").alias("e")), ["s", "cc", "e"], "left_semi").select("s", "cc", "id").distinct()
        nodes = materialize(nodes.join(hit, ["s", "cc", "id"], "left_anti"), "nodes")
    return reduce(DataFrame.unionByName, chosen)


def select_between(components: DataFrame, assigned: DataFrame, adj: DataFrame, share: float, seed: int) -> DataFrame:
    """The n hyperedges on most sampled shortest paths, all shortest paths of a pair counted; then by degree."""
    paths = sampled_paths(components, assigned, adj, share, seed, True)
    counts = paths.select("s", "cc", F.explode("path").alias("e")).groupBy("s", "cc", "e").agg(F.count(F.lit(1)).alias("c"))
    best = by_rank(counts.join(assigned.select("s", "cc", "n"), ["s", "cc"]), [F.col("c").desc(), F.col("e")])
    return _filled(materialize(best, "landmarks"), components, assigned, adj)


#: Landmark strategies by name: (components, assigned, adj, share, seed).
STRATEGIES = {
    "random": lambda c, a, adj, share, seed: select_random(c, a, seed),
    "degree": lambda c, a, adj, share, seed: select_degree(c, a, adj),
    "farthest": lambda c, a, adj, share, seed: select_farthest(c, a, adj, seed),
    "bestcover": select_bestcover,
    "between": select_between,
}
