"""The landmark distance oracle: building, storing and querying it.

An oracle is four frames: components(s, e, cc), sizes(s, cc, size, n_vertices),
landmarks(s, cc, landmark) and labels(s, landmark, e, dist), the distance of every hyperedge of a
component from each of its landmarks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialize
from . import bfs, components as cc_ops, landmarks as lm, overlap

# Expected distance within a component of up to five hyperedges.
SMALL_ESTIMATES = {1: 0.0, 2: 1.0, 3: 1.15, 4: 1.2525, 5: 9.4 / 7}


_COLUMNS = {
    "components": "e bigint, cc bigint", "sizes": "cc bigint, size bigint, n_vertices bigint", "landmarks": "cc bigint, landmark bigint", "labels": "landmark bigint, e bigint, dist int",
}


@dataclass
class Oracle:
    components: DataFrame
    sizes: DataFrame
    landmarks: DataFrame
    labels: DataFrame
    lb: int

    def save(self, path: str) -> None:
        """Write the four frames, those with s partitioned by it."""
        for name in ("components", "sizes", "landmarks", "labels"):
            getattr(self, name).write.mode("overwrite").partitionBy("s").parquet(f"{path}/lb={self.lb}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, lb: int, s: int | None = None) -> Oracle:
        """Read an oracle, only one s of it if given; other partitions aren't touched."""
        def frame(name: str) -> DataFrame:
            df = spark.read.schema(f"{_COLUMNS[name]}, s int").parquet(f"{path}/lb={lb}/{name}")
            return df if s is None else df.where(F.col("s") == s)

        return Oracle(frame("components"), frame("sizes"), frame("landmarks"), frame("labels"), lb)

    @staticmethod
    def load_components(spark: SparkSession, path: str, lb: int, s: int | None = None) -> DataFrame:
        """(s, e, cc): only the components of a stored oracle."""
        return Oracle.load(spark, path, lb, s).components.select("s", "e", "cc")

    def size_of(self) -> DataFrame:
        """One row: n_pairs, n_landmarks and n_members."""
        one = F.lit(1).alias("one")
        pairs = self.labels.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("s", "landmark").alias("n_landmarks"))
        members = self.components.agg(F.count(F.lit(1)).alias("n_members"))
        return pairs.select("*", one).join(F.broadcast(members.select("*", one)), "one").drop("one")


def labels_of(adj: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(s, landmark, e, dist) from each ``landmarks(s, landmark)``."""
    found = bfs.distances(adj, landmarks.select("s", F.col("landmark").alias("src")))
    return found.select("s", F.col("src").alias("landmark"), "e", "dist")


def build(
    inc: DataFrame, s_values: list[int], budget_per_edge: int = 100, lb: int = 4, alpha: float = 0.5, beta: float = 0.5, strategy: str = "degree",
    assignment: str = "sampling", share: float = 0.4, seed: int = 4, split_budget: bool = False,
) -> Oracle:
    """The oracle of a hypergraph for all s in ``s_values``.

    ``split_budget`` gives every s an equal part of the budget of budget_per_edge * hyperedges pairs and
    assigns it by size and vertices only, with weight alpha + beta / 2; else all components of all s
    compete. Components of at most ``lb`` hyperedges get no landmarks.
    """
    if strategy not in lm.STRATEGIES:
        raise ValueError(f"strategy must be one of {sorted(lm.STRATEGIES)}, not {strategy}")
    ov = materialize(overlap.overlaps(inc, min(s_values)), "overlaps")
    linked = materialize(cc_ops.connect_levels(ov, s_values), "linked")
    adj = bfs.tagged(overlap.adjacency(ov, s_values), linked)
    members = materialize(cc_ops.s_components(inc, ov, s_values, linked), "components")
    sizes = materialize(cc_ops.component_sizes(members, inc), "sizes")
    budget = budget_per_edge * inc.select("e").distinct().count()

    def assign(some: DataFrame, part: int, a: float, b: float) -> DataFrame:
        if assignment == "ranking":
            return lm.assign_by_ranking(some, part, lb, a, b)
        return lm.assign_by_sampling(some, part, a, b, lb)

    if split_budget:
        assigned = None
        for s in s_values:
            one = assign(sizes.where(F.col("s") == s), budget // len(s_values), min(1.0, alpha + beta / 2), 0.0)
            assigned = one if assigned is None else assigned.union(one)
    else:
        assigned = assign(sizes, budget, alpha, beta)
    assigned = materialize(assigned, "assigned")
    chosen = materialize(lm.STRATEGIES[strategy](members, assigned, adj, share, seed), "landmarks")
    return Oracle(members, sizes, chosen, materialize(labels_of(adj, chosen), "labels"), lb)


def build_baseline(inc: DataFrame, s_values: list[int], budget_per_edge: int, seed: int = 4) -> Oracle:
    """The oracle without components: landmarks by s-degree, one for each s in turn, until the budget of pairs is used.

    Candidates are hyperedges with at least s vertices. It ends when the budget is used or no candidates are left.
    Membership is by size alone: every hyperedge is a member of one component per s.
    """
    ov = materialize(overlap.overlaps(inc, min(s_values)), "overlaps")
    adj = bfs.tagged(overlap.adjacency(ov, s_values), materialize(cc_ops.connect_levels(ov, s_values), "linked"))
    each = F.explode(F.filter(F.array(*[F.lit(int(s)) for s in s_values]), lambda s: s <= F.col("size")))
    members = materialize(overlap.edge_sizes(inc).select(each.alias("s"), "e", F.lit(0).cast("bigint").alias("cc")), "members")
    sizes = materialize(cc_ops.component_sizes(members, inc), "sizes")
    budget = budget_per_edge * inc.select("e").distinct().count()
    order = lm.with_degree(members, adj).select("s", "e", (-F.col("degree")).alias("d"))
    ranked = materialize(lm.numbered(order, "s", ["d", "e"]).select("s", "e", F.col("number").alias("r")), "ranked")
    batch, done, labels, used = 1, 0, None, 0
    while used < budget:
        new = ranked.where((F.col("r") > done) & (F.col("r") <= done + batch))
        if new.isEmpty():
            break
        fresh = materialize(labels_of(adj, new.select("s", F.col("e").alias("landmark"))), "labels")
        labels = fresh if labels is None else labels.union(fresh)
        used += fresh.count()
        done, batch = done + batch, batch * 2
    if labels is None:
        labels = members.select("s", F.col("e").alias("landmark"), "e", F.lit(0).alias("dist")).where("false")
    # the landmarks in turn, as many as the budget allows
    cost = labels.groupBy("s", "landmark").agg(F.count(F.lit(1)).alias("pairs")).join(ranked.select("s", F.col("e").alias("landmark"), "r"), ["s", "landmark"])
    kept = lm.running_total(cost.withColumn("pairs", F.col("pairs").cast("double")), ["r", "s"], "pairs").where(F.col("upto") - F.col("pairs") < budget)
    kept = materialize(kept.select("s", F.lit(0).cast("bigint").alias("cc"), "landmark"), "landmarks")
    return Oracle(members, sizes, kept, materialize(labels.join(kept.select("s", "landmark"), ["s", "landmark"], "left_semi"), "labels"), 0)


def small_estimate(size: Column) -> Column:
    """Expected distance in a component of ``size`` hyperedges; beyond five the middle of (1, size)."""
    out = (size + 1) / 2.0
    for n, d in SMALL_ESTIMATES.items():
        out = F.when(size == n, F.lit(d)).otherwise(out)
    return out


def edge_bounds(oracle: Oracle, queries: DataFrame, compat: bool = False) -> DataFrame:
    """(s, p, q, lb, ub, d_hat) for ``queries(s, p, q)`` of hyperedges.

    By the triangle inequality over common landmarks: lb = max |d1 - d2|, ub = min (d1 + d2), d_hat their middle. In a
    component of at most oracle.lb hyperedges the bounds are (1, size) and d_hat an expectation. Pairs in
    different components, or without a common landmark, get -1. p = q gives 0 unless ``compat``.
    """
    asked = queries.select("s", "p", "q").distinct()
    mine = oracle.components.select("s", F.col("e").alias("p"), F.col("cc").alias("c1"))
    other = oracle.components.select("s", F.col("e").alias("q"), F.col("cc").alias("c2"))
    placed = asked.join(mine, ["s", "p"]).join(other, ["s", "q"]).where("c1 = c2")
    placed = placed.join(oracle.sizes.select("s", F.col("cc").alias("c1"), "size"), ["s", "c1"]).select("s", "p", "q", "size")
    placed = materialize(placed, "placed")
    small = placed.where(F.col("size") <= oracle.lb)
    small = small.select("s", "p", "q", F.lit(1.0).alias("lb"), F.col("size").cast("double").alias("ub"), small_estimate(F.col("size")).cast("double").alias("d_hat"))
    l1 = oracle.labels.select("s", "landmark", F.col("e").alias("p"), F.col("dist").alias("d1"))
    l2 = oracle.labels.select("s", "landmark", F.col("e").alias("q"), F.col("dist").alias("d2"))
    hubs = placed.where(F.col("size") > oracle.lb).select("s", "p", "q").join(l1, ["s", "p"]).join(l2, ["s", "q", "landmark"])
    large = hubs.groupBy("s", "p", "q").agg(
        F.max(F.abs(F.col("d1") - F.col("d2"))).cast("double").alias("lb"), F.min(F.col("d1") + F.col("d2")).cast("double").alias("ub")
    ).withColumn("d_hat", F.col("lb") + (F.col("ub") - F.col("lb")) / 2)
    known = small.unionByName(large)
    if not compat:
        known = known.select("s", "p", "q", *[F.when(F.col("p") == F.col("q"), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in ("lb", "ub", "d_hat")])
    none = F.lit(-1.0)
    return asked.join(known, ["s", "p", "q"], "left").select("s", "p", "q", *[F.coalesce(c, none).alias(c) for c in ("lb", "ub", "d_hat")])


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("d_hat", "lb", "ub", "p", "q"))
    return rows.withColumn("rank", rank).where("rank = 1").select(*keys, "lb", "ub", "d_hat")


def vertex_bounds(oracle: Oracle, inc: DataFrame, queries: DataFrame) -> DataFrame:
    """(s, u, v, lb, ub, d_hat) for ``queries(s, u, v)`` of vertices.

    Vertices with a common hyperedge give (1, 1, 1) for any s. Else it is the pair of their hyperedges with the
    smallest estimate, ties by lb, ub and ids; -1 if there is none.
    """
    asked = materialize(queries.select("s", "u", "v").distinct(), "asked")
    flagged = materialize(asked.join(overlap.in_common_edge(asked.select("u", "v").distinct(), inc), ["u", "v"]), "flagged")
    ends = oracle.components.join(inc, "e").select("s", "v", "e")
    far = flagged.where("not common").select("s", "u", "v")
    both = far.join(ends.select("s", F.col("v").alias("u"), F.col("e").alias("p")), ["s", "u"]).join(ends.select("s", "v", F.col("e").alias("q")), ["s", "v"])
    both = materialize(both, "ends")
    bounds = edge_bounds(oracle, both.select("s", "p", "q")).where("d_hat >= 0")
    best = _best(both.join(bounds, ["s", "p", "q"]), ["s", "u", "v"])
    one, none = F.lit(1.0), F.lit(-1.0)
    return flagged.join(best, ["s", "u", "v"], "left").select(
        "s", "u", "v", *[F.when(F.col("common"), one).otherwise(F.coalesce(c, none)).alias(c) for c in ("lb", "ub", "d_hat")]
    )


def vertex_edge_bounds(oracle: Oracle, inc: DataFrame, queries: DataFrame) -> DataFrame:
    """(s, v, q, lb, ub, d_hat) for ``queries(s, v, q)`` of a vertex and a hyperedge: the hyperedge of v with the smallest estimate."""
    asked = materialize(queries.select("s", "v", "q").distinct(), "asked")
    ends = oracle.components.join(inc, "e").select("s", "v", F.col("e").alias("p"))
    both = materialize(asked.join(ends, ["s", "v"]), "ends")
    bounds = edge_bounds(oracle, both.select("s", "p", "q")).where("d_hat >= 0")
    best = _best(both.join(bounds, ["s", "p", "q"]), ["s", "v", "q"])
    return asked.join(best, ["s", "v", "q"], "left").select("s", "v", "q", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("lb", "ub", "d_hat")])


def bounds(kind: str, oracle: Oracle, inc: DataFrame, queries: DataFrame) -> DataFrame:
    """Approximate profiles by kind, for single s or all, as the rows of ``queries`` say."""
    if kind == "edge":
        return edge_bounds(oracle, queries)
    if kind == "vertex":
        return vertex_bounds(oracle, inc, queries)
    if kind == "both":
        return vertex_edge_bounds(oracle, inc, queries)
    raise ValueError(f"kind must be edge, vertex or both, not {kind}")


def profile_queries(inc: DataFrame, pairs: DataFrame, max_s: int) -> DataFrame:
    """(s, p, q): each pair for every s up to the largest at which both hyperedges exist."""
    m = overlap.max_membership(inc, max_s)
    both = pairs.join(m.select(F.col("e").alias("p"), F.col("max_s").alias("m1")), "p").join(m.select(F.col("e").alias("q"), F.col("max_s").alias("m2")), "q")
    return both.select(F.explode(F.sequence(F.lit(1), F.least("m1", "m2"))).alias("s"), "p", "q")


def refined(profiles: DataFrame) -> DataFrame:
    """Bounds made monotone in s: ub from the next larger s if that is smaller, lb the running maximum; d_hat stays."""
    over = Window.partitionBy("p", "q").orderBy("s")
    after = F.lead("ub").over(over)
    up = F.when(after.isNotNull() & (after >= 0) & (F.col("ub") >= 0), F.least("ub", after)).otherwise(F.col("ub"))
    return profiles.select("s", "p", "q", F.max("lb").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("lb"), up.alias("ub"), "d_hat")


def reachable(oracle: Oracle, sources: DataFrame) -> DataFrame:
    """(s, src, e, lb, ub, d_hat): all hyperedges bounded from ``sources(s, src)``, with the floor of the middle as estimate."""
    l1 = oracle.labels.join(sources.select("s", F.col("src").alias("e")).distinct(), ["s", "e"], "left_semi")
    l1 = l1.select("s", "landmark", F.col("e").alias("src"), F.col("dist").alias("d1"))
    l2 = oracle.labels.select("s", "landmark", "e", F.col("dist").alias("d2"))
    both = l1.join(l2, ["s", "landmark"]).where("src <> e")
    found = both.groupBy("s", "src", "e").agg(F.max(F.abs(F.col("d1") - F.col("d2"))).cast("bigint").alias("lb"), F.min(F.col("d1") + F.col("d2")).cast("bigint").alias("ub"))
    return found.withColumn("d_hat", F.col("lb") + F.floor((F.col("ub") - F.col("lb")) / 2).cast("bigint"))


def reachable_vertices(oracle: Oracle, inc: DataFrame, vertices: DataFrame, s: int) -> DataFrame:
    """(s, src, v, lb, ub, d_hat): vertices bounded from each of ``vertices(v)``: the largest lb and smallest ub over its hyperedges."""
    mine = materialize(inc.join(vertices.select("v").distinct(), "v", "left_semi"), "mine")
    found = reachable(oracle, mine.select(F.lit(s).alias("s"), F.col("e").alias("src")))
    by_source = found.join(mine.select(F.col("e").alias("src"), F.col("v").alias("sv")), "src")
    merged = by_source.join(inc.select("e", "v"), "e").where("sv <> v").groupBy("s", "sv", "v").agg(F.max("lb").alias("lb"), F.min("ub").alias("ub"))
    return merged.select("s", F.col("sv").alias("src"), "v", "lb", "ub", (F.col("lb") + F.floor((F.col("ub") - F.col("lb")) / 2)).cast("bigint").alias("d_hat"))


def approx_closeness(oracle: Oracle, elements: DataFrame) -> DataFrame:
    """(s, e, closeness) of ``elements(s, e)``: landmarks other than itself over the sum of their label distances.

    In components of at most oracle.lb hyperedges it is 1 over the expected distance; 0 without labels or alone.
    """
    placed = elements.select("s", "e").distinct().join(oracle.components, ["s", "e"]).join(oracle.sizes.select("s", "cc", "size"), ["s", "cc"])
    summed = oracle.labels.where("dist > 0").groupBy("s", "e").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("total"))
    expected = small_estimate(F.col("size"))
    small = F.when(expected > 0, 1 / expected).otherwise(F.lit(0.0))
    return placed.join(summed, ["s", "e"], "left").select(
        "s", "e", F.when(F.col("size") <= oracle.lb, small).otherwise(F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))).alias("closeness")
    )


def approx_vertex_closeness(oracle: Oracle, inc: DataFrame, vertices: DataFrame, s: int) -> DataFrame:
    """(s, v, closeness): the largest approximate closeness of the hyperedges of each vertex; 0 if it has none."""
    mine = inc.join(vertices.select("v").distinct(), "v", "left_semi")
    close = approx_closeness(oracle, mine.select(F.lit(s).alias("s"), "e"))
    best = mine.join(close, "e").groupBy("v").agg(F.max("closeness").alias("closeness"))
    return vertices.select("v").distinct().join(best, "v", "left").select(F.lit(s).alias("s"), "v", F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def nearest_landmarks(oracle: Oracle, queries: DataFrame, k: int) -> DataFrame:
    """(s, q, rank, e, dist): the k nearest landmarks of ``queries(s, q)`` by their labels, ties by the smaller id."""
    mine = oracle.labels.join(queries.select("s", F.col("q").alias("e")).distinct(), ["s", "e"], "left_semi").where("landmark <> e")
    rank = F.row_number().over(Window.partitionBy("s", "e").orderBy("dist", "landmark"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("s", F.col("e").alias("q"), "rank", F.col("landmark").alias("e"), "dist")


def nearest_estimated(oracle: Oracle, queries: DataFrame, k: int, labels: DataFrame | None = None) -> DataFrame:
    """(s, q, rank, e, d_hat): the k elements of smallest estimate; only those with the label of q if ``labels(e, label)`` is given."""
    found = reachable(oracle, queries.select("s", F.col("q").alias("src")))
    if labels is not None:
        low = labels.select("e", F.lower("label").alias("label")).distinct()
        found = found.join(low, "e").join(low.select(F.col("e").alias("src"), "label"), ["src", "label"]).select("s", "src", "e", "d_hat").distinct()
    rank = F.row_number().over(Window.partitionBy("s", "src").orderBy("d_hat", "e"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("s", F.col("src").alias("q"), "rank", "e", "d_hat")


def reachable_counts(found: DataFrame, max_s: int) -> DataFrame:
    """(src, s, n): different elements reached by each source at s or less."""
    least = found.groupBy("src", "e").agg(F.min("s").alias("first"))
    each = least.select("src", F.explode(F.sequence(F.col("first"), F.lit(max_s))).alias("s"))
    return each.groupBy("src", "s").agg(F.count(F.lit(1)).alias("n"))


