"""Reproducible samples: items in the order of a portable integer hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def order_hash(x: Column, seed: int) -> Column:
    """(id * 48271 + seed * 69621) mod (2^31 - 1), the same in any SQL engine; ties are broken by the id."""
    m = F.lit(2147483647).cast("bigint")
    return F.pmod(F.pmod(x, m) * F.lit(48271).cast("bigint") + F.lit(seed * 69621).cast("bigint"), m)


def ranked(rows: DataFrame, keys: list[str], item: str, seed: int) -> DataFrame:
    """Rows with ``rank``, their place in hash order within the group of ``keys``."""
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return rows.withColumn("rank", F.row_number().over(over.orderBy(order_hash(F.col(item), seed), item)))


def select_items(rows: DataFrame, item: str, n: int, seed: int) -> DataFrame:
    """``n`` distinct items in hash order; none for n = 0 or fewer than two candidates, all if n exceeds them."""
    distinct = rows.select(item).distinct()
    if n <= 0 or len(distinct.take(2)) < 2:
        return distinct.where("false")
    return distinct.orderBy(order_hash(F.col(item), seed), item).limit(n)


def sample_pairs(rows: DataFrame, keys: list[str], item: str, n: Column, seed: int) -> DataFrame:
    """(keys, p, q): the first ``n`` items of each group in hash order, paired consecutively; an odd last one goes with the first."""
    chosen = ranked(rows, keys, item, seed).where(F.col("rank") <= n)
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    paired = chosen.select(
        *keys, F.col(item).alias("p"), "rank", F.lead(item).over(over.orderBy("rank")).alias("next"), F.first(item).over(over.orderBy("rank")).alias("first")
    )
    return paired.where("rank % 2 = 1").select(*keys, "p", F.coalesce("next", "first").alias("q")).where("p <> q")


def pairs_within(components: DataFrame, n: int, seed: int, min_size: int = 3) -> DataFrame:
    """(s, p, q), p < q: ``n`` pairs of hyperedges of one component with at least ``min_size`` members.

    Each member is paired with the k-th next one in hash order, first all with k = 1, then 2, and so on, so the
    candidates stay n times the rounds needed and no component's pairs are all made. All pairs come out if
    there are no more than n.
    """
    over = Window.partitionBy("s", "cc")
    members = ranked(components, ["s", "cc"], "e", seed).withColumn("size", F.count(F.lit(1)).over(over)).where(F.col("size") >= min_size)
    # m rows have at most sqrt(2 m) different sizes
    sizes = members.where("rank = 1").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return components.select("s", F.col("e").alias("p"), F.col("e").alias("q")).where("false")

    def pairs_up_to(k: int) -> int:
        """Pairs at distance 1 to k in hash order, of all components."""
        return sum(r["n"] * c * (2 * r["size"] - c - 1) // 2 for r in sizes for c in [min(k, r["size"] - 1)])

    # the smallest number of rounds that gives n pairs, else all
    low, rounds = 1, max(1, max(r["size"] for r in sizes) - 1)
    while low < rounds:
        k = (low + rounds) // 2
        low, rounds = (low, k) if pairs_up_to(k) >= n else (k + 1, rounds)
    other = members.select("s", "cc", F.col("rank").alias("other"), F.col("e").alias("q"))
    step = members.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(rounds).cast("bigint"), F.col("size") - 1))))
    step = step.withColumn("other", F.col("rank") + F.col("k")).where("other <= size")
    made = step.join(other, ["s", "cc", "other"])
    pairs = made.select("s", "k", F.least("e", "q").alias("p"), F.greatest("e", "q").alias("q"), order_hash(F.col("e"), seed).alias("h"))
    return pairs.orderBy("k", "h", "s", "p", "q").limit(n).select("s", "p", "q")


def stratified_edges(components: DataFrame, n: int, seed: int) -> DataFrame:
    """(s, e): about ``n`` hyperedges, with a share for each s in proportion to s, from the largest s down; s = 1 gets the rest.

    The quotas depend only on the values of s, which are few.
    """
    values = sorted((r[0] for r in components.select("s").distinct().collect()), reverse=True)
    quotas, left = {}, n
    for s in values:
        quotas[s] = left if s == values[-1] else min(left, s * n // sum(values))
        left -= quotas[s]
    quota = F.lit(0)
    for s, q in quotas.items():
        quota = F.when(F.col("s") == s, q).otherwise(quota)
    return ranked(components, ["s"], "e", seed).where(F.col("rank") <= quota).select("s", "e")


def query_pairs(components: DataFrame, inc: DataFrame, n: int, kind: str, seed: int) -> DataFrame:
    """``n`` sampled query pairs: hyperedges (p, q) for edge, a vertex and a hyperedge (v, q) for both; vertex is an error here."""
    if kind not in ("edge", "both"):
        raise ValueError(f"pairs can't be sampled for kind {kind}")
    edges = stratified_edges(components, 2 * n, seed).select("e").distinct()
    pairs = sample_pairs(edges, [], "e", F.lit(2 * n), seed)
    if kind == "edge":
        return pairs
    first = ranked(inc.select(F.col("e").alias("p"), "v"), ["p"], "v", seed).where("rank = 1").select("p", "v")
    return pairs.join(first, "p").select("v", "q").distinct()


def labelled_members(labels: DataFrame, n: int, seed: int) -> DataFrame:
    """(label, e): ``n`` members of each label that has at least n."""
    counted = labels.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("label"))).where(F.col("size") >= n)
    return ranked(counted, ["label"], "e", seed).where(F.col("rank") <= n).select("label", "e")
