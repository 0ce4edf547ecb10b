"""Per-key results where a few keys hold most rows.

Every function first compresses the input to value frequencies: rows are grouped by
(key, value), with partial aggregation before the shuffle, so that a hot key is spread
over as many tasks as it has values. What is derived from the compressed rows is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize, shuffle_width


def value_frequencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct (keys, value) with ``freq``, the number of rows that hold it.

    Nulls are values like any other: null keys form one key, a null value one value.
    Columns other than ``keys`` and ``value`` are dropped, so clashing names do no harm.
    """
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("freq"))


def distinct_sizes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n_values`` (distinct values) and ``n_rows`` of each key; the counts are exact.

    A null value counts as one value. An empty input gives an empty result.
    """
    return value_frequencies(df, keys, value).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("freq").alias("n_rows")
    )


def modes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent non-null value of each key, ties to the smaller value, as ``mode`` and ``mode_freq``.

    Keys that hold only nulls have no row.
    """
    freq = value_frequencies(df, keys, value).where(F.col(value).isNotNull())
    best = F.max_by(F.struct(F.col(value).alias("mode"), "freq"), F.struct("freq", (-F.col(value)).alias("o")))
    return freq.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.mode").alias("mode"), F.col("b.freq").alias("mode_freq"))


def percentiles(df: DataFrame, keys: list[str], value: str, at: list[float], rows_per_task: int = 2_000_000) -> DataFrame:
    """Exact discrete percentiles of each key: (keys, ``p``, ``percentile``).

    The percentile at ``p`` is the smallest value whose cumulative row count reaches
    ``p`` times the rows of the key. Null values don't count; keys with only nulls have
    no row. The compressed rows are range-sorted by (keys, value), so that one key may
    span many tasks; only per-task sums are combined across tasks.
    """
    freq = materialize(value_frequencies(df, keys, value).where(F.col(value).isNotNull()), "freq")
    width = shuffle_width(df.sparkSession, freq.count(), rows_per_task)
    ranged = freq.repartitionByRange(width, *keys, value).withColumn("pid", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    part = ranged.groupBy(*keys, "pid").agg(F.sum("freq").alias("part_rows"))
    over = Window.partitionBy(*keys)
    before = F.sum("part_rows").over(over.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    part = part.select(
        *keys, "pid", F.coalesce(before, F.lit(0)).alias("before"), "part_rows", F.sum("part_rows").over(over).alias("n"),
    )
    wanted = part.withColumn("p", F.explode(F.array(*[F.lit(float(x)) for x in at])))
    wanted = wanted.withColumn("target", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))))
    wanted = wanted.where((F.col("target") > F.col("before")) & (F.col("target") <= F.col("before") + F.col("part_rows")))
    inside = Window.partitionBy(*keys, "pid").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn("upto", F.sum("freq").over(inside))
    renamed = wanted.select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col("pid").alias("w_pid"), "p", "before", "target")
    same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys] + [F.col("pid") == F.col("w_pid")]
    for one in same[1:]:
        same[0] = same[0] & one
    hit = rows.join(renamed, same[0]).where(
        (F.col("before") + F.col("upto") >= F.col("target")) & (F.col("before") + F.col("upto") - F.col("freq") < F.col("target"))
    )
    return hit.select(*keys, "p", F.col(value).alias("percentile"))


def heavy_keys(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all distinct (keys, value), with ``n_values``.

    The sizes are written once; the total is one number summed from them.
    """
    sizes = materialize(distinct_sizes(df, keys, value), "sizes")
    total = sizes.agg(F.sum("n_values")).first()[0] or 0
    return sizes.where(F.col("n_values") >= F.lit(share) * F.lit(total)).select(*keys, "n_values")


def skewed_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, hot_rows: int = 100_000, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup``, which is unique in ``keys``, though some keys hold most rows.

    Keys with more than ``hot_rows`` rows, or a thousandth of all rows if that is more,
    are counted exactly; there are at most 1000 of them, so their list may be broadcast.
    Their rows are spread by a hash of column ``spread`` and their lookup rows repeated
    for each salt; all other rows take an ordinary join. Null keys never match. ``counts``
    (keys, _rows) may be given where the rows of each key are known already.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    counts = materialize(counts.where(F.col("_rows") > hot_rows), "hot")
    total = counts.agg(F.sum("_rows"), F.count(F.lit(1))).first()
    if not total[1]:
        return rows.join(lookup, keys, how)
    bound = max(hot_rows, (total[0] or 0) // 1000)
    hot = counts.where(F.col("_rows") > bound).select(*keys, F.ceil(F.col("_rows") / F.lit(bound)).cast("int").alias("_salts"))
    hot = F.broadcast(hot)
    salted = rows.join(hot, keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0)).cast("int")
    )
    spread_to = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    repeated = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(spread_to)).drop("_salts")
    return salted.drop("_salts").join(repeated, [*keys, "_salt"], how).drop("_salt")


def group_pairs(rows: DataFrame, keys: list[str], item: str, block_rows: int = 20_000, counts: DataFrame | None = None) -> DataFrame:
    """(keys, a, b), a < b: all pairs of items in the same group, though a few groups may hold most rows.

    ``rows`` holds each item of a group once; null keys and items make no pairs. Groups with more than ``block_rows`` items are split into blocks by a
    hash of the item; each pair of blocks is a cell of its own, so no task has more than the pairs of
    two blocks. Other groups are joined whole. ``counts`` (keys, _rows) may be given where the rows of each key are known already.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.where((F.col("_rows") > block_rows) & F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
    hot = materialize(hot.select(*keys, F.ceil(F.col("_rows") / F.lit(block_rows)).cast("int").alias("_k")), "hot")
    plain = rows.select(*keys, item)
    if not hot.isEmpty():
        # a hot group has over block_rows rows; how many there are depends on the input, so there is no broadcast hint
        plain = plain.join(hot, keys, "left_anti")
    found = plain.withColumnRenamed(item, "a").join(plain.withColumnRenamed(item, "b"), keys).where("a < b")
    if hot.isEmpty():
        return found
    placed = skewed_lookup(rows.select(*keys, item), hot, keys, item).withColumn("_c", F.pmod(F.xxhash64(item), F.col("_k")).cast("int"))
    cells = placed.withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(
        *keys, item, "_c", F.least("_c", "_d").alias("_i"), F.greatest("_c", "_d").alias("_j")
    )
    left, right = cells.withColumnRenamed(item, "a"), cells.select(*keys, "_i", "_j", F.col("_c").alias("_e"), F.col(item).alias("b"))
    across = left.join(right, [*keys, "_i", "_j"]).where("a < b and (_i = _j or _c <> _e)")
    return found.unionByName(across.select(*keys, "a", "b"))
