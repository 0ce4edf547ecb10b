"""The N best items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize, shuffle_width

#: A group is heavy if it holds more than this fraction of all items, so there are fewer heavy groups than that.
HEAVY_GROUPS = 1_000
#: Items of heavy groups in one task.
ITEMS_PER_TASK = 1_000_000


def top_items(df: DataFrame, keys: list[str], item: str, score: str, n: int, heavy_groups: int = HEAVY_GROUPS) -> DataFrame:
    """(keys, item, score) of the ``n`` items with the largest score in each group.

    Equal scores are decided by the smaller item. An item that occurs several times in a
    group counts once, with its largest score. Rows with a null item or score don't count; null
    keys form one group. Groups with fewer than ``n`` items give all of them.

    Groups are counted exactly. Those with more than a ``heavy_groups``-th of all items, at every size of the input, are
    salted by item, range-sorted by (keys, salt), and cut to ``n`` items per salt before one
    last window; there are fewer than ``heavy_groups``, so their list is broadcast. All others go to an ordinary window. Extra columns are ignored.
    """
    best = df.where(F.col(item).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, item).agg(F.max(score).alias(score))
    best = materialize(best, "best")
    counts = materialize(best.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "groups")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    bound = max(1, total // heavy_groups)
    order = (F.col(score).desc(), F.col(item).asc())

    def first(rows: DataFrame, by: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

    heavy = F.broadcast(materialize(counts.where(F.col("_n") > bound).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / bound).cast("int").alias("_salts")
    ), "heavy"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    light = best.join(heavy, same, "left_anti")
    salted = best.join(heavy, same).withColumn("_salt", F.pmod(F.xxhash64(item), F.col("_salts")).cast("int")).select(*keys, item, score, "_salt")
    width = shuffle_width(best.sparkSession, total, ITEMS_PER_TASK)
    ranged = salted.repartitionByRange(width, *keys, "_salt")
    heavy_first = first(first(ranged, [*keys, "_salt"]), keys)
    return first(light, keys).select(*keys, item, score).unionByName(heavy_first.select(*keys, item, score))
