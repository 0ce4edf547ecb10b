"""Items that occur together in baskets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import skewed_lookup
from ..session import materialize
from .blocks import lists

#: A basket is large if it makes this many times as many pairs as the mean basket.
LARGE = 4
#: Items of a chunk of a large basket at most; it has two chunks at least.
CHUNK = 1_000
#: Pairs held before they are combined and sent on.
PAIRS_HELD = 2_000_000


def _blocks(kept: DataFrame, chunk: int, large: float) -> DataFrame:
    """Item lists whose pairs make up all pairs of every basket, once each: (left, right).

    An ordinary basket is one block with an empty right side. A large basket is split into
    chunks by a hash of the item; each pair of chunks is a block, and so is each chunk. What is large follows from the baskets
    themselves, so baskets are split at every size of the input.
    """
    size = materialize(kept.groupBy("id", "none").agg(F.count(F.lit(1)).alias("m")), "basket_sizes")
    pairs = F.col("m") * (F.col("m") - 1.0)
    mean = size.agg(F.avg(pairs)).first()[0] or 0.0
    chunks = F.greatest(F.lit(2), F.ceil(F.col("m") / chunk)).cast("int")
    # up to a quarter of all baskets, so there is no broadcast hint
    split = size.where((F.col("m") > 3) & (pairs > F.lit(large * mean)) | (F.col("m") > chunk)).select("id", "none", chunks.alias("k"), "m")
    counts = split.select("id", "none", F.col("m").alias("_rows"))
    placed = skewed_lookup(kept, split.drop("m"), ["id", "none"], "v", how="left", counts=counts).withColumn("k", F.coalesce("k", F.lit(1)))
    placed = placed.withColumn("c", F.pmod(F.xxhash64("v"), F.col("k")).cast("int"))
    other = placed.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cell = other.select("id", "none", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "c", "v").groupBy("id", "none", "i", "j")
    both = cell.agg(
        F.collect_list(F.when(F.col("c") == F.col("i"), F.col("v"))).alias("left"),
        F.collect_list(F.when((F.col("c") == F.col("j")) & (F.col("i") != F.col("j")), F.col("v"))).alias("right"),
    )
    return both.where("(i = j and size(left) > 1) or (i < j and size(left) > 0 and size(right) > 0)").select("left", "right")


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        lo, hi = np.minimum(codes[: len(a)], codes[len(a) :]), np.maximum(codes[: len(a)], codes[len(a) :])
        pairs, times = np.unique(lo * len(ids) + hi, return_counts=True)
        return pa.RecordBatch.from_pydict({"v1": ids[pairs // len(ids)], "v2": ids[pairs % len(ids)], "n": times.astype(np.int64)})

    for batch in batches:
        left, nl = lists(batch.column(0))
        right, nr = lists(batch.column(1))
        at, rat = np.cumsum(nl) - nl, np.cumsum(nr) - nr
        for m in np.unique(nl[nr == 0]).tolist():
            rows = np.flatnonzero((nr == 0) & (nl == m))
            i, j = np.triu_indices(m, 1)
            for some in np.array_split(rows, max(1, -(-len(rows) * len(i) // PAIRS_HELD))):
                values = left[at[some][:, None] + np.arange(m)]
                held.append((values[:, i].ravel(), values[:, j].ravel()))
                n += len(some) * len(i)
                if n >= PAIRS_HELD:
                    yield flush()
                    held, n = [], 0
        for r in np.flatnonzero(nr):
            x, y = left[at[r] : at[r] + nl[r]], right[rat[r] : rat[r] + nr[r]]
            held.append((np.repeat(x, len(y)), np.tile(y, len(x))))
            n += len(x) * len(y)
            if n >= PAIRS_HELD:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def associations(baskets: DataFrame, min_count: int, min_ratio: float, chunk: int = CHUNK, large: float = LARGE) -> DataFrame:
    """Pairs of items that occur together often and more often than chance.

    ``baskets(id, vs ARRAY<BIGINT>)``: an item counts once for each basket. The result is
    (v1, v2, n1, n2, n12, ratio) with v1 < v2, where n1, n2 and n12 count the baskets that
    contain v1, v2 and both, and ratio = n12 * n / (n1 * n2) for n baskets; pairs with
    n12 >= min_count and ratio >= min_ratio. Baskets with a null or empty list count
    towards n if they have a row; null items don't count. Rows with the same id are one
    basket, and so are those with a null id. Empty input gives no rows.

    Items that can't be in any such pair are left out first, which loses nothing: n12 is at
    most min(n1, n2), so both items need min_count baskets, and ratio is at most
    n / max(n1, n2), so neither may occur in more than n / min_ratio of them. Baskets that make
    ``large`` times as many pairs of remaining items as the mean basket, or have more than ``chunk`` items, are split into two or more chunks of
    about ``chunk`` items at most, whose pairs are separate tasks' work; all others are whole.
    """
    rows = materialize(baskets.select(F.coalesce("id", F.lit(0)).alias("id"), F.isnull("id").alias("none"), F.array_distinct("vs").alias("vs")), "baskets")
    n = rows.select("id", "none").distinct().count()
    inc = rows.select("id", "none", F.explode("vs").alias("v")).where(F.col("v").isNotNull())
    if n < rows.count():  # else every basket is one row, and its items are distinct already
        inc = materialize(inc.distinct(), "inc")
    counts = materialize(inc.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "items")
    useful = counts.where((F.col("n") >= min_count) & (F.col("n") * F.lit(float(min_ratio)) <= F.lit(n)))
    kept = materialize(skewed_lookup(inc, useful.select("v"), ["v"], "id", counts=useful.select("v", F.col("n").alias("_rows"))), "kept")
    pairs = _blocks(kept, chunk, large).mapInArrow(_count_pairs, "v1 bigint, v2 bigint, n bigint")
    often = pairs.groupBy("v1", "v2").agg(F.sum("n").alias("n12")).where(F.col("n12") >= min_count)
    c1 = useful.select(F.col("v").alias("v1"), F.col("n").alias("n1"))
    c2 = useful.select(F.col("v").alias("v2"), F.col("n").alias("n2"))
    scored = often.join(c1, "v1").join(c2, "v2")
    ratio = F.col("n12") * F.lit(float(n)) / (F.col("n1").cast("double") * F.col("n2"))
    return scored.withColumn("ratio", ratio).where(F.col("ratio") >= min_ratio).select("v1", "v2", "n1", "n2", "n12", "ratio")
