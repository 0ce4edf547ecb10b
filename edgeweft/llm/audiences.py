"""Sizes of the overlaps between many large sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

#: Identifiers of one range; 2**16 bits, at most 1024 words a set.
RANGE_BITS = 16
#: Sets that share a word, from which on their words are counted as a matrix.
DENSE = 48
#: Sets of one block; a task compares two blocks at most within one range, so its matrix has at most 2 * 1024 * SETS_PER_BLOCK words.
SETS_PER_BLOCK = 2_000


def bitmap_words(members: DataFrame) -> DataFrame:
    """Compressed bitmaps of ``members(ds, v)``: the non-zero 64-bit words, as (ds, w, mask).

    Words are made by partial aggregation, so a set with a third of all rows is combined
    before the shuffle. Null sets and null or negative identifiers don't count.
    """
    bit = F.expr("shiftleft(1L, cast(v & 63 as int))")
    real = members.where("ds is not null and v >= 0").select("ds", F.shiftright("v", 6).alias("w"), bit.alias("bit"))
    return real.groupBy("ds", "w").agg(F.bit_or("bit").alias("mask"))


class _Counts:
    """Weights summed by code, combined whenever many are held."""

    def __init__(self) -> None:
        self.codes, self.weights, self.n = [], [], 0

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self.codes.append(codes)
        self.weights.append(weights)
        self.n += len(codes)
        if self.n > 2_000_000:
            codes, weights = self.combined()
            self.codes, self.weights, self.n = [codes], [weights], 0

    def combined(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.codes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        return codes, np.bincount(at, weights=np.concatenate(self.weights)).astype(np.int64)


def _count_range(ds: np.ndarray, w: np.ndarray, mask: np.ndarray, n: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise intersection counts, as codes i * n + j with i < j and weights, of the words of one cell; with ``side`` only pairs of different sides."""
    order = np.lexsort((ds, w))
    ds, w, mask = ds[order], w[order], mask[order]
    side = None if side is None else side[order]
    starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    size = np.diff(np.r_[starts, len(w)])
    total = _Counts()
    light = np.repeat(size, size) < DENSE
    ls, lw, lm = ds[light], w[light], mask[light]
    lside = None if side is None else side[light]
    live, gap = np.arange(len(ls)), 1
    while len(live):
        live = live[live + gap < len(ls)]
        live = live[lw[live] == lw[live + gap]]
        here = live if lside is None else live[lside[live] != lside[live + gap]]
        shared = np.bitwise_count(lm[here] & lm[here + gap])
        hit = shared > 0
        total.add(ls[here[hit]] * n + ls[here[hit] + gap], shared[hit].astype(np.int64))
        gap += 1
    hs, hw, hm = ds[~light], w[~light], mask[~light]
    if len(hs):
        words, at = np.unique(hw, return_inverse=True)
        sets, si = np.unique(hs, return_inverse=True)
        bits = np.zeros((len(sets), len(words)), np.uint64)
        bits[si, at] = hm
        of = np.zeros(len(sets), np.int8)
        if side is not None:
            of[si] = side[~light]
        for i in range(len(sets) - 1):
            other = np.arange(i + 1, len(sets))
            if side is not None:
                other = other[of[other] != of[i]]
            shared = np.bitwise_count(bits[i] & bits[other]).sum(axis=1, dtype=np.int64)
            total.add(sets[i] * n + sets[other[shared > 0]], shared[shared > 0])
    return total.combined()


def overlap_sizes(members: DataFrame, sets_per_block: int = SETS_PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Shared identifiers of each pair of sets, and the size of each set.

    ``members(ds STRING, v BIGINT)`` may repeat rows. The first result is
    (ds1, ds2, shared) with ds1 < ds2 for pairs that share anything, the second
    (ds, size). Both are exact: each identifier range is a bitmap whose words are
    intersected and counted, and the counts are summed over the ranges; no intersection is
    materialised. Where there are more than ``sets_per_block`` sets, they are split into blocks by a hash of their name, and
    every pair of blocks within a range is a cell of its own, so neither memory nor work of a task grows with the number of sets. Null sets and
    null or negative identifiers are ignored; empty input gives two empty results.
    """
    words = materialize(bitmap_words(members), "words")
    sizes = words.groupBy("ds").agg(F.sum(F.bit_count("mask")).cast("bigint").alias("size"))

    n_blocks = max(1, -(-sizes.count() // sets_per_block))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.column("ds").unique().to_pylist()
        names.sort(key=lambda x: x.encode())
        codes = {x: i for i, x in enumerate(names)}
        coded = table.column("ds").dictionary_encode().combine_chunks()
        map_codes = np.array([codes[x] for x in coded.dictionary.to_pylist()], np.int64)
        ds = map_codes[coded.indices.to_numpy()]
        w = table.column("w").to_numpy()
        mask = table.column("mask").to_numpy().view(np.uint64)
        own, i, j = (table.column(k).to_numpy().astype(np.int64) for k in ("own", "i", "j"))
        text = np.array(names, object)
        cell = i * n_blocks + j
        order = np.argsort(cell, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            first = mine[0]
            side = None if i[first] == j[first] else (own[mine] == i[first]).astype(np.int8)
            at, shared = _count_range(ds[mine], w[mine], mask[mine], len(names), side)
            yield pa.RecordBatch.from_pydict({
                "ds1": pa.array(text[at // len(names)], pa.string()), "ds2": pa.array(text[at % len(names)], pa.string()), "shared": pa.array(shared),
            })

    own = F.pmod(F.xxhash64("ds"), F.lit(n_blocks)).cast("int") if n_blocks > 1 else F.lit(0)
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))) if n_blocks > 1 else F.lit(0)
    cells = words.select("ds", "w", "mask", own.alias("own")).withColumn("other", other)
    cells = cells.select("ds", "w", "mask", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    block = F.shiftright("w", RANGE_BITS - 6)
    placed = cells.repartition(block, "i", "j") if n_blocks > 1 else cells.repartition(block)
    counted = placed.mapInArrow(count, "ds1 string, ds2 string, shared bigint")
    return counted.groupBy("ds1", "ds2").agg(F.sum("shared").alias("shared")), sizes


def strong_overlaps(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (ds1, ds2) that share at least numerator/denominator of the smaller set, with shared and both sizes."""
    pairs, sizes = overlap_sizes(members)
    s1 = sizes.select(F.col("ds").alias("ds1"), F.col("size").alias("size1"))
    s2 = sizes.select(F.col("ds").alias("ds2"), F.col("size").alias("size2"))
    least = F.least("size1", "size2")
    return pairs.join(s1, "ds1").join(s2, "ds2").where(F.col("shared") * denominator >= least * numerator)
