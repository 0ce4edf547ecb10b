"""All pairs of sets whose overlap reaches a given share of their union.

Let x and y have a and b elements. Their Jaccard similarity reaches t = p/q exactly if they
share at least ceil(p (a + b) / (p + q)) elements, so if they differ in at most
D(a, b) = a + b - 2 ceil(p (a + b) / (p + q)) elements. The token universe is split by a hash into
m(a, b) segments with 2 m > D. Then, by the pigeonhole principle, x and y differ in at most
one element in one segment: there one's elements equal the other's, or the other's without one of
them. Each set therefore sends, for every m that some partner size needs, a signature of each
segment, and one of each segment without each of its elements.

A signature that holds only frequent tokens, or none, would collect too many sets. Both
partners see that alike, and refine it: within it, the rest of the set is split again by
another hash, where the same argument holds, and the signatures are those of the pair of segments.

The signatures of a set grow with the square of its size. Pairs with a set of more than LONG elements
are therefore found by a shared token among the rarest |x| - ceil(t |x|) + 1 of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import group_pairs
from ..session import materialize, shuffle_width
from .blocks import exchange, lists, mix, pack, unpack

#: A token is frequent if it occurs in more sets than this, or more often than a millionth of all elements if that is more: there are a million such tokens at most.
FREQUENT = 256
FREQUENT_TOKENS = 1_000_000
#: How often a weak signature is refined.
LEVELS = 3
#: Signatures of one task.
SIGNATURES_PER_TASK = 1_500_000
#: Sets with more elements send no signatures.
LONG = 512
#: Sets that share a signature, from which on they are compared in pairs of blocks of this size, each pair a task's work.
HOT_SETS = 2_000
#: Bits of a signature within its partition. More sets share one by chance then, about one pair of a partition; all are verified.
SIGNATURE_BITS = 40
# low and high bits of the signature, the bytes of the id, parity sketch, twice the size and 1 if an element was left out
_KINDS = ["<u4", "u1", *["u1"] * 8, "<u4", "<u2"]


def _differ(a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """D(a, b); negative if no sets of these sizes can reach t."""
    p, q = t.numerator, t.denominator
    share = -(-p * (a + b) // (p + q))
    return np.where(share <= np.minimum(a, b), a + b - 2 * share, -1)


def _segments(d: np.ndarray) -> np.ndarray:
    """m for a difference d: d // 2 + 1, beyond 4 rounded up so that only few values occur."""
    m = np.asarray(d) // 2 + 1
    large = 2 ** np.ceil(np.log2(np.maximum(m, 5) / 3.0)).astype(np.int64)
    return np.where(m <= 4, m, np.where(m <= 2 * large, 2 * large, np.where(m <= 3 * large, 3 * large, 4 * large)))


def _plan(size: int, t: Fraction, least: int) -> list[tuple[int, bool, bool, bool]]:
    """(m, whole segments, left-out elements, left-out elements in segment 0 too) that a set of this size sends."""
    partner = np.arange(max(least, -(-size * t.numerator // t.denominator)), size * t.denominator // t.numerator + 1)
    d = _differ(np.full(len(partner), size), partner, t)
    partner, d = partner[d > 0], d[d > 0]  # equal sets are grouped before
    plan = []
    for m in np.unique(_segments(d)).tolist():
        mine, by = partner[_segments(d) == m], d[_segments(d) == m]
        if m == 1:
            plan.append((1, bool((mine > size).any()), bool((mine < size).any()), True))
        else:
            plan.append((m, True, True, bool((by > 2 * m - 2).any())))
    return plan


def _signatures(tokens: np.ndarray, rare: np.ndarray, plan: list[tuple[int, bool, bool, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature and whether an element was left out, for a matrix of token hashes of equally large sets."""
    rows, signatures, left_out = [], [], []

    def send(row: np.ndarray, value: np.ndarray, without: bool) -> None:
        rows.append(row)
        signatures.append(value)
        left_out.append(np.full(len(row), without))

    def split(row: np.ndarray, active: np.ndarray, base: np.ndarray, level: int, m: int, whole: bool, without: bool, first: bool) -> None:
        h, r = tokens[row], rare[row] & active
        segment = mix(h, 7 * level + 13 * m) % np.uint64(m)
        again: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(m):
            inside = active & (segment == i)
            total = np.where(inside, h, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            strong = (r & inside).sum(axis=1)
            outside = active & ~inside
            # not where nothing is outside: a partner may have an element there
            last = np.full(len(row), m == 1 or level + 1 >= LEVELS)
            tag = np.uint64(level * 64 + i + 1)
            if whole:
                value = mix(base ^ mix(total + tag, m), i)
                ok = (strong > 0) | last
                send(row[ok], value[ok], False)
                again.append((row[~ok], outside[~ok], value[~ok]))
            if without and (i or first):
                at, k = np.nonzero(inside)
                value = mix(base[at] ^ mix(total[at] - h[at, k] + tag, m), i)
                ok = (strong[at] - r[at, k] > 0) | last[at]
                send(row[at[ok]], value[ok], True)
                again.append((row[at[~ok]], outside[at[~ok]], value[~ok]))
        rest = tuple(np.concatenate(x) for x in zip(*again)) if again else ((),)
        if len(rest[0]):
            split(*rest, level + 1, m, True, True, True)

    everyone = np.arange(len(tokens))
    for m, whole, without, first in plan:
        split(everyone, np.ones(tokens.shape, bool), np.full(len(tokens), m, np.uint64), 0, m, whole, without, first)
    return np.concatenate(rows), np.concatenate(signatures), np.concatenate(left_out)


def _packed(signature: np.ndarray, ids: np.ndarray, sketch: np.ndarray, size: np.ndarray, without: np.ndarray, parts: int) -> pa.RecordBatch:
    rest = signature // np.uint64(parts) & np.uint64(2**SIGNATURE_BITS - 1)
    planes = np.ascontiguousarray(ids.astype("<i8")).view(np.uint8).reshape(-1, 8).T
    columns = [rest.astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8), *planes, sketch, (size * 2 + without).astype(np.uint16)]
    return pack((signature % np.uint64(parts)).astype(np.int64), parts, columns)


def _unpacked(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low, high, *planes, sketch, kind = unpack(bodies, _KINDS)
    ids = np.ascontiguousarray(np.stack(planes, axis=1)).view("<i8").ravel() if len(low) else np.empty(0, np.int64)
    return low.astype(np.int64) | high.astype(np.int64) << 32, ids, sketch, (kind >> 1).astype(np.int64), kind & 1


def _near(x: np.ndarray, y: np.ndarray, ids: np.ndarray, sketch: np.ndarray, size: np.ndarray, without: np.ndarray, t: Fraction) -> np.ndarray:
    """Ids of the pairs of rows x and y that may differ little enough, as an array of two rows."""
    ok = ~((without[x] == 1) & (without[y] == 1)) & (ids[x] != ids[y])
    x, y = x[ok], y[ok]
    near = np.bitwise_count(sketch[x] ^ sketch[y]) <= _differ(size[x], size[y], t)
    return np.stack([ids[x[near]], ids[y[near]]])


def _candidates(signature: np.ndarray, ids: np.ndarray, sketch: np.ndarray, size: np.ndarray, without: np.ndarray, t: Fraction, hot_sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that share a signature and may differ little enough, once each; and the rows whose signature is hot, with how many share it."""
    order = np.argsort(signature, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(signature[order]) != 0]) if len(order) else np.empty(0, np.int64)
    many = np.diff(np.r_[starts, len(order)])
    held = np.empty(len(order), np.int64)
    held[order] = np.repeat(many, many)
    hot = np.where(held > hot_sets, held, 0)
    at = order[(held[order] > 1) & (hot[order] == 0)]
    signature, ids, sketch, size, without = signature[at], ids[at], sketch[at], size[at], without[at]
    live, gap, found = np.arange(len(at)), 1, []
    while len(live):
        live = live[live + gap < len(at)]
        live = live[signature[live] == signature[live + gap]]
        found.append(_near(live, live + gap, ids, sketch, size, without, t))
        gap += 1
    return *_distinct(found), hot


def _distinct(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    pairs = np.unique(np.stack([both.min(axis=0), both.max(axis=0)]), axis=1) if both.size else both
    return pairs[0], pairs[1]


_FOUND = "id1 bigint, id2 bigint, signature bigint, sketch bigint, size bigint, without boolean, sharing bigint"


def _found(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns["id1"])
    arrays = {name: pa.array(columns[name]) if name in columns else pa.nulls(n, pa.bool_() if name == "without" else pa.int64()) for name in (x.split()[0] for x in _FOUND.split(", "))}
    return pa.RecordBatch.from_pydict(arrays)


def _hot_pairs(rows: DataFrame, t: Fraction, hot_sets: int) -> DataFrame:
    """(id1, id2) of the rows that share a hot signature: each pair of blocks of ``hot_sets`` sets is a cell of its own."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        signature, i, j, own, ids, sketch, size, without = (table.column(k).to_numpy() for k in ("signature", "i", "j", "own", "id1", "sketch", "size", "without"))
        without = without.astype(np.uint8)
        order = np.lexsort((j, i, signature))
        change = (np.diff(signature[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
        for mine in np.split(order, np.flatnonzero(change) + 1):
            left = mine[own[mine] == i[mine[0]]]
            right = mine[own[mine] == j[mine[0]]]
            found = []
            for k, x in enumerate(left):
                y = right[k + 1 :] if i[mine[0]] == j[mine[0]] else right
                found.append(_near(np.full(len(y), x), y, ids, sketch, size, without, t))
            a, b = _distinct(found)
            yield pa.RecordBatch.from_pydict({"id1": pa.array(a), "id2": pa.array(b)})

    placed = rows.withColumn("k", F.ceil(F.col("sharing") / hot_sets).cast("int")).withColumn("own", F.pmod(F.xxhash64("id1"), F.col("k")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return cells.repartition("signature", "i", "j").mapInArrow(solve, "id1 bigint, id2 bigint")


def _long_candidates(real: DataFrame, t: Fraction) -> DataFrame:
    """(id1, id2): pairs of which one set at least has more than LONG elements and that share one of their rarest tokens."""
    p, q = t.numerator, t.denominator
    size = F.size("vs").cast("bigint")
    able = real.where(size * q >= (LONG + 1) * p).select("id", size.alias("size"), F.explode("vs").alias("v"))
    able = materialize(able, "long")
    counts = able.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # tokens of one set only come first in the order of rarity and link nothing
    kept = able.join(counts, "v")
    left = kept.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), F.col("v").desc())))
    # all but the ceil(t size) - 1 most frequent
    prefix = materialize(left.where(F.col("rank") >= F.ceil(F.col("size") * p / q)).select("id", "size", "v"), "prefix")
    x = prefix.select("v", F.col("id").alias("id1"), F.col("size").alias("a"))
    y = prefix.select("v", F.col("id").alias("id2"), F.col("size").alias("b"))
    near = (F.col("a") * q >= F.col("b") * p) & (F.col("b") * q >= F.col("a") * p) & (F.greatest("a", "b") > LONG)
    return x.join(y, "v").where((F.col("id1") < F.col("id2")) & near).select("id1", "id2")


def similar_sets(reps: DataFrame, threshold: str, least: int = 1, frequent: int = FREQUENT, hot_sets: int = HOT_SETS) -> DataFrame:
    """Pairs (id1, id2) of different sets ``reps(id, vs)`` with Jaccard similarity of at least ``threshold``.

    ``threshold`` is a decimal text, taken exactly. ``vs`` holds distinct values; sets with fewer than ``least``
    values, null and empty sets and null ids take no part. Equal sets must have been
    grouped before. id1 < id2; every pair is verified on the whole sets. ``reps`` is read
    several times and should be a table. The list of frequent tokens goes to all tasks; it has at most FREQUENT_TOKENS entries. Signatures that more than ``hot_sets`` sets share are compared in pairs of blocks of that size.
    """
    t = Fraction(threshold)
    spark = reps.sparkSession
    real = reps.where(F.col("id").isNotNull() & (F.size("vs") >= max(1, least))).select("id", "vs")
    elements, largest = real.agg(F.sum(F.size("vs")), F.max(F.size("vs"))).first()
    bound = max(frequent, (elements or 0) // FREQUENT_TOKENS)
    tokens = real.select(F.explode("vs").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound)
    hot = np.sort(np.array([r[0] for r in tokens.select("v").toLocalIterator()], np.int64))
    shared = spark.sparkContext.broadcast(hot)
    parts = shuffle_width(spark, int((elements or 0) * 3), SIGNATURES_PER_TASK)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_tokens = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            values, lengths = lists(batch.column(1))
            starts = np.cumsum(lengths) - lengths
            out = []
            for size in np.unique(lengths).tolist():
                plan = _plan(size, t, least)
                if not plan:
                    continue
                every = np.flatnonzero(lengths == size)
                for mine in np.array_split(every, max(1, len(every) * size // 200_000)):
                    v = values[starts[mine][:, None] + np.arange(size)]
                    h = mix(v, 1)
                    at = np.searchsorted(frequent_tokens, v)
                    rare = np.ones(v.shape, bool) if not len(frequent_tokens) else frequent_tokens[np.minimum(at, len(frequent_tokens) - 1)] != v
                    sketch = np.bitwise_xor.reduce(np.uint32(1) << (h >> np.uint64(59)).astype(np.uint32), axis=1)
                    row, signature, without = _signatures(h, rare, plan)
                    out.append((signature, ids[mine][row], sketch[row], np.full(len(row), size, np.int64), without))
            if out:
                yield _packed(*(np.concatenate(x) for x in zip(*out)), parts)

    def receive(bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        signature, ids, sketch, size, without = _unpacked(bodies)
        id1, id2, sharing = _candidates(signature, ids, sketch, size, without, t, hot_sets)
        yield _found(id1=id1, id2=id2)
        if (hot := sharing > 0).any():
            key = signature[hot] | TaskContext.get().partitionId() << SIGNATURE_BITS
            yield _found(id1=ids[hot], signature=key, sketch=sketch[hot].astype(np.int64), size=size[hot], without=without[hot] == 1, sharing=sharing[hot])

    short = real if (largest or 0) <= LONG else real.where(F.size("vs") <= LONG)
    found = materialize(exchange(short, send, parts, receive, _FOUND), "candidates")
    pairs, hot_rows = found.where("signature is null").select("id1", "id2"), found.where("signature is not null")
    if not hot_rows.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(hot_rows, t, hot_sets))
    if (largest or 0) > LONG:
        pairs = pairs.unionByName(_long_candidates(real, t))
    pairs = pairs.distinct()
    x = real.select(F.col("id").alias("id1"), F.col("vs").alias("x"))
    y = real.select(F.col("id").alias("id2"), F.col("vs").alias("y"))
    both = pairs.join(x, "id1").join(y, "id2")
    common = F.size(F.array_intersect("x", "y"))
    enough = common * F.lit(t.denominator) >= (F.size("x") + F.size("y") - common) * F.lit(t.numerator)
    return both.where(enough).select("id1", "id2")


def similar_records(records: DataFrame, threshold: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """The join for records ``(id, vs)`` that may have equal sets.

    Gives (members, pairs): members (id, rep, copies) has each record with at least ``least``
    values, the smallest id with its set and the number of such records; pairs (id1, id2)
    are the similar pairs between different representatives. Together they hold every
    link; copies aren't expanded into pairs.
    """
    real = records.where(F.col("id").isNotNull() & (F.size("vs") >= max(1, least))).select("id", "vs")
    groups = materialize(real.groupBy("vs").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "groups")
    several = groups.where(F.col("copies") > 1)
    copies = materialize(real.join(several, "vs").select("id", "rep", "copies"), "copies")
    single = groups.where(F.col("copies") == 1).select(F.col("rep").alias("id"), "rep", "copies")
    return single.unionByName(copies), similar_sets(groups.select(F.col("rep").alias("id"), "vs"), threshold, least)


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair (id1, id2), id1 < id2, that members and pairs stand for."""
    m1 = members.select(F.col("id").alias("a"), F.col("rep").alias("id1"))
    m2 = members.select(F.col("id").alias("b"), F.col("rep").alias("id2"))
    across = pairs.join(m1, "id1").join(m2, "id2").select("a", "b")
    several = members.where(F.col("copies") > 1).select("id", "rep", "copies")
    counts = several.where("id = rep").select("rep", F.col("copies").alias("_rows"))
    within = group_pairs(several, ["rep"], "id", counts=counts).select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"))
