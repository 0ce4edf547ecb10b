"""Groups of matches, overlaps, similar sets, top items, copies and pairs against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from edgeweft.llm import audiences, components, copies, setjoin, together, topn
from edgeweft.operators import skew
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def brute_components(links):
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for s, u, v in links:
        if s is None or u is None or v is None or u == v or min(u, v) < 0:
            continue
        for x in ((s, u), (s, v)):
            up.setdefault(x, x)
        a, b = sorted((find((s, u)), find((s, v))))
        up[b] = a
    return sorted((s, e, find((s, e))[1]) for s, e in up)


@pytest.mark.parametrize("bound", [25, 10**6])
def test_linked_groups(spark, bound):
    rng = random.Random(bound)
    hub = [(1, 500, i) for i in range(500, 620)]
    chain = [(2, i, i + 1) for i in range(150)]
    loose = [(rng.choice([1, 2, None]), rng.choice([None, -1, rng.randrange(200)]), rng.randrange(200)) for _ in range(150)]
    links = hub + chain + loose + [(v, u, s) for s, u, v in []]
    links += links[:30] + [(s, v, u) for s, u, v in links[:30]]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "s int, u bigint, v bigint").withColumn("cc", F.lit("x")).repartition(5)
    assert rows(components.linked_groups(df, bound), "s", "e", "cc") == brute_components(links)


def test_linked_groups_empty(spark):
    assert components.linked_groups(spark.createDataFrame([(1, 2, 2), (None, 1, 2)], "s int, u bigint, v bigint")).count() == 0


def test_overlap_sizes(spark):
    rng = random.Random(5)
    sets = {f"d{i}": {rng.choice([7, 8, rng.randrange(200_000), rng.randrange(100)]) for _ in range(rng.randint(1, 80))} for i in range(70)}
    data = [(d, v) for d, vs in sets.items() for v in vs] + [(None, 7), ("d1", None), ("d1", -5)]
    data += data[:50]
    df = spark.createDataFrame(data, "ds string, v bigint").withColumn("w", F.lit("x"))
    pairs, sizes = audiences.overlap_sizes(df)
    want = sorted((a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b])
    assert rows(pairs, "ds1", "ds2", "shared") == want
    assert dict(rows(sizes, "ds", "size")) == {d: len(v) for d, v in sets.items()}
    assert rows(audiences.overlap_sizes(df, 9)[0], "ds1", "ds2", "shared") == want
    strong = rows(audiences.strong_overlaps(df, 3, 10), "ds1", "ds2")
    assert strong == [(a, b) for a, b, n in want if 10 * n >= 3 * min(len(sets[a]), len(sets[b]))]
    assert audiences.strong_overlaps(df.where("false"), 3, 10).count() == 0


def jaccard_pairs(records, t, least):
    return sorted((a, b) for a, b in combinations(sorted(records), 2) if min(len(records[a]), len(records[b])) >= least and len(records[a] & records[b]) >= t * len(records[a] | records[b]) - 1e-12)


@pytest.mark.parametrize("t,least,frequent", [("0.7", 4, 256), ("0.7", 4, 2), ("0.5", 1, 3), ("0.8", 2, 1), ("0.9", 1, 256)])
def test_similar_sets(spark, t, least, frequent):
    rng = random.Random(f"{t} {frequent}")
    records = {}
    for i in range(0, 400, 2):
        base = {rng.choice([1, 2, 3, rng.randrange(50)]) for _ in range(rng.randint(1, 28))}
        other = {x for x in base if rng.random() > 0.1} | {rng.randrange(50) for _ in range(rng.randint(0, 2))} or {1}
        records[i], records[i + 1] = base, other
    df = spark.createDataFrame([(i, sorted(v)) for i, v in records.items()] + [(1000, None), (1001, []), (None, [1, 2])], "id bigint, vs array<bigint>").withColumn("rep", F.lit(1))
    members, pairs = setjoin.similar_records(df, t, least)
    assert rows(setjoin.expand(members, pairs), "id1", "id2") == jaccard_pairs(records, float(t), least)
    reps = {}
    for i, v in records.items():
        reps.setdefault(frozenset(v), i)
    unique = spark.createDataFrame([(i, sorted(v)) for v, i in reps.items()], "id bigint, vs array<bigint>")
    want = jaccard_pairs({i: set(v) for v, i in reps.items()}, float(t), least)
    assert rows(setjoin.similar_sets(unique, t, least, frequent), "id1", "id2") == want


def test_hot_signatures_and_copies_are_split(spark):
    # ten frequent tokens, so that signatures gather many sets, and a set with many copies
    rng = random.Random(11)
    records = {i: {rng.randrange(10) for _ in range(rng.randint(4, 9))} for i in range(120)} | {1000 + i: set(range(50, 55)) for i in range(40)}
    df = spark.createDataFrame([(i, sorted(v)) for i, v in records.items()], "id bigint, vs array<bigint>")
    members, pairs = setjoin.similar_records(df, "0.7", 4)
    want = jaccard_pairs(records, 0.7, 4)
    assert rows(setjoin.expand(members, pairs), "id1", "id2") == want
    several = members.where("copies > 1").select("id", "rep")
    got = rows(skew.group_pairs(several, ["rep"], "id", block_rows=7), "a", "b")
    assert got == sorted((a, b) for a, b in want if records[a] == records[b])
    reps = df.groupBy("vs").agg(F.min("id").alias("id")).select("id", "vs").cache()
    split = setjoin.similar_sets(reps, "0.7", 4, hot_sets=3)
    assert rows(split, "id1", "id2") == rows(pairs, "id1", "id2")
    plans = [x._jdf.queryExecution().toString() for x in (split, setjoin.similar_sets(reps, "0.7", 4))]
    assert "Generate" in plans[0] and "Generate" not in plans[1]  # only the first has hot signatures


def test_similar_long_sets_and_copies(spark):
    long = list(range(1000, 1300))
    data = [(1, long), (2, long[5:]), (3, long[100:]), (4, long), (5, long), (6, [1])]
    members, pairs = setjoin.similar_records(spark.createDataFrame(data, "id bigint, vs array<bigint>"), "0.9")
    assert rows(members.where("copies > 1"), "id", "rep") == [(1, 1), (4, 1), (5, 1)]
    assert rows(setjoin.expand(members, pairs), "id1", "id2") == [(1, 2), (1, 4), (1, 5), (2, 4), (2, 5), (4, 5)]
    none = spark.createDataFrame([], "id bigint, vs array<bigint>")
    assert [x.count() for x in setjoin.similar_records(none, "0.7")] == [0, 0]


def test_similar_very_long_sets(spark):
    long = list(range(70_000))
    data = [(1, long), (2, long[20_000:]), (3, long[22_000:]), (4, long[:-5]), (5, list(range(5))), (6, list(range(1, 6)))]
    data += [(7, list(range(100_000, 100_600))), (8, list(range(100_000, 100_420))), (9, list(range(100_000, 100_419))), (10, long[1:] + [-1])]
    df = spark.createDataFrame(data, "id bigint, vs array<bigint>")
    want = jaccard_pairs({i: set(v) for i, v in data}, 0.7, 4)
    assert (7, 8) in want and (7, 9) not in want and (1, 2) in want and (1, 3) not in want
    assert rows(setjoin.similar_sets(df, "0.7", 4), "id1", "id2") == want


@pytest.mark.parametrize("heavy", [1, 30, 1000])
def test_top_items(spark, heavy):
    rng = random.Random(heavy)
    data = [(1, 10, rng.randrange(300), rng.randrange(6)) for _ in range(500)] + [(rng.choice([1, 2, None]), rng.randrange(9), rng.randrange(30), rng.choice([None, rng.randrange(4)])) for _ in range(200)]
    data += data[:40] + [(1, 10, None, 99)]
    best = {}
    for s, c, e, n in data:
        if e is not None and n is not None:
            best[s, c, e] = max(n, best.get((s, c, e), -1))
    want = []
    groups = defaultdict(list)
    for (s, c, e), n in best.items():
        groups[s, c].append((-n, e))
    for (s, c), items in groups.items():
        want += [(s, c, e, -n) for n, e in sorted(items)[:5]]
    df = spark.createDataFrame(data, "s int, cc bigint, e bigint, num int").withColumn("_n", F.lit(1))
    got = [tuple(r) for r in topn.top_items(df, ["s", "cc"], "e", "num", 5, heavy).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert topn.top_items(df.where("false"), ["s", "cc"], "e", "num", 5, heavy).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_copy_groups(spark, hot):
    rng = random.Random(hot)
    data = [(i, [7, 7, 9]) for i in range(100)] + [(1000 + i, [rng.randrange(4), rng.randrange(4)]) for i in range(60)] + [(5000, [7, 9]), (6000, None), (7000, [])]
    df = spark.createDataFrame(data, "id bigint, tokens array<bigint>").withColumn("key", F.lit("clash"))
    groups = defaultdict(list)
    for i, t in data:
        if t is not None:
            groups[tuple(t)].append(i)
    want = sorted((i, min(g), len(g)) for g in groups.values() for i in g)
    assert rows(copies.copy_groups(df, "tokens", hot), "id", "keep_id", "copies") == want
    assert copies.copy_groups(df.where("false"), "tokens", hot).count() == 0


def test_hot_copies_are_spread(spark):
    # one key holds a third of all records: its salts are rows of the first level
    df = spark.range(9000).selectExpr("id", "if(id % 3 = 0, array(1L, 2L), array(id)) as tokens")
    found = copies.copy_groups(df, "tokens")
    assert found.where("copies = 3000 and keep_id = 0").count() == 3000 and found.where("copies = 1 and keep_id = id").count() == 6000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan and plan.count("Window") == 1


@pytest.mark.parametrize("chunk,large", [(2, 4), (5, 1), (1000, 4), (1000, 0), (1000, 1e9)])
def test_associations(spark, chunk, large):
    rng = random.Random(chunk)
    baskets = {i: {rng.randrange(12) for _ in range(rng.randint(1, 5))} | ({100, 101} if i % 5 == 0 else set()) | {200} for i in range(80)}
    baskets[500] = set(range(40)) | {100, 101}
    n = len(baskets) + 2
    single, pairs = Counter(), Counter()
    for b in baskets.values():
        single.update(b)
        pairs.update(combinations(sorted(b), 2))
    want = sorted((a, b, single[a], single[b], k) for (a, b), k in pairs.items() if k >= 3 and k * n / (single[a] * single[b]) >= 1.2)
    df = spark.createDataFrame([(i, sorted(b)) for i, b in baskets.items()] + [(900, None), (901, [])], "id bigint, vs array<bigint>").withColumn("v", F.lit("x"))
    got = together.associations(df, 3, 1.2, chunk, large)
    assert rows(got, "v1", "v2", "n1", "n2", "n12") == want
    assert want and together.associations(df.where("false"), 3, 1.2, chunk).count() == 0


@pytest.mark.parametrize("chunk", [2, 1000])
def test_associations_of_repeated_rows(spark, chunk):
    data = [(1, [1, 2]), (1, [2, 3, 3]), (1, [1, 2]), (2, [1, 2]), (3, [1, 2, 3]), (4, [9]), (4, [9]), (5, None), (5, []), (None, [7, 8]), (None, [8, 7])]
    df = spark.createDataFrame(data, "id bigint, vs array<bigint>")
    got = together.associations(df, 1, 1.0, chunk)
    want = [(1, 2, 3, 3, 3, 2.0), (1, 3, 3, 2, 2, 2.0), (2, 3, 3, 2, 2, 2.0), (7, 8, 1, 1, 1, 6.0)]
    assert rows(got, "v1", "v2", "n1", "n2", "n12", "ratio") == want
