"""The core operators on a small hypergraph with worked answers, and against brute force."""

import random
from collections import defaultdict, deque
from itertools import combinations, product

import numpy as np
import pytest

from edgeweft.operators import bfs, components, coretree, exact, hubs, indexes, landmarks, metrics, oracle, overlap, ranking, sampling, skew
from edgeweft.plans import contract
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def ov(small):
    return overlap.overlaps(small).cache()


@pytest.fixture(scope="module")
def adj(ov):
    return overlap.adjacency(ov, [1, 2]).cache()


def test_overlaps(small, ov):
    assert rows(ov, "e1", "e2", "w") == [(0, 1, 2), (0, 2, 1), (1, 2, 2), (1, 3, 1), (2, 3, 2), (3, 4, 1), (5, 6, 2)]
    assert rows(overlap.overlaps(small, 2), "e1", "e2", "w") == [(0, 1, 2), (1, 2, 2), (2, 3, 2), (5, 6, 2)]


@pytest.mark.parametrize("least,by_prefix", [(1, None), (3, True), (2, False)])
def test_overlaps_against_brute_force(spark, least, by_prefix):
    rng = random.Random(least)
    sets = {e: {rng.choice([0, 1, 2, rng.randrange(30)]) for _ in range(rng.randint(1, 8))} for e in range(60)}
    inc = spark.createDataFrame([(e, v) for e, vs in sets.items() for v in vs], "e bigint, v bigint")
    want = [(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least]
    assert rows(overlap.overlaps(inc, least, by_prefix), "e1", "e2", "w") == sorted(want)


@pytest.mark.parametrize("least,method", [(1, "vertices"), (2, "pairs"), (3, "pairs"), (3, "prefix")])
def test_overlaps_of_hubs_in_blocks(spark, monkeypatch, least, method):
    # a vertex holds a third of all incidences and is joined in blocks
    monkeypatch.setattr(overlap, "BLOCK_EDGES", 6)
    rng = random.Random(least)
    sets = {e: {0, *(rng.choice([1, rng.randrange(12)]) for _ in range(3))} for e in range(50)}
    inc = spark.createDataFrame([(e, v) for e, vs in sets.items() for v in vs], "e bigint, v bigint")
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least)
    assert rows(overlap.overlaps(inc, least, method=method), "e1", "e2", "w") == want
    assert overlap.overlaps(inc.where("false"), least, method=method).count() == 0


def test_group_pairs(spark):
    data = [(k, x) for k in (1, 2) for x in range(25 if k == 1 else 4)] + [(None, 1), (None, 2), (3, None)]
    df = spark.createDataFrame(data, "k int, x bigint")
    want = sorted((k, a, b) for k, n in ((1, 25), (2, 4)) for a in range(n) for b in range(a + 1, n))
    for block in (3, 10, 1000):
        assert rows(skew.group_pairs(df, ["k"], "x", block), "k", "a", "b") == want


def test_counts_and_sizes(small, ov):
    assert overlap.graph_counts(small).first() == (8, 11, 20, 3)
    assert rows(overlap.s_degrees(small, ov, 2), "e", "degree") == [(0, 1), (1, 2), (2, 2), (3, 1), (4, 0), (5, 1), (6, 1)]
    assert rows(overlap.max_membership(small, 2), "e", "max_s")[-1] == (7, 1)
    pairs = small.sparkSession.createDataFrame([(1, 0), (0, 7)], "p bigint, q bigint")
    assert rows(overlap.overlap_of(pairs, ov), "p", "q", "w") == [(0, 7, -1), (1, 0, 2)]


def test_empty_and_nulls(spark):
    inc = overlap.incidence(spark.createDataFrame([(1, None), (None, 2)], "a bigint, b bigint"), "a", "b")
    assert overlap.overlaps(inc).count() == 0
    assert overlap.graph_counts(inc).first()["n_edges"] == 0
    assert components.s_components(inc, overlap.overlaps(inc), [1, 2]).count() == 0


def test_components(small, ov):
    found = components.s_components(small, ov, [1, 2, 3])
    got = defaultdict(set)
    for s, e, cc in rows(found, "s", "e", "cc"):
        got[s, cc].add(e)
    assert got == {(1, 0): {0, 1, 2, 3, 4}, (1, 5): {5, 6}, (1, 7): {7}, (2, 0): {0, 1, 2, 3}, (2, 4): {4}, (2, 5): {5, 6}, (3, 0): {0}, (3, 1): {1}, (3, 2): {2}, (3, 3): {3}, (3, 6): {6}}


@pytest.mark.parametrize("one_task_edges", [0, 10**6])
def test_components_from_the_largest_s_down(spark, one_task_edges):
    rng = random.Random(5)
    pairs = {(a, b): rng.choice([1, 2, 3, 5]) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(70))}
    ov = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "e1 bigint, e2 bigint, w bigint")
    each = [rows(components.connect(overlap.adjacency(ov, [s])), "s", "e", "cc") for s in (1, 2, 3, 4, 5)]
    assert rows(components.connect_levels(ov, [1, 2, 3, 4, 5], one_task_edges), "s", "e", "cc") == sorted(x for some in each for x in some)
    assert components.connect_levels(ov.where("false"), [1, 2], one_task_edges).count() == 0


def test_components_of_chains(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(1, order[i], order[i + 1]) for i in range(199)] + [(2, i, i + 1) for i in range(150)], "s int, e bigint, nb bigint")
    assert {(r.s, r.cc) for r in components.connect(edges).collect()} == {(1, 0), (2, 0)}
    few = edges.where("e < 12 and nb < 12 and s = 2")
    assert rows(components.connect(few, one_task_edges=0), "e", "cc") == [(e, 0) for e in range(12)]


def test_levels_give_what_components_give(adj, spark):
    sources = spark.createDataFrame([(1, 0), (2, 0), (1, 5)], "s int, src bigint")
    targets = sources.select("s", "src", F.lit(4).cast("bigint").alias("e"))
    want = rows(bfs.distances(adj, sources), "s", "src", "e", "dist")
    assert rows(bfs.level_distances(adj, sources), "s", "src", "e", "dist") == want
    assert (1, 0, 4, 3) in rows(bfs.level_distances(adj, sources, targets=targets), "s", "src", "e", "dist")
    pairs = spark.createDataFrame([(1, 0, 3), (1, 0, 5)], "s int, p bigint, q bigint")
    assert rows(bfs._level_paths(adj, pairs, True), "path") == [([0, 1, 3],), ([0, 2, 3],)]
    labels = spark.createDataFrame([(3, "Red"), (4, "RED"), (1, "x")], "e bigint, label string")
    wanted = spark.createDataFrame([(0, "red")], "src bigint, label string")
    for n in (1, 2, 3):
        near, level = (rows(search(adj, sources, labels, wanted, n), "s", "src", "e", "dist") for search in (bfs.nearest_labelled, bfs._level_labelled))
        assert near == level and (1, 0, 3, 2) in near and ((1, 0, 4, 3) in near) == (n > 1)


def test_bfs(adj, spark):
    sources = spark.createDataFrame([(1, 0), (2, 0)], "s int, src bigint")
    assert rows(bfs.distances(adj, sources), "s", "e", "dist") == [(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 0, 0), (2, 1, 1), (2, 2, 2), (2, 3, 3)]
    assert rows(bfs.distances(adj, sources, max_depth=1), "s", "e", "dist") == [(1, 0, 0), (1, 1, 1), (1, 2, 1), (2, 0, 0), (2, 1, 1)]


def test_paths(adj, spark):
    pairs = spark.createDataFrame([(1, 0, 3), (2, 0, 3), (1, 0, 5), (1, 6, 6)], "s int, p bigint, q bigint")
    assert rows(bfs.shortest_paths(adj, pairs, True), "s", "p", "q", "path") == [(1, 0, 3, [0, 1, 3]), (1, 0, 3, [0, 2, 3]), (1, 6, 6, [6]), (2, 0, 3, [0, 1, 2, 3])]
    assert rows(bfs.shortest_paths(adj, pairs, False), "s", "p", "q", "path") == [(1, 0, 3, [0, 1, 3]), (1, 6, 6, [6]), (2, 0, 3, [0, 1, 2, 3])]


def test_closeness(adj, spark):
    sources = spark.createDataFrame([(1, 0), (1, 2)], "s int, src bigint")
    assert dict(rows(exact.edge_closeness(adj, sources), "src", "closeness")) == pytest.approx({0: 4 / 7, 2: 4 / 5})
    assert dict(rows(exact.edge_closeness(adj, sources, compat=True), "src", "closeness")) == pytest.approx({0: 3 / 7, 2: 3 / 5})


def test_profiles(adj, small, spark):
    pairs = spark.createDataFrame([(1, 0, 4), (1, 0, 5), (1, 3, 3)], "s int, p bigint, q bigint")
    assert rows(exact.profiles("edge", adj, small, pairs), "p", "q", "d") == [(0, 4, 3), (3, 3, 0)]
    vertices = spark.createDataFrame([(1, 1, 7), (1, 2, 2), (1, 1, 11)], "s int, u bigint, v bigint")
    assert rows(exact.profiles("vertex", adj, small, vertices), "u", "v", "d") == [(1, 7, 3), (2, 2, 0)]
    with pytest.raises(ValueError):
        exact.profiles("other", adj, small, pairs)


@pytest.fixture(scope="module")
def small_oracle(small, ov, adj, spark):
    members = components.s_components(small, ov, [1, 2]).cache()
    chosen = spark.createDataFrame([(1, 0, 0), (1, 0, 3)], "s int, cc bigint, landmark bigint")
    return oracle.Oracle(members, components.component_sizes(members, small).cache(), chosen, oracle.labels_of(adj, chosen).cache(), 4)


def test_oracle_bounds(small_oracle, spark):
    queries = spark.createDataFrame([(1, 0, 4), (1, 1, 4), (1, 1, 2), (1, 0, 2), (1, 5, 6), (1, 0, 5), (2, 0, 3)], "s int, p bigint, q bigint")
    got = {(s, p, q): (lb, ub, d) for s, p, q, lb, ub, d in rows(oracle.edge_bounds(small_oracle, queries), "s", "p", "q", "lb", "ub", "d_hat")}
    assert got == {(1, 0, 4): (3, 3, 3), (1, 1, 4): (2, 2, 2), (1, 1, 2): (0, 2, 1), (1, 0, 2): (1, 1, 1), (1, 5, 6): (1, 2, 1), (1, 0, 5): (-1, -1, -1), (2, 0, 3): (1, 4, 1.2525)}


def test_oracle_round_trip(small_oracle, spark, tmp_path):
    small_oracle.save(str(tmp_path))
    again = oracle.Oracle.load(spark, str(tmp_path), 4, s=1)
    assert rows(again.labels, "s", "landmark", "e", "dist") == rows(small_oracle.labels, "s", "landmark", "e", "dist")


def random_graph(seed, n=40, m=55):
    rng = random.Random(seed)
    return {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}


def brute_distances(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    out = {}
    for src in near:
        seen, todo = {src: 0}, deque([src])
        while todo:
            x = todo.popleft()
            for y in near[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        out |= {(src, k): d for k, d in seen.items()}
    return out


@pytest.fixture(scope="module")
def searched(spark):
    """A random graph of two s, pairs of its nodes, and their distances."""
    edges = {1: random_graph(1, 26, 32), 2: random_graph(2, 18, 40)}
    adj = spark.createDataFrame([(s, *x) for s, some in edges.items() for a, b in some for x in ((a, b), (b, a))], "s int, e bigint, nb bigint").cache()
    want = {(s, p, q): d for s, some in edges.items() for (p, q), d in brute_distances(some).items() if p % 3 == 0}
    nodes = {s: {x for e in some for x in e} for s, some in edges.items()}
    pairs = spark.createDataFrame([(s, p, q) for s, some in nodes.items() for p in some if p % 3 == 0 for q in some], "s int, p bigint, q bigint").cache()
    return adj, pairs, sorted((*k, d) for k, d in want.items())


def test_exact_indexes(searched):
    adj, pairs, expected = searched
    labels = hubs.hub_labels(adj).cache()
    assert rows(hubs.hub_distances(pairs, labels), "s", "p", "q", "d") == expected
    ranks = hubs.rank_by_degree(adj)
    for batch, growth in ((1, 2), (100, 2)):
        assert rows(hubs.hub_labels_in_batches(adj, ranks, batch, growth), "s", "e", "hub", "d") == rows(labels, "s", "e", "hub", "d")
    top = ranks.where("rank <= 3").select("s", F.col("e").alias("landmark"))
    assert rows(hubs.highway_distances(adj, pairs, top), "s", "p", "q", "d") == expected


@pytest.mark.parametrize("width", [1, 3, 100])
def test_core_and_trees(searched, width):
    adj, pairs, expected = searched
    assert rows(coretree.core_tree_distances(adj, pairs, width), "s", "p", "q", "d") == expected
    labels, core = coretree.split_in_rounds(adj, width)
    units, ranks = coretree.unit_links(core)
    by_rounds = coretree.CoreTree(labels, hubs.hub_labels(units, ranks).where("e >= 0"))
    assert rows(by_rounds.distances(pairs), "s", "p", "q", "d") == expected
    assert core.where("w > 1").isEmpty() == (width in (1, 100)) and (width < 100 or core.isEmpty())


def test_bit_parallel_labels(searched):
    adj, pairs, expected = searched
    real = {x[:3]: x[3] for x in expected}
    few = rows(hubs.bit_parallel_bounds(pairs, hubs.bit_parallel_labels(adj, 1, 2)), "s", "p", "q", "ub")
    assert all(ub >= real[s, p, q] for s, p, q, ub in few)
    labels = hubs.bit_parallel_labels(adj, 4)
    near = {(s, p, q): ub for s, p, q, ub in rows(hubs.bit_parallel_bounds(pairs, labels), "s", "p", "q", "ub")}
    sources = labels.select("s", "root").distinct()
    marked = adj.join(sources.withColumnRenamed("root", "e"), ["s", "e"]).select("s", F.col("nb").alias("e")).union(sources)
    assert all(near[k] == d for k, d in real.items() if (k[0], k[1]) in set(rows(marked, "s", "e")) and k in near)


def test_indexes_are_stored(searched, spark, tmp_path):
    adj, pairs, expected = searched
    top = hubs.rank_by_degree(adj).where("rank <= 2").select("s", F.col("e").alias("landmark"))
    for kind in indexes.KINDS:
        built = indexes.build(kind, adj, top, width=2)
        built.save(str(tmp_path))
        again = indexes.Index.load(spark, str(tmp_path), kind)
        assert rows(again.distances(pairs), "s", "p", "q", "d") == rows(built.distances(pairs), "s", "p", "q", "d") and again.size() == built.size() > 0
        if kind != "bits":
            assert rows(indexes.Index.load(spark, str(tmp_path), kind, s=2).distances(pairs.where("s = 2")), "s", "p", "q", "d") == [x for x in expected if x[0] == 2]
    answers = indexes.answered(pairs, built.distances(pairs))
    stats = {r.s: r for r in indexes.distance_statistics(answers).collect()}
    assert stats[1].n_queries == pairs.where("s = 1").count() and stats[1].n_answered == sum(x[0] == 1 for x in expected)
    with pytest.raises(ValueError):
        indexes.build("other", adj)
    with pytest.raises(ValueError):
        indexes.build("highway", adj)


def test_full_budget_is_exact(small, spark):
    built = oracle.build(small, [1, 2], budget_per_edge=100, lb=0)
    queries = spark.createDataFrame([(1, p, q) for p in range(5) for q in range(5)], "s int, p bigint, q bigint")
    assert all(r.lb == r.ub == r.d_hat for r in oracle.edge_bounds(built, queries).collect() if r.p != r.q)


@pytest.mark.parametrize("strategy", ["farthest", "bestcover", "between"])
def test_bounds_hold_for_every_strategy(spark, strategy):
    rng = random.Random(7)
    inc = spark.createDataFrame(sorted({(e, rng.randrange(14)) for e in range(24) for _ in range(3)}), "e bigint, v bigint").cache()
    built = oracle.build(inc, [2], budget_per_edge=2, lb=2, strategy=strategy, alpha=0.2, beta=0.6)
    adj = overlap.adjacency(overlap.overlaps(inc), [2])
    pairs = built.components.where("e % 5 = 0").select("s", F.col("e").alias("p"), F.col("cc").alias("q"))
    real = {(s, p, q): d for s, p, q, d in rows(exact.edge_profiles(adj, pairs), "s", "p", "q", "d")}
    for s, p, q, lb, ub in rows(oracle.edge_bounds(built, pairs), "s", "p", "q", "lb", "ub"):
        if lb >= 0 and p != q:
            assert lb <= real[s, p, q] <= ub


@pytest.mark.parametrize("assignment", ["sampling", "ranking"])
def test_assignment_keeps_budget(spark, assignment):
    sizes = spark.createDataFrame([(1, 0, 50, 70), (1, 60, 20, 25), (2, 0, 30, 40), (2, 70, 6, 6), (2, 90, 2, 2)], "s int, cc bigint, size bigint, n_vertices bigint")
    got = landmarks.assign_by_sampling(sizes, 300, 0.2, 0.6, 4) if assignment == "sampling" else landmarks.assign_by_ranking(sizes, 300, 4, 0.5, 0.5)
    found = got.collect()
    assert found and all(0 < r.n <= r.size and r.size > 4 for r in found)
    assert sum(r.n * r.size for r in found) <= (300 if assignment == "ranking" else 450)
    assert landmarks.assign_by_sampling(sizes, 10**6, 0.2, 0.6, 4).where("n <> size").count() == 0
    with pytest.raises(ValueError):
        landmarks.importance(sizes, 0.8, 0.5)


def test_ranks_over_many_tasks(spark):
    members = spark.range(500).selectExpr("1 as s", "if(id < 400, 0L, 400L) as cc", "id as e", "if(id < 400, 7, 3) as n")
    order = [F.pmod(F.col("e") * 37, F.lit(101)).desc(), F.col("e")]
    assert rows(landmarks.by_rank(members, order, 40), "cc", "landmark") == rows(landmarks.by_rank(members, order), "cc", "landmark")
    got = rows(landmarks.numbered(members, "cc", ["e"]), "cc", "e", "number")
    assert got == [(0, e, e + 1) for e in range(400)] + [(400, e, e - 399) for e in range(400, 500)]


def test_running_total(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "k bigint, x double")
    got = landmarks.running_total(df, ["k"], "x", rows_per_task=60)
    total = 0.0
    for k, x, upto in rows(got, "k", "x", "upto"):
        total += x
        assert upto == pytest.approx(total)


def test_consensus():
    assert ranking.consensus([[3, 1, 2], [3, 1, 2], [1, 2, 3]], [1, 1, 0.5]) == [[1], [2], [0]]
    assert ranking.consensus([[1, 1, 1]], [1]) == [[0, 1, 2]]


def test_consensus_against_all_rankings():
    def cost(position, rankings, weights):
        total = 0.0
        for i, j in combinations(range(len(position)), 2):
            for r, w in zip(rankings.tolist(), weights):
                a, b = (position[i] > position[j]) - (position[i] < position[j]), (r[i] > r[j]) - (r[i] < r[j])
                total += w if a * b < 0 or (a == 0) != (b == 0) else 0
        return total

    rng = random.Random(2)
    for _ in range(6):
        rankings, weights = np.array([[rng.randrange(4) for _ in range(5)] for _ in range(3)]), [1.0, 0.5, 0.25]
        dense = np.stack([ranking.dense_ranks(r.tolist()) for r in rankings])
        costs = ranking.Costs(dense, weights)
        for position in product(range(3), repeat=5):
            assert costs.of(np.array(position)) == pytest.approx(cost(position, rankings, weights))
        found = ranking.consensus(rankings.tolist(), weights)
        at = [next(b for b, some in enumerate(found) if i in some) for i in range(5)]
        assert cost(at, rankings, weights) <= min(cost(r, rankings, weights) for r in rankings.tolist()) + 1e-9


def test_ranking_of_many_classes(spark):
    sizes = spark.range(5, 600).selectExpr("1 as s", "id as cc", "id as size", "id * 2 as n_vertices")
    got = landmarks.assign_by_ranking(sizes, 3000, 4, 0.5, 0.5).collect()
    assert got and sum(r.n * r.size for r in got) <= 3000 and max(r.size for r in got) == 599


def test_refined(spark):
    p = spark.createDataFrame([(1, 1, 2, 1.0, 9.0, 5.0), (2, 1, 2, 0.0, 7.0, 4.0), (3, 1, 2, 2.0, -1.0, -1.0)], "s int, p bigint, q bigint, lb double, ub double, d_hat double")
    assert rows(oracle.refined(p), "s", "lb", "ub") == [(1, 1.0, 7.0), (2, 1.0, 7.0), (3, 2.0, -1.0)]


def test_error_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, -1.0), (None, 3.0), (-1.0, 2.0)], "d double, h double")
    r = metrics.error_metrics(df, [], "d", "h").first()
    assert (r.n, r.mae, r.l1) == (2, 1.5, 3.0)


def test_sampling(spark):
    df = spark.range(50).select(F.col("id").alias("e"))
    assert sampling.select_items(df, "e", 0, 1).count() == 0
    assert sampling.select_items(df, "e", 80, 1).count() == 50
    pairs = sampling.sample_pairs(df, [], "e", F.lit(5), 4)
    assert pairs.count() == 3
    members = spark.createDataFrame([(1, e, 0) for e in range(5)] + [(1, 9, 9)], "s int, e bigint, cc bigint")
    assert rows(sampling.pairs_within(members, 100, 4), "p", "q") == [(a, b) for a in range(5) for b in range(a + 1, 5)]
    assert sampling.pairs_within(members, 3, 4).count() == 3


def test_pairs_within_unlike_components(spark):
    members = spark.range(300 * 3 + 100).selectExpr("1 as s", "id as e", "if(id < 900, id - id % 3, 900) as cc")
    pairs = sampling.pairs_within(members, 10_000, 4)
    assert pairs.distinct().count() == pairs.count() == 300 * 3 + 100 * 99 // 2
    assert sampling.pairs_within(members, 5_000, 4).distinct().count() == 5_000


def test_guards_raise_instead_of_cutting(spark, monkeypatch):
    chain = spark.range(6).selectExpr("1 as s", "id as e", "id + 1 as nb")
    both = chain.union(chain.selectExpr("s", "nb", "e"))
    source = spark.createDataFrame([(1, 0)], "s int, src bigint")
    labels, wanted = both.selectExpr("e", "'x' as label"), source.selectExpr("src", "'x' as label")
    monkeypatch.setattr(bfs, "MAX_LEVELS", 6)
    assert bfs.level_distances(both, source).count() == 7
    assert bfs._level_labelled(both, source, labels, wanted, 100).count() == 6
    monkeypatch.setattr(bfs, "MAX_LEVELS", 5)
    assert bfs.level_distances(both, source, max_depth=5).count() == 6
    with pytest.raises(RuntimeError):
        bfs.level_distances(both, source)
    with pytest.raises(RuntimeError):
        bfs._level_labelled(both, source, labels, wanted, 100)
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.connect(both, one_task_edges=0)


@pytest.mark.parametrize("max_classes", [3, None])
def test_ranking_charges_real_sizes(spark, max_classes):
    sizes = spark.range(5, 30).selectExpr("1 as s", "id as cc", "id as size", "id * 2 as n_vertices")
    every = sum(x * x for x in range(5, 30))
    got = rows(landmarks.assign_by_ranking(sizes, every, 4, 0.5, 0.5, max_classes), "size", "n")
    assert got == [(x, x) for x in range(5, 30)]
    part = rows(landmarks.assign_by_ranking(sizes, every // 3, 4, 0.5, 0.5, max_classes), "size", "n")
    assert every // 3 - 30 <= sum(x * n for x, n in part) <= every // 3


def test_queries_of_all_rows(spark, tmp_path):
    lines = [(e, v) for e in range(1, 31) for v in (e // 6, 100 + e // 6, 200 + e)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    run = lambda name: contract.QUERIES[name](spark, str(tmp_path))
    assert rows(run("h1_edges_of_vertices_all"), "v", "e") == sorted((v, e) for e, v in lines)
    assert run("h1_overlap_of_pairs_all").count() == 29
    vertices = {v for _, v in lines}
    assert run("h1_common_edge_pairs_all").count() == run("h1_vertex_closeness_approx_all").count() == len(vertices)
    assert rows(run("h1_closeness_approx_all"), "s", "e") == [(s, e) for s in (2, 3) for e in range(1, 31)]
