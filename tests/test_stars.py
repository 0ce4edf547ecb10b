import random

import pytest
from pyspark.sql import functions as F

from edgeweft.operators import components, overlap, stars
from edgeweft.plans import catalogue


def found(df):
    return sorted(map(tuple, df.select("s", "e", "cc").collect()))


def random_rows(spark, seed, edges, vertices, n):
    rng = random.Random(seed)
    some = [(rng.randrange(-5, edges), rng.randrange(-5, vertices)) for _ in range(n)]
    return spark.createDataFrame([*some, *some[: n // 10], (None, 1), (1, None)], "e bigint, v bigint")


@pytest.mark.parametrize(
    "seed, edges, vertices, n, s_values, bounds",
    [(0, 60, 25, 220, [1, 2, 3, 4], {}), (1, 40, 8, 200, [5, 2, 3], {}), (0, 60, 90, 220, [1, 2], {"one_task_vertices": 0}), (2, 30, 12, 100, [1, 3], {"rows_per_task": 7})],
)
def test_stars_give_what_overlaps_give(spark, seed, edges, vertices, n, s_values, bounds):
    rows = random_rows(spark, seed, edges, vertices, n)
    inc = overlap.incidence(rows, "e", "v")
    assert found(stars.s_components(rows, s_values, **bounds)) == found(components.s_components(inc, overlap.overlaps(inc), s_values))


def test_large_hyperedges_are_not_listed_by_pairs(spark, monkeypatch):
    rows = random_rows(spark, 3, 12, 40, 300)
    inc = overlap.incidence(rows, "e", "v")
    want = found(components.s_components(inc, overlap.overlaps(inc), [1, 2, 4]))
    monkeypatch.setattr(stars, "MOST_VERTICES", 10)
    monkeypatch.setattr(stars, "shared_pairs", None)
    assert found(stars.s_components(rows, [1, 2, 4])) == want


def test_stars_without_rows(spark):
    rows = spark.createDataFrame([(1, None), (None, 2)], "e bigint, v bigint")
    assert stars.s_components(rows, [1, 2, 3]).count() == 0


def test_components_from_one_vertex_on_list_no_pairs_of_hyperedges(spark, tmp_path, monkeypatch):
    """3,000 hyperedges with one common vertex are 4,498,500 pairs, and 2,999 links of a star."""
    lines = spark.range(3000).select(F.col("id").alias("l_orderkey"), F.explode(F.array(F.lit(-1).cast("bigint"), F.col("id") % 2 + 10, F.col("id") + 100)).alias("l_partkey"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    lines.select(F.col("l_orderkey").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    asked, count = [], overlap.overlaps

    def counted(inc, min_overlap=1, *more):
        asked.append(min_overlap)
        return count(inc, min_overlap, *more)

    monkeypatch.setattr(overlap, "overlaps", counted)
    got = catalogue.QUERIES["h1_components_all_s"](spark, str(tmp_path))
    assert found(got.groupBy("s", "cc").agg(F.count("e").alias("e"))) == [(1, 3000, 0), (2, 1500, 0), (2, 1500, 1), *((3, 1, e) for e in range(3000))]
    assert all(s > 2 for s in asked)
