"""Readers, writers, scalar functions, streaming and the skew operators."""

import pytest

from edgeweft.functions import scalars
from edgeweft.operators import skew
from edgeweft.sources import files, lines, sinks
from edgeweft.streaming import arrivals
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_hypergraph_file(spark, tmp_path):
    path = tmp_path / "a.hg"
    path.write_text("1 2 2\n\n3  4\r\n5")
    assert rows(files.read_hypergraph(spark, str(path)), "e", "v") == [(0, 1), (0, 2), (2, 3), (2, 4), (3, 5)]
    assert rows(files.read_vertex_map(spark, str(path)), "v", "edges")[0] == (1, [0])


def test_hypergraph_files_in_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(f"{i} {name == 'b':d}00000{i}\n" for i in range(2000)) + "7")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = files.read_hypergraph(spark, str(tmp_path))
        for name in ("a", "b"):
            assert rows(got.where(f"file like '%/{name}' and e = v"), "e") == [(i,) for i in range(2000)]
        assert rows(got.where("e = 2000"), "e", "v") == [(2000, 7), (2000, 7)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_logs_and_condensed_graphs(spark, tmp_path):
    (tmp_path / "hl").write_text("HyperGraph L IndexTime(ms) QueryTime(ms) HL-d\ng 10 1.5 0.2 3\ng 10 1.5 x -1\n")
    assert rows(files.read_highway_log(spark, str(tmp_path / "hl")), "landmarks", "d") == [(10, -1), (10, 3)]
    (tmp_path / "ctl").write_text("a b c d e f\ng 2 7.5 4 1 9\n")
    assert rows(files.read_core_tree_log(spark, str(tmp_path / "ctl"), 10), "s", "micros", "d", "dst", "width") == [(2, 7.5, 4, 9, 10)]
    (tmp_path / "g").write_text("1 2 9\n1 3 9\n4 2 1\n4 3 1\n5 5 1\n3 x 1\nnote\n1 6 2\n2 1 0\n4 6 5\n6 7 1\n")
    edges = files.same_width_lines(spark, str(tmp_path / "g"))
    assert rows(edges, "u", "v") == [(1, 2), (1, 3), (1, 6), (2, 4), (3, 4), (4, 6), (6, 7)]
    kept, ids = files.condensed(edges)
    assert rows(kept, "u", "v") == [(0, 1), (0, 2), (1, 3)]
    new = dict(rows(ids, "old", "new"))
    assert new[2] == new[3] and new[1] == new[4] and len(set(new.values())) == 4
    (tmp_path / "none").write_text("")
    assert files.same_width_lines(spark, str(tmp_path / "none")).count() == 0


def test_query_files(spark, tmp_path):
    (tmp_path / "p").write_text("1 2\n1 2\n3 3\n")
    (tmp_path / "e").write_text("5\n5\n x\n")
    (tmp_path / "l").write_text("x-y-12\tRed\n7\tblue\n")
    assert rows(files.read_pairs(spark, str(tmp_path / "p")), "p", "q") == [(1, 2), (3, 3)]
    assert rows(files.read_distance_queries(spark, str(tmp_path / "p")), "p", "q") == [(1, 2), (1, 2)]
    assert files.read_elements(spark, str(tmp_path / "e")).where("id = 5").count() == 2
    assert rows(files.read_labels(spark, str(tmp_path / "l")), "id", "label") == [(7, "blue"), (12, "Red")]


def test_edge_lists(spark, tmp_path):
    (tmp_path / "g").write_text("10 20\n20 10\n5 5\n-1 3\nn m\n30 20\n1 2 3\n")
    edges = files.read_edge_list(spark, str(tmp_path / "g"))
    assert rows(edges, "u", "v") == [(10, 20), (20, 30)]
    ids = files.dense_ids(edges)
    assert rows(ids, "old", "new") == [(10, 0), (20, 1), (30, 2)]
    assert rows(files.remapped(edges, ids), "u", "v") == [(0, 1), (1, 2)]
    assert rows(files.ranked_ids(edges), "old", "new") == [(10, 1), (20, 0), (30, 2)]
    assert rows(files.first_seen_ids(edges.withColumn("at", F.col("v")), "at"), "old", "new") == [(10, 0), (20, 1), (30, 2)]


def test_result_files(spark, tmp_path):
    approx = spark.createDataFrame([(1, 2, 1, 1.0, 3.0, 2.0)], "p bigint, q bigint, s int, lb double, ub double, d_hat double")
    real = spark.createDataFrame([(1, 2, 1, 2), (1, 3, 1, 4)], "p bigint, q bigint, s int, d int")
    sinks.write_profiles(approx, real, str(tmp_path / "r"))
    assert rows(files.read_profiles(spark, str(tmp_path / "r")), "p", "q", "d", "lb", "d_hat") == [(1, 2, 2.0, 1.0, 2.0), (1, 3, 4.0, -1.0, -1.0)]
    assert sinks.merged_profiles(approx, None).first()["d"] == 2.0
    a = spark.createDataFrame([(1, 5, 1, 9)], "s int, q bigint, rank int, e bigint")
    assert rows(sinks.merged_top_k(a, a.where("false"), 2), "rank", "approx", "real") == [(1, 9, -1), (2, -1, -1)]
    c = spark.createDataFrame([(1, 0.5)], "id bigint, value double")
    sinks.write_centralities(c, None, str(tmp_path / "c"))
    assert rows(files.read_centralities(spark, str(tmp_path / "c")), "id", "real", "approx") == [(1, 0.5, 0.5)]
    assert sinks.profile_maps(approx).first()["profile"][1]["ub"] == 3.0
    line = spark.createDataFrame([(1, 2, 1), (1, 2, 2)], "u bigint, v bigint, s int")
    sinks.write_line_graph(line, str(tmp_path / "lg"))
    assert files.read_edge_list(spark, str(tmp_path / "lg/s=1"), ",").count() + 1 and (tmp_path / "lg/s=2").exists()


def test_scalars(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0], [2.0, 0.0, 1.0], {"a": 2, "b": 1}, " 1.5K", "13.05.2024 10:00:00")], "a array<double>, b array<double>, m map<string,int>, z string, t string")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        scalars.dot(a, b), scalars.abs_differences(a, b), scalars.cumulative(a), scalars.arg_max(a), scalars.arg_min(b), scalars.capped_intersection(a, b, 1), scalars.contains_all(a, F.array(F.lit(5.0))),
        scalars.size_number(F.col("z")), scalars.flexible_timestamp(F.col("t")).cast("string"), scalars.base_name(F.lit("x/y/graph.hg")), scalars.rounded_text(F.lit(1.256), 2), scalars.array_sum(scalars.scaled(a, 2.0)),
    ).first()
    assert tuple(got) == (7.0, [1.0, 5.0, 4.0], [1.0, 6.0, 11.0], 1, 1, 1, True, 1536.0, "2024-05-13 10:00:00", "graph", "1.26", 22.0)
    assert df.select(scalars.sorted_map(F.col("m"))).first()[0][0]["key"] == "b"
    assert df.select(scalars.renamed(F.lit("x"), {"x": "X"})).first()[0] == "X"


def test_line_records(spark):
    df = spark.createDataFrame([(1, "AB12, ab12\n_7;x"), (2, None), (3, "none"), (4, "99999999999999999999 3")], "id bigint, edge string")
    assert rows(lines.line_records(df), "id", "tokens", "vs") == [(1, [7, 12, 12], [7, 12]), (4, [3], [3])]


def test_arrivals(spark, tmp_path):
    df = spark.createDataFrame([(1, "1 2", "a"), (2, "2 3 4", "a"), (3, "x", "b")], "id bigint, edge string, dataset string").withColumn("loaded_at", F.timestamp_seconds(F.lit(0)))
    df.write.parquet(str(tmp_path / "in"))
    stream = arrivals.read_lines(spark, str(tmp_path / "in"), df.schema)
    q = arrivals.arrivals(stream).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("arrived"), "dataset", "n_records", "n_incidences") == [("a", 2, 5)]
    q = arrivals.keep_incidence(arrivals.read_lines(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


DATA = [("a", i % 5) for i in range(100)] + [("b", 1), ("b", 2), ("b", None), (None, 3), (None, 3)]


def test_skewed_keys(spark):
    df = spark.createDataFrame(DATA, "k string, x bigint").withColumn("freq", F.lit(1))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, skew.distinct_sizes(df, ["k"], "x").collect()), key=key) == [("a", 5, 100), ("b", 3, 3), (None, 1, 2)]
    assert sorted(map(tuple, skew.modes(df, ["k"], "x").collect()), key=key) == [("a", 0, 20), ("b", 1, 1), (None, 3, 2)]
    got = skew.percentiles(df, ["k"], "x", [0.5, 1.0], rows_per_task=2)
    assert sorted(map(tuple, got.collect()), key=key) == [("a", 0.5, 2), ("a", 1.0, 4), ("b", 0.5, 1), ("b", 1.0, 2), (None, 0.5, 3), (None, 1.0, 3)]
    assert skew.heavy_keys(df, ["k"], "x", 0.5).select("k").collect() == [("a",)]
    empty = df.where("false")
    assert [f(empty, ["k"], "x").count() for f in (skew.distinct_sizes, skew.modes)] == [0, 0]
    assert skew.heavy_keys(empty, ["k"], "x", 0.5).count() == 0
    assert skew.percentiles(empty, ["k"], "x", [0.5]).count() == 0


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_skewed_lookup(spark, hot):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (3, 8), (None, 9)], "k bigint, v bigint")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k bigint, name string")
    got = skew.skewed_lookup(left, right, ["k"], "v", hot_rows=max(1, hot))
    assert rows(got, "k", "v", "name") == sorted([(1, i, "x") for i in range(50)] + [(2, 7, "y")])
    assert skew.skewed_lookup(left, right, ["k"], "v", hot_rows=max(1, hot), how="left").count() == 53
