"""Files written and read back, and expressions, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import exact, oracle, overlap
from ..session import folder
from ..sources import files, sinks
from ..sources.lines import table
from . import contract, views
from .contract import query
from .views import COMPONENTS, H1, ORACLE, PAIRS, REACHED, Graph, bounds_sql, graph_sql


@query("io_hypergraph", f"WITH {H1}, n AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS line FROM (SELECT DISTINCT e FROM inc)) SELECT line AS e, v FROM inc JOIN n USING (e)")
def _(spark, d):
    # the format is one file whose line numbers are the ids
    at = folder(spark, "hypergraph")
    sets = overlap.edge_sets(views.h1(spark, d)).coalesce(1).sortWithinPartitions("e")
    sets.select(F.concat_ws(" ", F.col("vertices").cast("array<string>")).alias("line")).write.text(at)
    return files.read_hypergraph(spark, at).select("e", "v")


@query("io_vertex_map", f"WITH {H1}, n AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS line FROM (SELECT DISTINCT e FROM inc)) SELECT v, list_sort(list(line)) AS edges FROM inc JOIN n USING (e) GROUP BY v")
def _(spark, d):
    at = folder(spark, "vertexmap")
    sets = overlap.edge_sets(views.h1(spark, d)).coalesce(1).sortWithinPartitions("e")
    sets.select(F.concat_ws(" ", F.col("vertices").cast("array<string>")).alias("line")).write.text(at)
    return files.read_vertex_map(spark, at)


@query("io_line_graph", f"WITH {graph_sql()} SELECT e AS u, nb AS v FROM adj WHERE s = 2 AND e < nb")
def _(spark, d):
    at = folder(spark, "linegraph")
    sinks.write_line_graph(overlap.line_graph(Graph.of(spark, d).ov, 3).where("s >= 2"), at)
    return files.read_edge_list(spark, f"{at}/s=2")


@query("io_dense_ids", f"WITH {graph_sql()} SELECT e AS old, row_number() OVER (ORDER BY e) - 1 AS new FROM (SELECT DISTINCT e FROM adj WHERE s = 2)")
def _(spark, d):
    at = folder(spark, "idmap")
    sinks.write_id_map(files.dense_ids(Graph.of(spark, d).ov.select(F.col("e1").alias("u"), F.col("e2").alias("v"))), at)
    return files.read_pairs(spark, at).toDF("old", "new")


@query("io_ranked_ids", f"WITH {graph_sql()} SELECT e AS old, row_number() OVER (ORDER BY count(*) DESC, e) - 1 AS new FROM adj WHERE s = 2 GROUP BY e")
def _(spark, d):
    return files.ranked_ids(Graph.of(spark, d).ov.select(F.col("e1").alias("u"), F.col("e2").alias("v")))


@query("io_first_seen_ids", f"""WITH {graph_sql()}, x AS (SELECT e1 AS old, 2 * (e1 * 1000000 + e2) AS place FROM ov WHERE w >= 2 UNION ALL SELECT e2, 2 * (e1 * 1000000 + e2) + 1 FROM ov WHERE w >= 2)
    SELECT old, row_number() OVER (ORDER BY min(place)) - 1 AS new FROM x GROUP BY old""")
def _(spark, d):
    ov = Graph.of(spark, d).ov
    return files.first_seen_ids(ov.select(F.col("e1").alias("u"), F.col("e2").alias("v"), (F.col("e1") * 1_000_000 + F.col("e2")).alias("at")), "at")


@query("io_remapped_edges", f"""WITH {graph_sql()}, n AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS new FROM (SELECT DISTINCT e FROM adj WHERE s = 2))
    SELECT DISTINCT a.new AS u, b.new AS v FROM adj JOIN n a ON a.e = adj.e JOIN n b ON b.e = adj.nb WHERE s = 2 AND adj.e < adj.nb""")
def _(spark, d):
    edges = Graph.of(spark, d).ov.select(F.col("e1").alias("u"), F.col("e2").alias("v"))
    return files.remapped(edges, files.dense_ids(edges))


@query("io_labels", "SELECT o_orderkey AS id, o_orderpriority AS label FROM orders WHERE o_orderpriority IS NOT NULL")
def _(spark, d):
    at = folder(spark, "labels")
    rows = Graph.of(spark, d).labels
    name = F.when(F.col("e") % 2 == 0, F.concat(F.lit("x-y-"), F.col("e").cast("string"))).otherwise(F.col("e").cast("string"))
    rows.select(name.alias("id"), "label").write.option("sep", "\t").csv(at)
    return files.read_labels(spark, at)


@query("io_pairs", f"WITH RECURSIVE {graph_sql()}, {COMPONENTS}, {PAIRS} SELECT DISTINCT p, q FROM pr")
def _(spark, d):
    at = folder(spark, "pairs")
    Graph.of(spark, d).pairs.select("p", "q").write.option("sep", " ").csv(at)
    return files.read_pairs(spark, at)


@query("io_distance_queries", f"WITH RECURSIVE {graph_sql()}, {COMPONENTS}, {PAIRS} SELECT p, q FROM pr WHERE p <> q")
def _(spark, d):
    at = folder(spark, "queries")
    Graph.of(spark, d).pairs.select("p", "q").write.option("sep", " ").csv(at)
    return files.read_distance_queries(spark, at)


@query("io_s_pairs", f"WITH RECURSIVE {graph_sql()}, {COMPONENTS}, {PAIRS} SELECT p, q, s FROM pr")
def _(spark, d):
    at = folder(spark, "spairs")
    Graph.of(spark, d).pairs.select("p", "q", "s").write.option("sep", " ").csv(at)
    return files.read_s_pairs(spark, at)


@query("io_elements", f"WITH {H1} SELECT v AS id FROM inc")
def _(spark, d):
    at = folder(spark, "elements")
    views.h1(spark, d).select(F.col("v").cast("string")).write.text(at)
    return files.read_elements(spark, at)


@query("io_profiles", f"""WITH RECURSIVE {ORACLE}, {PAIRS}, {bounds_sql("pr")}, {REACHED}
    SELECT r.src AS p, r.e AS q, r.s, r.d::DOUBLE AS d, lb, ub, d_hat FROM pr JOIN reached r ON r.s = pr.s AND r.src = p AND r.e = q JOIN bd ON bd.s = pr.s AND bd.p = pr.p AND bd.q = pr.q""")
def _(spark, d):
    g, at = Graph.of(spark, d), folder(spark, "profiles")
    sinks.write_profiles(oracle.edge_bounds(g.oracle, g.pairs), exact.edge_profiles(g.adj, g.pairs), at)
    return files.read_profiles(spark, at)


@query("io_landmarks", f"WITH RECURSIVE {ORACLE} SELECT landmark, lmk.s, lmk.cc, size FROM lmk JOIN cs USING (s, cc)")
def _(spark, d):
    g, at = Graph.of(spark, d), folder(spark, "landmarks")
    sinks.write_landmarks(g.oracle.landmarks, g.sizes, at)
    return files.read_landmarks(spark, at)


@query("io_centralities", f"""WITH RECURSIVE {ORACLE}, {contract._APPROX}, {REACHED}, x AS (SELECT s, src, {contract._CLOSE} AS closeness FROM reached GROUP BY s, src)
    SELECT ac.e AS id, x.closeness AS real, ac.closeness AS approx FROM ac JOIN x ON x.s = ac.s AND x.src = ac.e WHERE ac.s = 2""")
def _(spark, d):
    g, at = Graph.of(spark, d), folder(spark, "centralities")
    sources = g.sources.where("s = 2")
    approx = oracle.approx_closeness(g.oracle, sources.select("s", F.col("src").alias("e"))).select(F.col("e").alias("id"), F.col("closeness").alias("value"))
    real = exact.edge_closeness(g.adj, sources).select(F.col("src").alias("id"), F.col("closeness").alias("value"))
    sinks.write_centralities(approx, real, at)
    return files.read_centralities(spark, at)


@query("io_reachable", f"WITH RECURSIVE {ORACLE}, {contract._REACH} SELECT src, e AS dst, s, d_hat::DOUBLE AS dist FROM rc")
def _(spark, d):
    g, at = Graph.of(spark, d), folder(spark, "reachable")
    sinks.write_reachable(oracle.reachable(g.oracle, g.sources).select("src", F.col("e").alias("dst"), "s", F.col("d_hat").alias("dist")), at)
    return files.read_reachable(spark, at)


@query("io_top_k", f"""WITH RECURSIVE {ORACLE}, {REACHED},
    a AS (SELECT s, e AS q, row_number() OVER (PARTITION BY s, e ORDER BY d, src) AS rank, src AS x FROM lab WHERE e % 20 = 0 AND src <> e QUALIFY row_number() OVER (PARTITION BY s, e ORDER BY d, src) <= 5),
    r AS (SELECT s, src AS q, row_number() OVER (PARTITION BY s, src ORDER BY d, e) AS rank, e AS x FROM reached WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY s, src ORDER BY d, e) <= 5),
    k AS (SELECT s, q, unnest(range(1, 6)) AS rank FROM (SELECT s, q FROM a UNION SELECT s, q FROM r))
    SELECT k.q, coalesce(a.x, -1) AS approx, coalesce(r.x, -1) AS real, k.s FROM k LEFT JOIN a USING (s, q, rank) LEFT JOIN r USING (s, q, rank)""")
def _(spark, d):
    g, at = Graph.of(spark, d), folder(spark, "topk")
    queries = g.sources.select("s", F.col("src").alias("q"))
    sinks.write_top_k(oracle.nearest_landmarks(g.oracle, queries, 5), exact.nearest(g.adj, queries, 5), 5, at)
    return files.read_top_k(spark, at)


_STATISTICS = "SELECT DISTINCT lower(trim(dataset)) AS dataset, trim(ts) AS ts, offline, online, max_s, lb, l, num_landmarks, oracle_size::BIGINT AS oracle_size, num_queries, lower(trim(ls)) AS ls, lower(trim(la)) AS la, alpha, beta FROM run_statistics WHERE dataset IS NOT NULL AND ts IS NOT NULL AND ls IS NOT NULL AND la IS NOT NULL"


@query("io_statistics", _STATISTICS)
def _(spark, d):
    rows = table(spark, d, "run_statistics").where("dataset is not null and ts is not null and ls is not null and la is not null")
    clean = rows.withColumns({c: F.lower(F.trim(c)) for c in ("dataset", "ls", "la")}).withColumn("ts", F.trim("ts")).distinct()
    at = folder(spark, "statistics")
    sinks.write_statistics(clean.where("max_s <= 3"), at)
    sinks.write_statistics(clean.where("max_s > 3 or max_s is null"), at)  # appended
    return files.read_statistics(spark, at)


@query("io_oracle", f"WITH RECURSIVE {ORACLE} SELECT s, src AS landmark, e, d AS dist FROM lab WHERE s = 2")
def _(spark, d):
    at = folder(spark, "oracle")
    Graph.of(spark, d).oracle.save(at)
    return oracle.Oracle.load(spark, at, views.LB, s=2).labels.select("s", "landmark", "e", "dist")


@query("io_components", f"WITH RECURSIVE {graph_sql()}, {COMPONENTS} SELECT s, e, cc FROM comp")
def _(spark, d):
    at = folder(spark, "oracle")
    Graph.of(spark, d).oracle.save(at)
    return oracle.Oracle.load_components(spark, at, views.LB)


# expressions


@query("fn_arrays", f"""WITH {H1}, s AS (SELECT e, list_sort(list(v)) AS a FROM inc GROUP BY e), x AS (SELECT e, a, list_transform(a, lambda v: (v * 37) % 101) AS b FROM s)
    SELECT e, CAST(list_sum(list_transform(b, lambda v: v::DOUBLE)) AS DOUBLE) AS total, list_position(b, list_max(b)) - 1 AS first_most, list_position(b, list_min(b)) - 1 AS first_least,
    CAST(list_dot_product(a::DOUBLE[], b::DOUBLE[]) AS DOUBLE) AS dot, len(list_filter(list_distinct(a), lambda v: list_contains(b, v))) AS common, CAST(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS BIGINT) AS apart
    FROM x""")
def _(spark, d):
    sets = overlap.edge_sets(views.h1(spark, d)).select("e", F.col("vertices").alias("a")).withColumn("b", F.transform("a", lambda v: (v * 37) % 101))
    apart = scalars.array_sum(scalars.abs_differences(F.col("a"), F.col("b"))).cast("bigint")
    return sets.select(
        "e", scalars.array_sum(F.col("b")).alias("total"), scalars.arg_max(F.col("b")).alias("first_most"), scalars.arg_min(F.col("b")).alias("first_least"),
        scalars.dot(F.col("a").cast("array<double>"), F.col("b").cast("array<double>")).alias("dot"), scalars.capped_intersection(F.col("a"), F.col("b"), 1000).cast("bigint").alias("common"), apart.alias("apart"),
    )


@query("fn_running_sums", f"""WITH {H1}, n AS (SELECT e, v, row_number() OVER (PARTITION BY e ORDER BY v) - 1 AS place, sum(v::DOUBLE) OVER (PARTITION BY e ORDER BY v) AS upto FROM inc) SELECT e, place, upto FROM n""")
def _(spark, d):
    sets = overlap.edge_sets(views.h1(spark, d))
    return sets.select("e", F.posexplode(scalars.cumulative(F.col("vertices"))).alias("place", "upto")).select("e", F.col("place").cast("bigint").alias("place"), "upto")


@query("fn_sorted_maps", """WITH c AS (SELECT l_orderkey AS e, l_linenumber AS k, l_quantity AS q FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_quantity IS NOT NULL),
    d AS (SELECT e, k, max(q) AS q FROM c GROUP BY e, k) SELECT e, row_number() OVER (PARTITION BY e ORDER BY q DESC, k DESC) AS rank, k, q FROM d""")
def _(spark, d):
    rows = table(spark, d, "lineitem").where("l_orderkey is not null and l_linenumber is not null and l_quantity is not null")
    best = rows.groupBy(F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("k")).agg(F.max("l_quantity").alias("q"))
    maps = best.groupBy("e").agg(F.map_from_entries(F.collect_list(F.struct("k", "q"))).alias("m"))
    return maps.select("e", F.posexplode(scalars.sorted_map(F.col("m"), descending=True)).alias("at", "x")).select("e", (F.col("at") + 1).cast("bigint").alias("rank"), F.col("x.key").alias("k"), F.col("x.value").alias("q"))


@query("fn_texts", r"""SELECT id, regexp_replace(regexp_extract(coalesce(dataset, '') || '/' || coalesce(dataset, 'none') || '.hg', '([^/\\]*)$', 1), '\.[^.]*$', '') AS base, printf('%.2f', id / 7.0::DOUBLE) AS rounded,
    CASE id % 4 WHEN 0 THEN (id / 8.0::DOUBLE) * 1024 WHEN 1 THEN (id / 8.0::DOUBLE) * 1048576 WHEN 2 THEN (id / 8.0::DOUBLE) END AS size FROM etfs""")
def _(spark, d):
    rows = table(spark, d, "etfs").select("id", "dataset", (F.col("id") / 8).cast("string").alias("n"))
    text = F.when(F.col("id") % 4 == 0, F.concat("n", F.lit("K"))).when(F.col("id") % 4 == 1, F.concat("n", F.lit(" MB"))).when(F.col("id") % 4 == 2, F.col("n")).otherwise(F.concat("n", F.lit("x")))
    name = F.concat(F.coalesce("dataset", F.lit("")), F.lit("/"), F.coalesce("dataset", F.lit("none")), F.lit(".hg"))
    return rows.select("id", scalars.base_name(name).alias("base"), scalars.rounded_text(F.col("id") / F.lit(7.0), 2).alias("rounded"), scalars.size_number(text).alias("size"))


@query("fn_dates", """SELECT dataset, ts, count(*) AS n, coalesce(try_strptime(trim(ts), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(ts), '%d.%m.%Y %H:%M:%S'), try_strptime(trim(ts), '%Y/%m/%d %H:%M'), try_strptime(trim(ts), '%Y-%m-%dT%H:%M:%S'),
    try_strptime(trim(ts), '%m/%d/%Y %H:%M'), try_strptime(trim(ts), '%Y-%m-%d')) AS at FROM run_statistics GROUP BY dataset, ts""")
def _(spark, d):
    rows = table(spark, d, "run_statistics").groupBy("dataset", "ts").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("dataset", "ts", "n", scalars.flexible_timestamp(F.col("ts")).cast("timestamp_ntz").alias("at"))
