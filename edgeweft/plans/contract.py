"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import bfs, components as cc, coretree, exact, hubs, landmarks, metrics, oracle, overlap, sampling
from ..sources import sinks
from ..sources.lines import line_records, table
from . import skewed, views
from .views import COMPONENTS, DEGREES, H1, H2, LABELS, LANDMARKS, ORACLE, OVERLAPS, PAIRS, REACHED, SIZES, Graph, bfs_sql, bounds_sql, graph_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# incidence, sizes, overlaps


@query("h1_incidence", f"WITH {H1} SELECT e, v FROM inc")
def _(spark, d):
    return views.h1(spark, d)


@query("h2_incidence", f"WITH {H2} SELECT e, v FROM inc")
def _(spark, d):
    return views.h2(spark, d)


@query("h1_edge_sizes", f"WITH {H1}, {SIZES} SELECT e, size FROM sz")
def _(spark, d):
    return overlap.edge_sizes(views.h1(spark, d))


@query("h1_edges_of_min_size", f"WITH {H1}, {SIZES} SELECT e, size FROM sz WHERE size >= 3")
def _(spark, d):
    return overlap.edges_of_min_size(views.h1(spark, d), 3)


@query("h1_graph_counts", f"""WITH {H1}, {SIZES} SELECT count(*) AS n_edges, (SELECT count(DISTINCT v) FROM inc) AS n_vertices,
    CAST(sum(size) AS BIGINT) AS n_incidences, max(size) AS dimension FROM sz""")
def _(spark, d):
    return overlap.graph_counts(views.h1(spark, d))


@query("h1_min_size_counts", f"WITH {H1}, {SIZES} SELECT s, count(*) AS n_edges FROM sz, (SELECT unnest(range(1, 7))::INTEGER AS s) WHERE size >= s GROUP BY s")
def _(spark, d):
    return overlap.min_size_counts(views.h1(spark, d), 6)


@query("h1_vertex_degree", f"WITH {H1} SELECT v, count(*) AS degree FROM inc GROUP BY v")
def _(spark, d):
    return overlap.vertex_degrees(views.h1(spark, d))


@query("h1_vertex_map", f"WITH {H1} SELECT v, list_sort(list(e)) AS edges FROM inc GROUP BY v")
def _(spark, d):
    return overlap.vertex_map(views.h1(spark, d))


@query("h1_edge_sets", f"WITH {H1} SELECT e, list_sort(list(v)) AS vertices, CAST(count(*) AS INTEGER) AS size FROM inc GROUP BY e")
def _(spark, d):
    return overlap.edge_sets(views.h1(spark, d))


@query("h1_membership_max_s", f"WITH {H1}, {SIZES} SELECT e, CAST(greatest(1, least(size, 3)) AS INTEGER) AS max_s FROM sz")
def _(spark, d):
    return overlap.max_membership(views.h1(spark, d), 3)


@query("h1_overlaps", f"WITH {H1}, {OVERLAPS} SELECT e1, e2, w FROM ov WHERE w >= 2")
def _(spark, d):
    return overlap.overlaps(Graph.of(spark, d).inc, 2)


@query("h1_overlap_counts", f"WITH {H1}, {OVERLAPS} SELECT w, count(*) AS n FROM ov GROUP BY w")
def _(spark, d):
    return overlap.overlaps(Graph.of(spark, d).inc).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("h2_overlaps", f"WITH {H2}, {OVERLAPS} SELECT e1, e2, w FROM ov WHERE w >= 4")
def _(spark, d):
    return overlap.overlaps(Graph.of(spark, d, "h2").inc, 4)


@query("h1_overlap_of_pairs", f"""WITH {H1}, {OVERLAPS}, a AS (SELECT DISTINCT e FROM inc), p AS (SELECT x.e AS p, y.e AS q FROM a x JOIN a y ON y.e = x.e + 1 WHERE x.e % 20 = 0)
    SELECT p, q, coalesce(w, -1) AS w FROM p LEFT JOIN ov ON e1 = p AND e2 = q""")
def _(spark, d):
    inc = Graph.of(spark, d).inc
    e = inc.select("e").distinct()
    pairs = e.where("e % 20 = 0").select(F.col("e").alias("p"), (F.col("e") + 1).alias("q")).join(e.select(F.col("e").alias("q")), "q").select("p", "q")
    return overlap.overlap_of(pairs, overlap.overlaps(inc))


@query("h1_overlap_of_pairs_all", f"""WITH {H1}, {OVERLAPS}, a AS (SELECT DISTINCT e FROM inc), p AS (SELECT x.e AS p, y.e AS q FROM a x JOIN a y ON y.e = x.e + 1)
    SELECT p, q, coalesce(w, -1) AS w FROM p LEFT JOIN ov ON e1 = p AND e2 = q""")
def _(spark, d):
    inc = Graph.of(spark, d).inc
    e = inc.select("e").distinct()
    pairs = e.select(F.col("e").alias("p"), (F.col("e") + 1).alias("q")).join(e.select(F.col("e").alias("q")), "q").select("p", "q")
    return overlap.overlap_of(pairs, overlap.overlaps(inc))


@query("h1_s_neighbours", f"WITH {graph_sql()} SELECT adj.e, nb, w FROM adj JOIN ov ON e1 = least(adj.e, nb) AND e2 = greatest(adj.e, nb) WHERE s = 2 AND adj.e % 20 = 0")
def _(spark, d):
    g = Graph.of(spark, d)
    return overlap.s_neighbours(g.ov, g.inc.where("e % 20 = 0").select("e"), 2)


@query("h1_s_neighbours_among", f"""WITH {graph_sql()}, nbs AS (SELECT e1 AS e, e2 AS nb, w FROM ov WHERE w >= 2 UNION ALL SELECT e2, e1, w FROM ov WHERE w >= 2)
    SELECT nbs.e, nb, w FROM nbs JOIN sz ON sz.e = nb AND size >= 5 WHERE nbs.e % 20 = 0""")
def _(spark, d):
    g = Graph.of(spark, d)
    return overlap.s_neighbours(g.ov, g.inc.where("e % 20 = 0").select("e"), 2, overlap.edges_of_min_size(g.inc, 5))


@query("h1_s_degree", f"WITH {graph_sql()} SELECT sz.e, count(nb) AS degree FROM sz LEFT JOIN adj ON adj.e = sz.e AND s = 2 WHERE size >= 2 GROUP BY sz.e")
def _(spark, d):
    g = Graph.of(spark, d)
    return overlap.s_degrees(g.inc, g.ov, 2)


@query("h2_line_graph", f"WITH {graph_sql(H2, (4, 5, 6))} SELECT s, e AS u, nb AS v FROM adj WHERE e < nb")
def _(spark, d):
    g = Graph.of(spark, d, "h2", (4, 5, 6))
    return overlap.line_graph(g.ov, 6).where("s >= 4")


@query("h1_line_graph_projection", f"WITH {graph_sql()} SELECT ov.*, a.size AS size1, b.size AS size2 FROM ov JOIN sz a ON a.e = e1 JOIN sz b ON b.e = e2 WHERE w >= 3 AND a.size >= 3 AND b.size >= 3")
def _(spark, d):
    g = Graph.of(spark, d)
    nodes, edges = overlap.line_graph_projection(g.inc, g.ov, 3)
    a, b = nodes.select(F.col("e").alias("e1"), F.col("size").alias("size1")), nodes.select(F.col("e").alias("e2"), F.col("size").alias("size2"))
    return edges.join(a, "e1").join(b, "e2").select("e1", "e2", "w", "size1", "size2")


@query("h1_line_graph_growth", f"""WITH {graph_sql(H1, (1, 2, 3))} SELECT s, count(*) AS n_edges, count(*) / CAST((SELECT count(*) FROM sz) AS DOUBLE) AS growth FROM ov, lev WHERE w >= s GROUP BY s""")
def _(spark, d):
    inc = Graph.of(spark, d).inc
    return metrics.line_graph_growth(inc, overlap.overlaps(inc), 3)


@query("h1_edges_of_vertices", f"WITH {H1}, {SIZES} SELECT v, inc.e FROM inc JOIN sz ON sz.e = inc.e WHERE v % 20 = 0 AND size >= 2")
def _(spark, d):
    inc = Graph.of(spark, d).inc
    return overlap.edges_of_vertices(inc, inc.where("v % 20 = 0").select("v"), 2)


@query("h1_edges_of_vertices_all", f"WITH {H1}, {SIZES} SELECT v, inc.e FROM inc JOIN sz ON sz.e = inc.e WHERE size >= 2")
def _(spark, d):
    inc = Graph.of(spark, d).inc
    return overlap.edges_of_vertices(inc, inc.select("v"), 2)


@query("h1_common_edge_pairs", f"""WITH {H1}, p AS (SELECT DISTINCT v AS u, v + 1 AS v FROM inc WHERE v % 20 = 0)
    SELECT u, v, EXISTS (SELECT 1 FROM inc a JOIN inc b ON a.e = b.e WHERE a.v = p.u AND b.v = p.v) AS common FROM p""")
def _(spark, d):
    g = Graph.of(spark, d)
    return overlap.in_common_edge(g.vertex_pairs.select("u", "v"), g.inc)


@query("h1_common_edge_pairs_all", f"""WITH {H1}, p AS (SELECT DISTINCT v AS u, v + 1 AS v FROM inc),
    c AS (SELECT DISTINCT a.v AS u FROM inc a JOIN inc b ON a.e = b.e AND b.v = a.v + 1) SELECT p.u, p.v, c.u IS NOT NULL AS common FROM p LEFT JOIN c ON c.u = p.u""")
def _(spark, d):
    inc = Graph.of(spark, d).inc
    return overlap.in_common_edge(inc.select(F.col("v").alias("u"), (F.col("v") + 1).alias("v")).distinct(), inc)


@query("h1_set_relations", f"""WITH {H1}, {OVERLAPS}, sets AS (SELECT e, list_sort(list(v)) AS vs FROM inc GROUP BY e)
    SELECT e1 AS p, e2 AS q, true AS intersects, len(list_intersect(a.vs, b.vs)) = len(b.vs) AS contains, a.vs = b.vs AS same_set, w AS n_common, least(w, 2) AS capped
    FROM ov JOIN sets a ON a.e = e1 JOIN sets b ON b.e = e2 WHERE w >= 2""")
def _(spark, d):
    g = Graph.of(spark, d)
    return overlap.set_relations(g.ov.select(F.col("e1").alias("p"), F.col("e2").alias("q")), overlap.edge_sets(g.inc), 2)


@query("h1_vertex_membership", f"""WITH {H1}, w AS (SELECT e, min(v) AS v FROM inc GROUP BY e) SELECT inc.e, bool_or(inc.v = w.v + 1) AS has_next FROM inc JOIN w USING (e) GROUP BY inc.e""")
def _(spark, d):
    sets = overlap.edge_sets(views.h1(spark, d))
    return sets.select("e", F.array_contains("vertices", F.array_min("vertices") + 1).alias("has_next"))


@query("h1_twins", f"""WITH {graph_sql()}, n AS (SELECT e, list_sort(list(nb)) AS ns FROM adj WHERE s = 2 GROUP BY e)
    SELECT e AS node, m AS twin FROM (SELECT e, min(e) OVER (PARTITION BY ns) AS m FROM n) WHERE e <> m""")
def _(spark, d):
    return overlap.twins(Graph.of(spark, d).ov.select(F.col("e1").alias("u"), F.col("e2").alias("v")))


# components


@query("h1_s_components", f"WITH RECURSIVE {graph_sql()}, {COMPONENTS} SELECT s, e, cc FROM comp")
def _(spark, d):
    return Graph.of(spark, d).components


@query("h2_s_components", f"WITH RECURSIVE {graph_sql(H2, (4, 5, 6))}, {COMPONENTS} SELECT s, e, cc FROM comp")
def _(spark, d):
    return Graph.of(spark, d, "h2", (4, 5, 6)).components


@query("h2_component_sizes", f"WITH RECURSIVE {graph_sql(H2, (4, 5, 6))}, {COMPONENTS} SELECT s, cc, size, n_vertices FROM cs")
def _(spark, d):
    return Graph.of(spark, d, "h2", (4, 5, 6)).sizes


@query("h2_components_nontrivial", f"WITH RECURSIVE {graph_sql(H2, (4, 5, 6))}, {COMPONENTS} SELECT s, count(*) AS n_components, max(size) AS largest FROM cs GROUP BY s HAVING max(size) > 1")
def _(spark, d):
    return cc.nontrivial_levels(Graph.of(spark, d, "h2", (4, 5, 6)).sizes)


@query("h1_component_ratio", f"""WITH RECURSIVE {graph_sql()}, {COMPONENTS}
    SELECT s, (count(DISTINCT cc) + (SELECT count(*) FROM sz) - count(*)) / CAST((SELECT count(*) FROM sz) AS DOUBLE) AS ratio FROM comp GROUP BY s""")
def _(spark, d):
    g = Graph.of(spark, d)
    return cc.component_ratio(g.components, g.inc, 3)


@query("h1_component_lookup", f"""WITH RECURSIVE {graph_sql()}, {COMPONENTS}
    SELECT sz.e, 3 AS s, coalesce(comp.cc, -1) AS cc, coalesce(cs.size, 0) AS size FROM sz LEFT JOIN comp ON comp.e = sz.e AND comp.s = 3 LEFT JOIN cs ON cs.s = 3 AND cs.cc = comp.cc""")
def _(spark, d):
    g = Graph.of(spark, d)
    return cc.lookup(g.inc.select("e").distinct().withColumn("s", F.lit(3)), g.components, g.sizes)


@query("line_graph_components", """
    WITH RECURSIVE l AS (SELECT DISTINCT s, u, v FROM line_graph WHERE s IS NOT NULL AND u >= 0 AND v >= 0 AND u <> v),
    b AS (SELECT s, u, v FROM l UNION SELECT s, v, u FROM l),
    c(s, e, cc) USING KEY (s, e) AS (
        SELECT s, u, least(u, min(v)) FROM b GROUP BY s, u
        UNION
        SELECT b.s, b.u, min(c.cc) FROM c JOIN b ON b.s = c.s AND b.v = c.e JOIN recurring.c AS o ON o.s = b.s AND o.e = b.u
        GROUP BY b.s, b.u, o.cc HAVING min(c.cc) < o.cc)
    SELECT s, e, cc FROM c""")
def _(spark, d):
    lines = table(spark, d, "line_graph").where("s is not null and u >= 0 and v >= 0")
    return cc.connect(lines.select("s", F.col("u").alias("e"), F.col("v").alias("nb")))


# exact distances


@query("h1_bfs", f"WITH RECURSIVE {graph_sql()}, {REACHED} SELECT s, src, e, d AS dist FROM reached")
def _(spark, d):
    return Graph.of(spark, d).reached


@query("h1_bfs_levels", f"WITH RECURSIVE {graph_sql()}, {REACHED} SELECT s, src, d AS dist, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY s, src ORDER BY d) AS BIGINT) AS upto FROM reached GROUP BY s, src, d")
def _(spark, d):
    return bfs.level_counts(Graph.of(spark, d).reached)


@query("h1_bfs_depth", f"WITH RECURSIVE {graph_sql()}, {REACHED} SELECT s, src, e, d AS dist FROM reached WHERE d <= 2")
def _(spark, d):
    g = Graph.of(spark, d)
    return bfs.distances(g.adj, g.sources, max_depth=2)


_PATHS = f"""WITH RECURSIVE {graph_sql()}, {COMPONENTS}, {REACHED}, {PAIRS},
    par AS MATERIALIZED (SELECT r.s, r.src, r.e, x.e AS parent FROM reached r JOIN adj a ON a.s = r.s AND a.e = r.e JOIN reached x ON x.s = r.s AND x.src = r.src AND x.e = a.nb AND x.d = r.d - 1),
    walk(s, p, q, node, path) AS (SELECT s, p, q, q, [q] FROM pr UNION ALL SELECT w.s, w.p, w.q, x.parent, list_prepend(x.parent, w.path) FROM walk w JOIN """


@query("h1_all_shortest_paths", _PATHS + "par x ON x.s = w.s AND x.src = w.p AND x.e = w.node) SELECT s, p, q, path FROM walk WHERE node = p")
def _(spark, d):
    g = Graph.of(spark, d)
    return bfs.shortest_paths(g.adj, g.pairs, True)


@query("h1_shortest_path", _PATHS + "(SELECT s, src, e, min(parent) AS parent FROM par GROUP BY ALL) x ON x.s = w.s AND x.src = w.p AND x.e = w.node) SELECT s, p, q, path FROM walk WHERE node = p")
def _(spark, d):
    g = Graph.of(spark, d)
    return bfs.shortest_paths(g.adj, g.pairs, False)


@query("h1_exact_edge_profile", f"WITH RECURSIVE {graph_sql()}, {COMPONENTS}, {REACHED}, {PAIRS} SELECT pr.s, p, q, d FROM pr JOIN reached r ON r.s = pr.s AND r.src = p AND r.e = q")
def _(spark, d):
    g = Graph.of(spark, d)
    return exact.profiles("edge", g.adj, g.inc, g.pairs)


_ENDS = "ok AS MATERIALIZED (SELECT v, inc.e FROM inc JOIN sz USING (e) WHERE size >= 2)"
_VERTEX_PAIRS = f"""{_ENDS}, vp AS (SELECT DISTINCT 2 AS s, v AS u, v + 1 AS v FROM inc WHERE v % 20 = 0),
    ends AS MATERIALIZED (SELECT vp.s, vp.u, vp.v, a.e AS p, b.e AS q FROM vp JOIN ok a ON a.v = vp.u JOIN ok b ON b.v = vp.v)"""
_VE_PAIRS = f"""{_ENDS}, vq AS MATERIALIZED (SELECT 2 AS s, v - 1 AS v, min(e) AS q FROM ok WHERE (v - 1) % 20 = 0 AND v - 1 IN (SELECT v FROM inc) GROUP BY v),
    ends AS MATERIALIZED (SELECT vq.s, vq.v, vq.q, a.e AS p FROM vq JOIN ok a ON a.v = vq.v)"""


@query("h1_exact_vertex_profile", f"""WITH RECURSIVE {graph_sql()}, {_VERTEX_PAIRS}, {bfs_sql("r", "SELECT DISTINCT s, p AS src FROM ends")}
    SELECT n.s, u, v, min(d) AS d FROM ends n JOIN r ON r.s = n.s AND r.src = p AND r.e = q WHERE d > 0 GROUP BY n.s, u, v""")
def _(spark, d):
    g = Graph.of(spark, d, s_values=(2,))
    return exact.profiles("vertex", g.adj, g.inc, g.vertex_pairs)


@query("h1_exact_vertex_edge_profile", f"""WITH RECURSIVE {graph_sql()}, {_VE_PAIRS}, {bfs_sql("r", "SELECT DISTINCT s, q AS src FROM ends")}
    SELECT n.s, v, q, min(d) AS d FROM ends n JOIN r ON r.s = n.s AND r.src = q AND r.e = p WHERE d > 0 GROUP BY n.s, v, q""")
def _(spark, d):
    g = Graph.of(spark, d, s_values=(2,))
    return exact.profiles("both", g.adj, g.inc, g.vertex_edge_pairs)


_CLOSE = "CASE WHEN sum(d) > 0 THEN (count(*) - 1) / CAST(sum(d) AS DOUBLE) ELSE 0.0 END"


@query("h1_edge_closeness", f"WITH RECURSIVE {graph_sql()}, {REACHED} SELECT s, src, {_CLOSE} AS closeness FROM reached GROUP BY s, src")
def _(spark, d):
    g = Graph.of(spark, d)
    return exact.edge_closeness(g.adj, g.sources)


@query("h1_edge_closeness_compat", f"""WITH RECURSIVE {graph_sql()}, {REACHED}
    SELECT s, src, CASE WHEN sum(d) > 0 AND count(*) > 2 THEN (count(*) - 2) / CAST(sum(d) AS DOUBLE) ELSE 0.0 END AS closeness FROM reached GROUP BY s, src""")
def _(spark, d):
    g = Graph.of(spark, d)
    return exact.edge_closeness(g.adj, g.sources, compat=True)


@query("h1_vertex_closeness", f"""WITH RECURSIVE {graph_sql()}, {_ENDS}, {bfs_sql("r", "SELECT DISTINCT 2 AS s, e AS src FROM ok WHERE v % 20 = 0")},
    c AS (SELECT src, {_CLOSE} AS closeness FROM r GROUP BY src)
    SELECT 2 AS s, x.v, coalesce(max(closeness), 0.0) AS closeness FROM (SELECT DISTINCT v FROM inc WHERE v % 20 = 0) x LEFT JOIN ok ON ok.v = x.v LEFT JOIN c ON c.src = ok.e GROUP BY x.v""")
def _(spark, d):
    g = Graph.of(spark, d, s_values=(2,))
    return exact.vertex_closeness(g.adj, g.inc, g.inc.where("v % 20 = 0").select("v"), 2)


@query("h1_topk_exact", f"""WITH RECURSIVE {graph_sql()}, {REACHED}
    SELECT s, src AS q, CAST(row_number() OVER w AS INTEGER) AS rank, e, d AS dist FROM reached WHERE d > 0 WINDOW w AS (PARTITION BY s, src ORDER BY d, e) QUALIFY row_number() OVER w <= 5""")
def _(spark, d):
    g = Graph.of(spark, d)
    return exact.nearest(g.adj, g.sources.select("s", F.col("src").alias("q")), 5)


_LABEL = "lb AS (SELECT o_orderkey AS e, o_orderpriority AS label FROM orders WHERE o_orderpriority IS NOT NULL)"


@query("h1_topk_label", f"""WITH RECURSIVE {graph_sql()}, {REACHED}, {_LABEL}
    SELECT r.s, src AS q, CAST(row_number() OVER w AS INTEGER) AS rank, r.e, d AS dist FROM reached r JOIN lb a ON a.e = r.src JOIN lb b ON b.e = r.e AND lower(a.label) = lower(b.label)
    WHERE d > 0 WINDOW w AS (PARTITION BY r.s, src ORDER BY d, r.e) QUALIFY row_number() OVER w <= 3""")
def _(spark, d):
    g = Graph.of(spark, d)
    return exact.nearest_with_label(g.adj, g.sources.select("s", F.col("src").alias("q")), g.labels, 3)


# landmarks


@query("h1_landmarks_degree", f"WITH RECURSIVE {graph_sql()}, {COMPONENTS}, {LANDMARKS} SELECT s, cc, landmark FROM lmk")
def _(spark, d):
    g = Graph.of(spark, d)
    return landmarks.select_degree(g.components, g.assigned, g.adj)


@query("h1_landmarks_random", f"""WITH RECURSIVE {graph_sql()}, {COMPONENTS}
    SELECT c.s, c.cc, c.e AS landmark FROM comp c JOIN cs USING (s, cc) WHERE size > {views.LB}
    QUALIFY row_number() OVER (PARTITION BY c.s, c.cc ORDER BY (c.e % 2147483647 * 48271 + 4 * 69621) % 2147483647, c.e) <= ceil(size / 20.0)""")
def _(spark, d):
    g = Graph.of(spark, d)
    return landmarks.select_random(g.components, g.assigned, 4)


@query("h1_landmarks_farthest")
def _(spark, d):
    g = Graph.of(spark, d)
    return landmarks.select_farthest(g.components, g.assigned, g.adj, 4)


@query("h1_landmarks_bestcover")
def _(spark, d):
    g = Graph.of(spark, d)
    return landmarks.select_bestcover(g.components, g.assigned, g.adj, 0.4, 4)


@query("h1_landmarks_between")
def _(spark, d):
    g = Graph.of(spark, d)
    return landmarks.select_between(g.components, g.assigned, g.adj, 0.4, 4)


@query("h1_assignment_sampling", f"""WITH RECURSIVE {graph_sql()}, {COMPONENTS},
    ok AS MATERIALIZED (SELECT * FROM cs WHERE size > {views.LB}),
    t AS (SELECT CAST(sum(size) AS DOUBLE) AS a, CAST(sum(s) AS DOUBLE) AS b, CAST(sum(n_vertices) AS DOUBLE) AS c FROM ok),
    p AS MATERIALIZED (SELECT ok.*, 0.2 * size / a + 0.6 * s / b + 0.2 * n_vertices / c AS p FROM ok, t),
    k AS (SELECT greatest(1, floor((SELECT 3 * count(*) FROM sz) / sum(p * size))) AS k FROM p),
    u AS (SELECT p.*, k, sum(p) OVER (ORDER BY s, cc) AS upto FROM p, k),
    n AS (SELECT s, cc, size, CAST(least(size, greatest(0, floor(upto * k + 0.5 - 1e-9) - floor((upto - p) * k + 0.5 - 1e-9))) AS BIGINT) AS n FROM u)
    SELECT s, cc, size, n FROM n WHERE n > 0 AND (SELECT sum(size * size) FROM ok) > (SELECT 3 * count(*) FROM sz)
    UNION ALL SELECT s, cc, size, size FROM ok WHERE (SELECT sum(size * size) FROM ok) <= (SELECT 3 * count(*) FROM sz)""")
def _(spark, d):
    g = Graph.of(spark, d)
    return landmarks.assign_by_sampling(g.sizes, 3 * g.inc.select("e").distinct().count(), 0.2, 0.6, views.LB)


@query("h2_assignment_sampling")
def _(spark, d):
    g = Graph.of(spark, d, "h2", (4, 5, 6))
    return landmarks.assign_by_sampling(g.sizes, 30 * g.inc.select("e").distinct().count(), 0.2, 0.6, views.LB)


@query("h1_assignment_ranking")
def _(spark, d):
    g = Graph.of(spark, d)
    return landmarks.assign_by_ranking(g.sizes, 3 * g.inc.select("e").distinct().count(), views.LB, 0.5, 0.5)


@query("h1_paths_cover")
def _(spark, d):
    g = Graph.of(spark, d)
    paths = landmarks.sampled_paths(g.components, g.assigned, g.adj, 0.4, 4, True)
    return paths.select("s", "cc", F.explode("path").alias("e")).groupBy("s", "cc", "e").agg(F.count(F.lit(1)).alias("n"))


# the oracle


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph.of(spark, sf_dir)
    return oracle.edge_bounds(g.oracle, g.pairs)


@query("h1_oracle_labels", f"WITH RECURSIVE {ORACLE} SELECT s, src AS landmark, e, d AS dist FROM lab")
def _(spark, d):
    return Graph.of(spark, d).oracle.labels


@query("h1_oracle_size", f"WITH RECURSIVE {ORACLE} SELECT count(*) AS n_pairs, (SELECT count(*) FROM lmk) AS n_landmarks, (SELECT count(*) FROM comp) AS n_members FROM lab")
def _(spark, d):
    return Graph.of(spark, d).oracle.size_of()


QUERIES["h1_oracle_query_edge"] = flagship
SQL["h1_oracle_query_edge"] = f"WITH RECURSIVE {ORACLE}, {PAIRS}, {bounds_sql('pr')} SELECT s, p, q, lb, ub, d_hat FROM bd"


_BEST = "row_number() OVER (PARTITION BY {keys} ORDER BY d_hat, lb, ub, n.p, n.q) = 1"


@query("h1_oracle_query_vertex", f"""WITH RECURSIVE {ORACLE}, {_VERTEX_PAIRS}, {bounds_sql("ends")},
    common AS (SELECT DISTINCT u, v FROM vp WHERE EXISTS (SELECT 1 FROM inc a JOIN inc b ON a.e = b.e WHERE a.v = vp.u AND b.v = vp.v)),
    best AS (SELECT n.s, n.u, n.v, lb, ub, d_hat FROM ends n JOIN bd USING (s, p, q) WHERE d_hat >= 0 QUALIFY {_BEST.format(keys="n.s, n.u, n.v")})
    SELECT vp.s, vp.u, vp.v, CASE WHEN c.u IS NOT NULL THEN 1.0 ELSE coalesce(lb, -1.0) END::DOUBLE AS lb, CASE WHEN c.u IS NOT NULL THEN 1.0 ELSE coalesce(ub, -1.0) END::DOUBLE AS ub,
    CASE WHEN c.u IS NOT NULL THEN 1.0 ELSE coalesce(d_hat, -1.0) END::DOUBLE AS d_hat
    FROM vp LEFT JOIN common c ON c.u = vp.u AND c.v = vp.v LEFT JOIN best b ON b.s = vp.s AND b.u = vp.u AND b.v = vp.v""")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.bounds("vertex", g.oracle, g.inc, g.vertex_pairs)


@query("h1_oracle_query_vertex_edge", f"""WITH RECURSIVE {ORACLE}, {_VE_PAIRS}, {bounds_sql("ends")},
    best AS (SELECT n.s, n.v, n.q, lb, ub, d_hat FROM ends n JOIN bd USING (s, p, q) WHERE d_hat >= 0 QUALIFY {_BEST.format(keys="n.s, n.v, n.q")})
    SELECT vq.s, vq.v, vq.q, coalesce(lb, -1.0)::DOUBLE AS lb, coalesce(ub, -1.0)::DOUBLE AS ub, coalesce(d_hat, -1.0)::DOUBLE AS d_hat FROM vq LEFT JOIN best b ON b.s = vq.s AND b.v = vq.v AND b.q = vq.q""")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.bounds("both", g.oracle, g.inc, g.vertex_edge_pairs)


_PROFILES = f"""{PAIRS}, pp AS (SELECT DISTINCT p, q FROM pr WHERE s = 2),
    sp AS MATERIALIZED (SELECT g::INTEGER AS s, p, q FROM pp JOIN sz a ON a.e = p JOIN sz b ON b.e = q, (SELECT unnest(range(1, 4)) AS g) WHERE g <= greatest(1, least(a.size, b.size, 3)) AND g >= 2), {bounds_sql("sp")}"""


def _profiles(g: Graph) -> DataFrame:
    queries = oracle.profile_queries(g.inc, g.pairs.where("s = 2").select("p", "q").distinct(), 3).where("s >= 2")
    return oracle.edge_bounds(g.oracle, queries)


@query("h1_profiles", f"WITH RECURSIVE {ORACLE}, {_PROFILES} SELECT s, p, q, lb, ub, d_hat FROM bd")
def _(spark, d):
    return _profiles(Graph.of(spark, d))


@query("h1_refined_profile", f"""WITH RECURSIVE {ORACLE}, {_PROFILES}, x AS (SELECT *, lead(ub) OVER w AS up, max(lb) OVER w AS low FROM bd WINDOW w AS (PARTITION BY p, q ORDER BY s))
    SELECT s, p, q, low AS lb, CASE WHEN up >= 0 AND ub >= 0 THEN least(ub, up) ELSE ub END AS ub, d_hat FROM x""")
def _(spark, d):
    return oracle.refined(_profiles(Graph.of(spark, d)))


_REACH = f"""rb AS MATERIALIZED (SELECT l1.s, l1.e AS src, l2.e, CAST(max(abs(l1.d - l2.d)) AS BIGINT) AS lb, CAST(min(l1.d + l2.d) AS BIGINT) AS ub
        FROM lab l1 JOIN lab l2 ON l1.s = l2.s AND l1.src = l2.src AND l1.e <> l2.e WHERE l1.e % 20 = 0 GROUP BY l1.s, l1.e, l2.e),
    rc AS MATERIALIZED (SELECT *, lb + (ub - lb) // 2 AS d_hat FROM rb)"""


@query("h1_reachable_profile", f"WITH RECURSIVE {ORACLE}, {_REACH} SELECT s, src, e, lb, ub, d_hat FROM rc")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.reachable(g.oracle, g.sources)


@query("h1_reachable_counts", f"""WITH RECURSIVE {ORACLE}, {_REACH}, f AS (SELECT src, e, min(s) AS first FROM rc GROUP BY src, e)
    SELECT src, lev.s, count(*) AS n FROM f JOIN lev ON first <= lev.s GROUP BY src, lev.s""")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.reachable_counts(oracle.reachable(g.oracle, g.sources), 3)


@query("h1_reachable_vertices", f"""WITH RECURSIVE {ORACLE}, m AS (SELECT v, e FROM inc WHERE v % 20 = 0),
    b AS (SELECT l1.e AS src, l2.e, max(abs(l1.d - l2.d)) AS lb, min(l1.d + l2.d) AS ub FROM lab l1 JOIN lab l2 ON l1.s = l2.s AND l1.src = l2.src AND l1.e <> l2.e
        WHERE l1.s = 2 AND l1.e IN (SELECT e FROM m) GROUP BY l1.e, l2.e),
    x AS (SELECT m.v AS src, inc.v, CAST(max(lb) AS BIGINT) AS lb, CAST(min(ub) AS BIGINT) AS ub FROM b JOIN m ON m.e = b.src JOIN inc ON inc.e = b.e WHERE inc.v <> m.v GROUP BY m.v, inc.v)
    SELECT 2 AS s, src, v, lb, ub, CAST(lb + floor((ub - lb) / 2.0) AS BIGINT) AS d_hat FROM x""")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.reachable_vertices(g.oracle, g.inc, g.inc.where("v % 20 = 0").select("v"), 2)


_APPROX = f"""ac AS (SELECT c.s, c.e, CASE WHEN size <= {views.LB} THEN CASE WHEN {views.SMALL} > 0 THEN 1.0::DOUBLE / ({views.SMALL}) ELSE 0.0 END ELSE coalesce(n / total, 0.0) END::DOUBLE AS closeness
    FROM comp c JOIN cs USING (s, cc) LEFT JOIN (SELECT s, e, count(*) AS n, CAST(sum(d) AS DOUBLE) AS total FROM lab WHERE d > 0 GROUP BY s, e) l ON l.s = c.s AND l.e = c.e)"""


@query("h1_closeness_approx", f"WITH RECURSIVE {ORACLE}, {_APPROX} SELECT s, e, closeness FROM ac WHERE e % 20 = 0")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.approx_closeness(g.oracle, g.sources.select("s", F.col("src").alias("e")))


@query("h1_closeness_approx_all", f"WITH RECURSIVE {ORACLE}, {_APPROX} SELECT s, e, closeness FROM ac")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.approx_closeness(g.oracle, g.components.select("s", "e"))


@query("h1_vertex_closeness_approx", f"""WITH RECURSIVE {ORACLE}, {_APPROX}
    SELECT 2 AS s, v, coalesce(max(closeness), 0.0) AS closeness FROM inc LEFT JOIN (SELECT e, closeness FROM ac WHERE s = 2) a ON a.e = inc.e WHERE v % 20 = 0 GROUP BY v""")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.approx_vertex_closeness(g.oracle, g.inc, g.inc.where("v % 20 = 0").select("v"), 2)


@query("h1_vertex_closeness_approx_all", f"""WITH RECURSIVE {ORACLE}, {_APPROX}
    SELECT 2 AS s, v, coalesce(max(closeness), 0.0) AS closeness FROM inc LEFT JOIN (SELECT e, closeness FROM ac WHERE s = 2) a ON a.e = inc.e GROUP BY v""")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.approx_vertex_closeness(g.oracle, g.inc, g.inc.select("v"), 2)


@query("h1_topk_landmarks", f"""WITH RECURSIVE {ORACLE} SELECT s, e AS q, CAST(row_number() OVER w AS INTEGER) AS rank, src AS e, d AS dist FROM lab WHERE e % 20 = 0 AND src <> e
    WINDOW w AS (PARTITION BY s, lab.e ORDER BY d, src) QUALIFY row_number() OVER w <= 5""")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.nearest_landmarks(g.oracle, g.sources.select("s", F.col("src").alias("q")), 5)


@query("h1_topk_approx", f"""WITH RECURSIVE {ORACLE}, {_REACH} SELECT s, src AS q, CAST(row_number() OVER w AS INTEGER) AS rank, e, d_hat FROM rc
    WINDOW w AS (PARTITION BY s, src ORDER BY d_hat, e) QUALIFY row_number() OVER w <= 5""")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.nearest_estimated(g.oracle, g.sources.select("s", F.col("src").alias("q")), 5)


@query("h1_topk_approx_label", f"""WITH RECURSIVE {ORACLE}, {_REACH}, {_LABEL} SELECT s, src AS q, CAST(row_number() OVER w AS INTEGER) AS rank, rc.e, d_hat
    FROM rc JOIN lb a ON a.e = src JOIN lb b ON b.e = rc.e AND lower(a.label) = lower(b.label) WINDOW w AS (PARTITION BY s, src ORDER BY d_hat, rc.e) QUALIFY row_number() OVER w <= 3""")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.nearest_estimated(g.oracle, g.sources.select("s", F.col("src").alias("q")), 3, g.labels)


@query("h1_error_metrics", f"""WITH RECURSIVE {ORACLE}, {PAIRS}, {bounds_sql("pr")}, {REACHED},
    x AS (SELECT bd.s, r.d AS d, CASE WHEN d_hat >= 0 THEN d_hat ELSE 1.5 * max(r.d) OVER (PARTITION BY bd.s) END AS h FROM bd JOIN reached r ON r.s = bd.s AND r.src = bd.p AND r.e = bd.q)
    SELECT s, count(*) AS n, avg(abs(d - h)) AS mae, sqrt(avg((d - h) * (d - h))) AS rmse, sum(abs(d - h)) AS l1 FROM x GROUP BY s""")
def _(spark, d):
    g = Graph.of(spark, d)
    real = exact.edge_profiles(g.adj, g.pairs)
    merged = sinks.merged_profiles(oracle.edge_bounds(g.oracle, g.pairs), real)
    return metrics.error_metrics(merged, ["s"], "d", "d_hat")


@query("h2_oracle_build")
def _(spark, d):
    g = Graph.of(spark, d, "h2", (5, 6))
    return oracle.build(g.inc, [5, 6], budget_per_edge=10, alpha=0.2, beta=0.6).labels


@query("h2_oracle_build_split")
def _(spark, d):
    g = Graph.of(spark, d, "h2", (5, 6))
    return oracle.build(g.inc, [5, 6], budget_per_edge=10, alpha=0.2, beta=0.6, split_budget=True).labels


@query("h2_oracle_build_baseline")
def _(spark, d):
    return oracle.build_baseline(Graph.of(spark, d, "h2", (5, 6)).inc, [5, 6], 4).labels


# exact indexes


_HIGHWAY = """fl AS MATERIALIZED (SELECT s, src AS hub, e, d FROM lab), hw AS MATERIALIZED (SELECT fl.s, hub, e AS hub2, d AS h FROM fl JOIN lmk ON lmk.s = fl.s AND landmark = fl.e),
    hl AS MATERIALIZED (SELECT * FROM fl WHERE NOT EXISTS (SELECT 1 FROM hw JOIN fl f2 ON f2.s = hw.s AND f2.hub = hw.hub2 WHERE hw.s = fl.s AND hw.hub = fl.hub AND hw.hub2 <> hw.hub AND f2.e = fl.e AND h + f2.d = fl.d))"""


@query("h1_highway_labels", f"WITH RECURSIVE {ORACLE}, {_HIGHWAY} SELECT s, e, hub, d FROM hl")
def _(spark, d):
    g = Graph.of(spark, d)
    return hubs.highway_labels(g.adj, g.oracle.landmarks)[0]


@query("h1_highway_bounds", f"""WITH RECURSIVE {ORACLE}, {PAIRS} SELECT pr.s, p, q, min(l1.d + l2.d) AS ub FROM pr JOIN lab l1 ON l1.s = pr.s AND l1.e = p JOIN lab l2 ON l2.s = pr.s AND l2.e = q AND l2.src = l1.src GROUP BY pr.s, p, q""")
def _(spark, d):
    g = Graph.of(spark, d)
    return hubs.highway_bounds(g.pairs, *hubs.highway_labels(g.adj, g.oracle.landmarks))


_EXACT = f"WITH RECURSIVE {graph_sql()}, {COMPONENTS}, {REACHED}, {PAIRS} SELECT pr.s, p, q, d FROM pr JOIN reached r ON r.s = pr.s AND r.src = p AND r.e = q"
_EXACT_LINKED = _EXACT + " WHERE EXISTS (SELECT 1 FROM adj WHERE adj.s = pr.s AND adj.e = p)"


@query("h1_highway_distances", _EXACT)
def _(spark, d):
    g = Graph.of(spark, d)
    return hubs.highway_distances(g.adj, g.pairs, g.oracle.landmarks)


@query("h1_hub_label_distances", _EXACT_LINKED)
def _(spark, d):
    g = Graph.of(spark, d)
    return hubs.hub_distances(g.pairs, hubs.hub_labels(g.adj))


@query("h1_core_tree_distances", _EXACT_LINKED)
def _(spark, d):
    g = Graph.of(spark, d)
    return coretree.core_tree_distances(g.adj, g.pairs)


@query("h1_distance_statistics", f"WITH RECURSIVE {graph_sql()}, {REACHED} SELECT s, count(*) AS n, min(d) AS least, max(d) AS most, avg(d) AS mean FROM reached WHERE d > 0 GROUP BY s")
def _(spark, d):
    return Graph.of(spark, d).reached.where("dist > 0").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"), F.avg("dist").alias("mean"))


@query("h1_node_ranks", f"WITH {graph_sql()}, {DEGREES} SELECT s, e, CAST(row_number() OVER (PARTITION BY s ORDER BY degree DESC, e) AS INTEGER) AS rank FROM dg")
def _(spark, d):
    return hubs.rank_by_degree(Graph.of(spark, d).adj)


@query("h1_without_landmarks", f"""WITH RECURSIVE {graph_sql()}, {COMPONENTS}, {LANDMARKS} SELECT a.s, a.e, a.nb FROM adj a
    WHERE NOT EXISTS (SELECT 1 FROM lmk l WHERE l.s = a.s AND l.landmark = a.e) AND NOT EXISTS (SELECT 1 FROM lmk l WHERE l.s = a.s AND l.landmark = a.nb)""")
def _(spark, d):
    g = Graph.of(spark, d)
    chosen = landmarks.select_degree(g.components, g.assigned, g.adj)
    return hubs.without_nodes(g.adj, chosen.select("s", F.col("landmark").alias("e")))


# samples

_HASH = "({x} % 2147483647 * 48271 + 4 * 69621) % 2147483647"


@query("h1_sample_pairs", f"""WITH RECURSIVE {graph_sql()}, {COMPONENTS},
    r AS (SELECT s, cc, e, row_number() OVER (PARTITION BY s, cc ORDER BY {_HASH.format(x="e")}, e) AS rank FROM comp),
    t AS (SELECT * FROM r WHERE rank <= 10), n AS (SELECT s, cc, e AS p, rank, coalesce(lead(e) OVER w, first(e) OVER w) AS q FROM t WINDOW w AS (PARTITION BY s, cc ORDER BY rank))
    SELECT s, cc, p, q FROM n WHERE rank % 2 = 1 AND p <> q""")
def _(spark, d):
    return sampling.sample_pairs(Graph.of(spark, d).components, ["s", "cc"], "e", F.lit(10), 4)


@query("h1_select_items", f"WITH {H1} SELECT DISTINCT e FROM inc ORDER BY {_HASH.format(x='e')}, e LIMIT 100")
def _(spark, d):
    return sampling.select_items(views.h1(spark, d), "e", 100, 4)


@query("h1_stratified_edges", f"""WITH RECURSIVE {graph_sql()}, r AS (SELECT s, e, row_number() OVER (PARTITION BY s ORDER BY {_HASH.format(x="e")}, e) AS rank FROM mem)
    SELECT s, e FROM r WHERE rank <= CASE s WHEN 3 THEN 300 WHEN 2 THEN 200 END""")
def _(spark, d):
    return sampling.stratified_edges(Graph.of(spark, d).components, 500, 4)


@query("h1_pairs_within")
def _(spark, d):
    return sampling.pairs_within(Graph.of(spark, d).components, 500, 4)


@query("h1_query_pairs")
def _(spark, d):
    g = Graph.of(spark, d)
    return sampling.query_pairs(g.components, g.inc, 100, "both", 4)


@query("h1_labelled_members", f"""WITH {_LABEL}, r AS (SELECT label, e, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format(x="e")}, e) AS rank, count(*) OVER (PARTITION BY label) AS n FROM lb)
    SELECT label, e FROM r WHERE n >= 50 AND rank <= 50""")
def _(spark, d):
    return sampling.labelled_members(Graph.of(spark, d).labels, 50, 4)


# statistics


@query("h1_graph_stats", f"""WITH {H1}, u AS (SELECT DISTINCT list_sort(list(v)) AS vs FROM inc GROUP BY e), z AS (SELECT len(vs) AS size FROM u)
    SELECT (SELECT count(DISTINCT v) FROM inc) AS n_vertices, count(*) AS n_edges, max(size) AS dimension, CAST(sum(size) AS DOUBLE) / (SELECT count(DISTINCT v) FROM inc) AS mean_degree,
    {", ".join(f"count(*) FILTER (WHERE size >= {k}) AS size_{k}" for k in range(1, 11))} FROM z""")
def _(spark, d):
    return metrics.graph_stats(views.h1(spark, d))


@query("edge_label_histogram", """SELECT lower(trim(label)) AS label, count(*) AS n FROM (SELECT DISTINCT id, label FROM edge_labels) WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) >= 5""")
def _(spark, d):
    rows = table(spark, d, "edge_labels").distinct().where("label is not null").select(F.lower(F.trim("label")).alias("label"))
    return metrics.label_histogram(rows, 5)


@query("edge_label_ids", r"SELECT DISTINCT TRY_CAST(regexp_extract(trim(id), '([^-]*)$', 1) AS BIGINT) AS id, lower(trim(label)) AS label FROM edge_labels WHERE id IS NOT NULL")
def _(spark, d):
    rows = table(spark, d, "edge_labels").where("id is not null")
    return rows.select(scalars.label_id(F.col("id")).alias("id"), F.lower(F.trim("label")).alias("label")).distinct()


@query("run_summary", """WITH r AS (SELECT DISTINCT * FROM run_statistics), c AS (SELECT lower(trim(dataset)) AS dataset, lower(trim(ls)) AS ls, lower(trim(la)) AS la, * EXCLUDE (dataset, ls, la) FROM r)
    SELECT dataset, ls, la, count(*) AS runs, min(num_landmarks) AS min_landmarks, max(num_landmarks) AS max_landmarks, avg(num_landmarks) AS mean_landmarks, avg(oracle_size) AS mean_size,
    avg(offline) AS mean_offline, avg(CASE WHEN num_queries > 0 THEN online / num_queries END) AS query_time FROM c GROUP BY dataset, ls, la""")
def _(spark, d):
    return metrics.run_summary(table(spark, d, "run_statistics"))


@query("run_scalar_stats", """WITH r AS (SELECT DISTINCT * FROM run_statistics) SELECT lower(trim(ls)) AS ls, avg(offline) AS mean, quantile_cont(offline, 0.5) AS median, exp(avg(CASE WHEN offline > 0 THEN ln(offline) END)) AS geometric FROM r GROUP BY ALL""")
def _(spark, d):
    rows = table(spark, d, "run_statistics").distinct().withColumn("ls", F.lower(F.trim("ls")))
    return metrics.mean_median_geometric(rows, ["ls"], "offline")


@query("component_share", """SELECT s, cc, CAST(sum(size) AS DOUBLE) AS total, CAST(sum(size) AS DOUBLE) / sum(sum(size)) OVER (PARTITION BY s) AS share FROM (SELECT DISTINCT s, cc, size FROM ccs_sizes WHERE cc >= 0 AND size > 0) GROUP BY s, cc""")
def _(spark, d):
    rows = table(spark, d, "ccs_sizes").where("cc >= 0 and size > 0").distinct()
    return metrics.share_of_total(rows, ["s", "cc"], ["s"], "size")


@query("etfs_graph_counts", """WITH t AS (SELECT id, unnest(list_distinct(CAST(regexp_extract_all(edge, '[A-Za-z]*([0-9]+)', 1) AS BIGINT[]))) AS v FROM etfs WHERE edge IS NOT NULL), z AS (SELECT id, count(*) AS size FROM t GROUP BY id)
    SELECT count(*) AS n_edges, (SELECT count(DISTINCT v) FROM t) AS n_vertices, CAST(sum(size) AS BIGINT) AS n_incidences, max(size) AS dimension FROM z""")
def _(spark, d):
    lines = line_records(table(spark, d, "etfs"))
    return overlap.graph_counts(lines.select(F.col("id").alias("e"), F.explode("vs").alias("v")))


QUERIES.update(skewed.QUERIES)
SQL.update(skewed.SQL)
