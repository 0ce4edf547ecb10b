"""SQL of landmark selection, oracle building and sampling; queries over a large component, and over the ways of working that
only large inputs take by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import bfs, components as cc, exact, landmarks, oracle, overlap, sampling, stars
from ..sources.lines import table
from . import contract, views
from .contract import SQL, query
from .views import COMPONENTS, DEGREES, H1, H2, LABELS, LB, ORACLE, OVERLAPS, Graph, bfs_sql, bounds_sql, graph_sql

_HASH = "({x} % 2147483647 * 48271 + 4 * 69621) % 2147483647"
_GRAPH = f"{graph_sql()}, {COMPONENTS}"

# landmark selection: q(s, cc, size, n), then (s, cc, landmark)

_QUOTA = f"q AS MATERIALIZED (SELECT s, cc, size, CAST(ceil(size / 20.0) AS BIGINT) AS n FROM cs WHERE size > {LB})"
_SAMPLE = f"""{_QUOTA},
    sm AS (SELECT c.s, c.cc, c.e, size, row_number() OVER (PARTITION BY c.s, c.cc ORDER BY {_HASH.format(x="c.e")}, c.e) AS rank FROM comp c JOIN q USING (s, cc)),
    sr AS (SELECT * FROM sm WHERE rank <= greatest(2, ceil(0.4::DOUBLE * size))),
    sn AS (SELECT s, cc, e AS p, rank, coalesce(lead(e) OVER w, first(e) OVER w) AS q FROM sr WINDOW w AS (PARTITION BY s, cc ORDER BY rank)),
    sp AS MATERIALIZED (SELECT s, cc, p, q FROM sn WHERE rank % 2 = 1 AND p <> q), {bfs_sql("rr", "SELECT DISTINCT s, p AS src FROM sp")},
    pa AS MATERIALIZED (SELECT r.s, r.src, r.e, x.e AS parent FROM rr r JOIN adj a ON a.s = r.s AND a.e = r.e JOIN rr x ON x.s = r.s AND x.src = r.src AND x.e = a.nb AND x.d = r.d - 1)"""


def _paths(parents: str) -> str:
    """pt(s, cc, p, q, path) of the sampled pairs."""
    return f"""wk(s, cc, p, q, node, path) AS (SELECT s, cc, p, q, q, [q] FROM sp UNION ALL
        SELECT w.s, w.cc, w.p, w.q, x.parent, list_prepend(x.parent, w.path) FROM wk w JOIN {parents} x ON x.s = w.s AND x.src = w.p AND x.e = w.node),
    pt AS MATERIALIZED (SELECT s, cc, p, q, path FROM wk WHERE node = p)"""


_ALL_PATHS = f"{_SAMPLE}, {_paths('pa')}"
_ONE_PATH = f"{_SAMPLE}, {_paths('(SELECT s, src, e, min(parent) AS parent FROM pa GROUP BY ALL)')}"
# chosen(s, cc, landmark), then those of largest degree up to n
_FILLED = f"""{DEGREES}, had AS (SELECT s, cc, count(*) AS had FROM chosen GROUP BY s, cc),
    fill AS (SELECT c.s, c.cc, c.e AS landmark FROM comp c JOIN q USING (s, cc) LEFT JOIN had USING (s, cc) LEFT JOIN dg ON dg.s = c.s AND dg.e = c.e
        WHERE NOT EXISTS (SELECT 1 FROM chosen x WHERE x.s = c.s AND x.landmark = c.e)
        QUALIFY row_number() OVER (PARTITION BY c.s, c.cc ORDER BY coalesce(degree, 0) DESC, c.e) <= n - coalesce(had, 0))
    SELECT s, cc, landmark FROM chosen UNION ALL SELECT s, cc, landmark FROM fill"""
_COUNTS = "pc AS (SELECT s, cc, e, count(*) AS c FROM (SELECT s, cc, unnest(path) AS e FROM pt) GROUP BY s, cc, e)"

SQL["h1_paths_cover"] = f"WITH RECURSIVE {_GRAPH}, {_ALL_PATHS}, {_COUNTS} SELECT s, cc, e, c AS n FROM pc"
SQL["h1_landmarks_between"] = f"""WITH RECURSIVE {_GRAPH}, {_ALL_PATHS}, {_COUNTS},
    chosen AS MATERIALIZED (SELECT pc.s, pc.cc, pc.e AS landmark FROM pc JOIN q USING (s, cc) QUALIFY row_number() OVER (PARTITION BY pc.s, pc.cc ORDER BY c DESC, pc.e) <= n), {_FILLED}"""
SQL["h1_landmarks_bestcover"] = f"""WITH RECURSIVE {_GRAPH}, {_ONE_PATH}, pn AS MATERIALIZED (SELECT s, cc, path, unnest(path) AS e FROM pt),
    cover(s, cc, k, picks) AS (SELECT s, cc, 0, []::BIGINT[] FROM q UNION ALL
        SELECT s, cc, k + 1, list_append(picks, e) FROM (SELECT v.s, v.cc, v.k, v.picks, pn.e, count(*) AS c FROM cover v JOIN q ON q.s = v.s AND q.cc = v.cc AND v.k < q.n
            JOIN pn ON pn.s = v.s AND pn.cc = v.cc AND NOT list_has_any(pn.path, v.picks) GROUP BY v.s, v.cc, v.k, v.picks, pn.e)
        QUALIFY row_number() OVER (PARTITION BY s, cc ORDER BY c DESC, e) = 1),
    last AS (SELECT s, cc, picks FROM cover QUALIFY row_number() OVER (PARTITION BY s, cc ORDER BY k DESC) = 1),
    chosen AS MATERIALIZED (SELECT s, cc, unnest(picks) AS landmark FROM last), {_FILLED}"""
SQL["h1_landmarks_farthest"] = f"""WITH RECURSIVE {_GRAPH}, {_QUOTA}, {bfs_sql("dd", "SELECT c.s, c.e AS src FROM comp c JOIN q USING (s, cc)")},
    first AS (SELECT c.s, c.cc, c.e FROM comp c JOIN q USING (s, cc) QUALIFY row_number() OVER (PARTITION BY c.s, c.cc ORDER BY {_HASH.format(x="c.e")}, c.e) = 1),
    far(s, cc, k, picks) AS (SELECT s, cc, 1, [e] FROM first UNION ALL
        SELECT s, cc, k + 1, list_append(picks, e) FROM (SELECT f.s, f.cc, f.k, f.picks, dd.e, min(dd.d) AS m FROM far f JOIN q ON q.s = f.s AND q.cc = f.cc AND f.k < q.n
            JOIN dd ON dd.s = f.s AND list_contains(f.picks, dd.src) GROUP BY f.s, f.cc, f.k, f.picks, dd.e HAVING min(dd.d) > 0)
        QUALIFY row_number() OVER (PARTITION BY s, cc ORDER BY m DESC, e) = 1),
    last AS (SELECT s, cc, picks FROM far QUALIFY row_number() OVER (PARTITION BY s, cc ORDER BY k DESC) = 1)
    SELECT s, cc, unnest(picks) AS landmark FROM last"""


# assignment and building


def _assigned(name: str, source: str, budget: str, alpha: float, beta: float) -> str:
    """name(s, cc, size, n) for the components of a relation; ``budget`` is a scalar expression."""
    gamma = round(1 - alpha - beta, 9)
    return f"""{name}_o AS MATERIALIZED (SELECT * FROM {source} WHERE size > {LB}), {name}_b AS (SELECT CAST({budget} AS BIGINT) AS budget),
    {name}_t AS (SELECT CAST(sum(size) AS DOUBLE) AS a, CAST(sum(s) AS DOUBLE) AS b, CAST(sum(n_vertices) AS DOUBLE) AS c FROM {name}_o),
    {name}_p AS MATERIALIZED (SELECT o.*, {alpha} * size / a + {beta} * s / b + {gamma} * n_vertices / c AS p FROM {name}_o o, {name}_t),
    {name}_k AS (SELECT greatest(1, floor((SELECT budget FROM {name}_b) / sum(p * size))) AS k FROM {name}_p),
    {name}_u AS (SELECT x.*, k, sum(p) OVER (ORDER BY s, cc) AS upto FROM {name}_p x, {name}_k),
    {name}_n AS (SELECT s, cc, size, CAST(least(size, greatest(0, floor(upto * k + 0.5 - 1e-9) - floor((upto - p) * k + 0.5 - 1e-9))) AS BIGINT) AS n FROM {name}_u),
    {name} AS MATERIALIZED (SELECT s, cc, size, n FROM {name}_n WHERE n > 0 AND (SELECT sum(size * size) FROM {name}_o) > (SELECT budget FROM {name}_b)
        UNION ALL SELECT s, cc, size, size FROM {name}_o WHERE (SELECT sum(size * size) FROM {name}_o) <= (SELECT budget FROM {name}_b))"""


def _built(levels: tuple[int, ...], assigned: str) -> str:
    """Labels of the landmarks of largest degree, n of each component of ``asg``."""
    return f"""WITH RECURSIVE {graph_sql(H2, levels)}, {COMPONENTS}, {assigned}, {DEGREES},
    lmk AS MATERIALIZED (SELECT c.s, c.cc, c.e AS landmark FROM comp c JOIN asg USING (s, cc) LEFT JOIN dg ON dg.s = c.s AND dg.e = c.e
        QUALIFY row_number() OVER (PARTITION BY c.s, c.cc ORDER BY coalesce(degree, 0) DESC, c.e) <= n), {LABELS}
    SELECT s, src AS landmark, e, d AS dist FROM lab"""


_EDGES = "(SELECT count(*) FROM sz)"
SQL["h2_assignment_sampling"] = f"WITH RECURSIVE {graph_sql(H2, (4, 5, 6))}, {COMPONENTS}, {_assigned('asg', 'cs', f'30 * {_EDGES}', 0.2, 0.6)} SELECT s, cc, size, n FROM asg"
SQL["h2_oracle_build"] = _built((5, 6), _assigned("asg", "cs", f"10 * {_EDGES}", 0.2, 0.6))
_HALVES = [_assigned(f"asg{s}", f"(SELECT * FROM cs WHERE s = {s})", f"10 * {_EDGES} // 2", 0.5, 0.0) for s in (5, 6)]
SQL["h2_oracle_build_split"] = _built((5, 6), f"{', '.join(_HALVES)}, asg AS (SELECT * FROM asg5 UNION ALL SELECT * FROM asg6)")
SQL["h2_oracle_build_baseline"] = f"""WITH RECURSIVE {graph_sql(H2, (5, 6))}, {COMPONENTS}, {DEGREES},
    r AS (SELECT c.s, c.e, size, row_number() OVER (PARTITION BY c.s ORDER BY coalesce(degree, 0) DESC, c.e) AS r FROM comp c JOIN cs USING (s, cc) LEFT JOIN dg ON dg.s = c.s AND dg.e = c.e),
    u AS (SELECT *, sum(size) OVER (ORDER BY r, s) - size AS before FROM r), lmk AS MATERIALIZED (SELECT s, e AS landmark FROM u WHERE before < 4 * {_EDGES}), {LABELS}
    SELECT s, src AS landmark, e, d AS dist FROM lab"""

# samples

SQL["h1_pairs_within"] = f"""WITH RECURSIVE {_GRAPH},
    r AS (SELECT c.s, c.cc, c.e, size, row_number() OVER (PARTITION BY c.s, c.cc ORDER BY {_HASH.format(x="c.e")}, c.e) AS rank FROM comp c JOIN cs USING (s, cc) WHERE size >= 3)
    SELECT a.s, least(a.e, b.e) AS p, greatest(a.e, b.e) AS q FROM r a JOIN r b ON b.s = a.s AND b.cc = a.cc AND b.rank > a.rank
    ORDER BY b.rank - a.rank, {_HASH.format(x="a.e")}, a.s, p, q LIMIT 500"""
SQL["h1_query_pairs"] = f"""WITH {graph_sql()}, r AS (SELECT s, e, row_number() OVER (PARTITION BY s ORDER BY {_HASH.format(x="e")}, e) AS rank FROM mem),
    x AS (SELECT DISTINCT e FROM r WHERE rank <= CASE s WHEN 3 THEN 120 WHEN 2 THEN 80 END),
    y AS (SELECT e, row_number() OVER (ORDER BY {_HASH.format(x="e")}, e) AS rank FROM x), z AS (SELECT * FROM y WHERE rank <= 200),
    n AS (SELECT e AS p, rank, coalesce(lead(e) OVER w, first(e) OVER w) AS q FROM z WINDOW w AS (ORDER BY rank)),
    f AS (SELECT e AS p, v FROM inc QUALIFY row_number() OVER (PARTITION BY e ORDER BY {_HASH.format(x="v")}, v) = 1)
    SELECT DISTINCT v, q FROM n JOIN f USING (p) WHERE rank % 2 = 1 AND p <> q"""

# pairs of a vertex and a hyperedge that are connected

_LINKED_VE = """ok AS MATERIALIZED (SELECT v, inc.e FROM inc JOIN sz USING (e) WHERE size >= 2),
    vq AS MATERIALIZED (SELECT DISTINCT 2 AS s, ok.v, c.cc AS q FROM ok JOIN comp c ON c.s = 2 AND c.e = ok.e WHERE ok.v % 20 = 0 AND c.cc <> c.e),
    ends AS MATERIALIZED (SELECT vq.s, vq.v, vq.q, a.e AS p FROM vq JOIN ok a ON a.v = vq.v)"""


def _linked_pairs(g: Graph) -> DataFrame:
    """(s, v, q): each vertex divisible by 20 with the first hyperedge of every component that one of its hyperedges is in."""
    mine = g.inc.where("v % 20 = 0").join(g.components.where("s = 2 and cc <> e"), "e")
    return mine.select("s", "v", F.col("cc").alias("q")).distinct()


@query("h1_exact_vertex_edge_profile_linked", f"""WITH RECURSIVE {graph_sql(H1, (2,))}, {COMPONENTS}, {_LINKED_VE}, {bfs_sql("r", "SELECT DISTINCT s, q AS src FROM ends")}
    SELECT n.s, v, q, min(d) AS d FROM ends n JOIN r ON r.s = n.s AND r.src = q AND r.e = p WHERE d > 0 GROUP BY n.s, v, q""")
def _(spark, d):
    g = Graph.of(spark, d, s_values=(2,))
    return exact.profiles("both", g.adj, g.inc, _linked_pairs(g))


@query("h1_oracle_query_vertex_edge_linked", f"""WITH RECURSIVE {ORACLE}, {_LINKED_VE}, {bounds_sql("ends")},
    best AS (SELECT n.s, n.v, n.q, lb, ub, d_hat FROM ends n JOIN bd USING (s, p, q) WHERE d_hat >= 0 QUALIFY row_number() OVER (PARTITION BY n.s, n.v, n.q ORDER BY d_hat, lb, ub, n.p, n.q) = 1)
    SELECT vq.s, vq.v, vq.q, coalesce(lb, -1.0)::DOUBLE AS lb, coalesce(ub, -1.0)::DOUBLE AS ub, coalesce(d_hat, -1.0)::DOUBLE AS d_hat FROM vq LEFT JOIN best b ON b.s = vq.s AND b.v = vq.v AND b.q = vq.q""")
def _(spark, d):
    g = Graph.of(spark, d)
    return oracle.bounds("both", g.oracle, g.inc, _linked_pairs(g))


# all levels from s = 1 on, and a large component at every scale: customers that share two parts


@query("h1_components_all_s", f"WITH RECURSIVE {graph_sql(H1, (1, 2, 3, 4))}, {COMPONENTS} SELECT s, e, cc FROM comp")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("e"), F.col("l_partkey").cast("bigint").alias("v"))
    return stars.s_components(lines, [1, 2, 3, 4])


_LARGE = f"""{graph_sql(H2, (2,))}, {COMPONENTS}, {DEGREES},
    lmk AS MATERIALIZED (SELECT c.s, c.cc, c.e AS landmark FROM comp c JOIN cs USING (s, cc) LEFT JOIN dg ON dg.s = c.s AND dg.e = c.e WHERE size > {LB}
        QUALIFY row_number() OVER (PARTITION BY c.s, c.cc ORDER BY coalesce(degree, 0) DESC, c.e) <= least(size, 10)), {LABELS}"""


def _large(spark, d) -> oracle.Oracle:
    return Graph.of(spark, d, "h2", (2,)).oracle_of(10)


@query("h2_large_component_sizes", f"WITH RECURSIVE {graph_sql(H2, (2,))}, {COMPONENTS} SELECT s, cc, size, n_vertices FROM cs")
def _(spark, d):
    return Graph.of(spark, d, "h2", (2,)).sizes


@query("h2_large_landmarks", f"WITH RECURSIVE {_LARGE} SELECT s, cc, landmark FROM lmk")
def _(spark, d):
    return _large(spark, d).landmarks


@query("h2_large_oracle_labels", f"WITH RECURSIVE {_LARGE} SELECT s, src AS landmark, e, d AS dist FROM lab")
def _(spark, d):
    return _large(spark, d).labels


@query("h2_large_oracle_query_edge", f"WITH RECURSIVE {_LARGE}, {views.PAIRS}, {bounds_sql('pr')} SELECT s, p, q, lb, ub, d_hat FROM bd")
def _(spark, d):
    return oracle.edge_bounds(_large(spark, d), Graph.of(spark, d, "h2", (2,)).pairs)


@query("h2_large_closeness_approx", f"WITH RECURSIVE {_LARGE}, {contract._APPROX} SELECT s, e, closeness FROM ac")
def _(spark, d):
    return oracle.approx_closeness(_large(spark, d), Graph.of(spark, d, "h2", (2,)).components.select("s", "e"))


@query("h2_large_topk_landmarks", f"""WITH RECURSIVE {_LARGE} SELECT s, e AS q, CAST(row_number() OVER w AS INTEGER) AS rank, src AS e, d AS dist FROM lab WHERE e % 20 = 0 AND src <> e
    WINDOW w AS (PARTITION BY s, lab.e ORDER BY d, src) QUALIFY row_number() OVER w <= 5""")
def _(spark, d):
    return oracle.nearest_landmarks(_large(spark, d), Graph.of(spark, d, "h2", (2,)).sources.select("s", F.col("src").alias("q")), 5)


# the ways that large inputs take


def _same(name: str, as_of: str):
    return query(name, SQL[as_of])


@_same("line_graph_components_stars", "line_graph_components")
def _(spark, d):
    lines = table(spark, d, "line_graph").where("s is not null and u >= 0 and v >= 0")
    return cc.connect(lines.select("s", F.col("u").alias("e"), F.col("v").alias("nb")), one_task_edges=0)


@_same("h1_s_components_stars", "h1_s_components")
def _(spark, d):
    g = Graph.of(spark, d)
    return cc.s_components(g.inc, g.ov, [2, 3], cc.connect_levels(g.ov, [2, 3], one_task_edges=0))


@_same("h1_bfs_by_level", "h1_bfs")
def _(spark, d):
    g = Graph.of(spark, d)
    return bfs.level_distances(g.adj, g.sources)


@_same("h1_all_shortest_paths_by_level", "h1_all_shortest_paths")
def _(spark, d):
    g = Graph.of(spark, d)
    return bfs._level_paths(g.adj, g.pairs, True)


@query("h1_topk_label_by_level", SQL["h1_topk_label"])
def _(spark, d):
    g = Graph.of(spark, d)
    wanted = g.sources.select(F.col("src").alias("e")).distinct().join(g.labels, "e").select(F.col("e").alias("src"), "label")
    found = bfs._level_labelled(g.adj.select("s", "e", "nb"), g.sources, g.labels, wanted, 3)
    return exact.ranked_nearest(found, 3)


@_same("h1_overlaps_by_pairs", "h1_overlaps")
def _(spark, d):
    return overlap.overlaps(Graph.of(spark, d).inc, 2, method="pairs")


@_same("h1_overlaps_by_vertices", "h1_overlaps")
def _(spark, d):
    return overlap.overlaps(Graph.of(spark, d).inc, 2, method="vertices")


@_same("h1_overlaps_by_prefix", "h1_overlaps")
def _(spark, d):
    return overlap.overlaps(Graph.of(spark, d).inc, 2, method="prefix")


@query("h1_overlap_counts_in_blocks", f"WITH {H1}, {OVERLAPS} SELECT w, count(*) AS n FROM ov GROUP BY w")
def _(spark, d):
    inc = Graph.of(spark, d).inc
    degrees = overlap.vertex_degrees(inc)
    most = degrees.agg(F.avg("degree")).first()[0] or 0
    return overlap.met_in_blocks(inc, int(most)).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@_same("h1_landmarks_degree_salted", "h1_landmarks_degree")
def _(spark, d):
    g = Graph.of(spark, d)
    members = landmarks.with_degree(landmarks._quota(g.components, g.assigned), g.adj)
    return landmarks.by_rank(members, [F.col("degree").desc(), F.col("e")], per_task=10)



@_same("h1_landmarks_bestcover_in_rounds", "h1_landmarks_bestcover")
def _(spark, d):
    g = Graph.of(spark, d)
    return landmarks.select_bestcover(g.components, g.assigned, g.adj, 0.4, 4, places_per_task=0)


@_same("h1_landmarks_farthest_in_rounds", "h1_landmarks_farthest")
def _(spark, d):
    g = Graph.of(spark, d)
    members = landmarks._quota(g.components, g.assigned)
    first = sampling.ranked(members, ["s", "cc"], "e", 4).where("rank = 1").select("s", "cc", F.col("e").alias("landmark"))
    return landmarks.farthest_in_rounds(members, first, g.adj)
