"""Queries over stored distance indexes."""

from __future__ import annotations

from ..operators import coretree, hubs, indexes
from ..session import folder
from .contract import SQL, query
from .views import COMPONENTS, DEGREES, PAIRS, Graph, bfs_sql, graph_sql

_EXACT_LINKED = SQL["h1_hub_label_distances"]


@query("h1_core_tree_distances_w4", _EXACT_LINKED)
def _(spark, d):
    g = Graph.of(spark, d)
    return coretree.core_tree_distances(g.adj, g.pairs, 4)


@query("h1_core_tree_distances_by_rounds", _EXACT_LINKED)
def _(spark, d):
    g = Graph.of(spark, d)
    labels, core = coretree.split_in_rounds(g.adj.select("s", "e", "nb"), 1)
    units, ranks = coretree.unit_links(core)
    return coretree.CoreTree(labels, hubs.hub_labels(units, ranks).where("e >= 0")).distances(g.pairs)


# roots by rank, none of them a neighbour of an earlier one's marked neighbours; the bound is the least way over a root or a marked neighbour
_ROOTS = f"""rk AS MATERIALIZED (SELECT s, e, row_number() OVER (PARTITION BY s ORDER BY degree DESC, e) AS rank FROM dg),
    rt(s, k, used, src) AS (
        SELECT s, 0, []::BIGINT[], []::BIGINT[] FROM (SELECT DISTINCT s FROM rk)
        UNION ALL
        SELECT s, k + 1, list_concat(used, picked), list_concat(src, picked) FROM (
            SELECT t.s, t.k, t.used, t.src, list_prepend(t.root, coalesce(list(x.e) FILTER (WHERE x.e IS NOT NULL), [])) AS picked FROM (
                SELECT r.s, r.k, r.used, r.src, (arg_min(rk.e, rk.rank)) AS root FROM rt r JOIN rk ON rk.s = r.s AND NOT list_contains(r.used, rk.e) WHERE r.k < 2 GROUP BY r.s, r.k, r.used, r.src) t
            LEFT JOIN (SELECT a.s, a.e AS root, k.e FROM adj a JOIN rk k ON k.s = a.s AND k.e = a.nb) x ON x.s = t.s AND x.root = t.root AND NOT list_contains(t.used, x.e)
            GROUP BY t.s, t.k, t.used, t.src, t.root)),
    bs AS MATERIALIZED (SELECT DISTINCT s, unnest(src) AS src FROM rt WHERE k = 2)"""


@query("h1_bit_parallel_bounds", f"""WITH RECURSIVE {graph_sql()}, {COMPONENTS}, {PAIRS}, {DEGREES}, {_ROOTS}, {bfs_sql("br", "SELECT s, src FROM bs")}
    SELECT pr.s, p, q, CAST(min(x.d + y.d) AS INTEGER) AS ub FROM pr JOIN br x ON x.s = pr.s AND x.e = p JOIN br y ON y.s = pr.s AND y.e = q AND y.src = x.src GROUP BY pr.s, p, q""")
def _(spark, d):
    # no node of these graphs has more than 63 neighbours, so all neighbours of a root are marked
    g = Graph.of(spark, d)
    return hubs.bit_parallel_bounds(g.pairs, hubs.bit_parallel_labels(g.adj, roots=2))


def _stored(g: Graph, kind: str) -> indexes.Index:
    """The index as it is read back from files."""
    at = folder(g.spark, f"index-{kind}")
    indexes.build(kind, g.adj, g.oracle.landmarks if kind == "highway" else None, width=4).save(at)
    return indexes.Index.load(g.spark, at, kind)


@query("h1_stored_highway_distances", SQL["h1_highway_distances"])
def _(spark, d):
    g = Graph.of(spark, d)
    return _stored(g, "highway").distances(g.pairs)


@query("h1_stored_hub_distances", _EXACT_LINKED)
def _(spark, d):
    g = Graph.of(spark, d)
    return _stored(g, "hubs").distances(g.pairs)


@query("h1_stored_core_tree_distances", _EXACT_LINKED)
def _(spark, d):
    g = Graph.of(spark, d)
    return _stored(g, "coretree").distances(g.pairs)


@query("h1_index_statistics", f"""WITH RECURSIVE {_EXACT_LINKED.split("WITH RECURSIVE ", 1)[1].rsplit("SELECT pr.s", 1)[0]}
    SELECT pr.s, count(*) AS n_queries, count(d) AS n_answered, min(d) AS least, max(d) AS most, avg(d) AS mean
    FROM pr LEFT JOIN reached r ON r.s = pr.s AND r.src = p AND r.e = q AND EXISTS (SELECT 1 FROM adj WHERE adj.s = pr.s AND adj.e = p) GROUP BY pr.s""")
def _(spark, d):
    g = Graph.of(spark, d)
    found = hubs.hub_distances(g.pairs, hubs.hub_labels(g.adj))
    return indexes.distance_statistics(indexes.answered(g.pairs, found))
