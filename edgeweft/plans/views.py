"""Hypergraphs over the test tables.

H1: orders as hyperedges over parts. H2: customers as hyperedges over parts. Query elements are the
ids divisible by 20, as for all searches; they are looked up against all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bfs, components, exact, landmarks, oracle, overlap
from ..session import materialize, state
from ..sources.lines import table

#: Components of at most this many hyperedges get no landmarks.
LB = 4


def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.incidence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return overlap.incidence(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey"), "o_custkey", "l_partkey")


@dataclass
class Graph:
    """A hypergraph with what is derived from it, each written once when first needed."""

    spark: SparkSession
    sf_dir: str
    view: str = "h1"
    s_values: tuple[int, ...] = (2, 3)
    files: tuple = ()

    _known: ClassVar[dict[tuple, "Graph"]] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, view: str = "h1", s_values: tuple[int, ...] = (2, 3)) -> "Graph":
        """The graph of this session, folder and view: like a stored oracle, its tables serve all queries of the session."""
        key = (spark.sparkContext.applicationId, sf_dir, view, s_values)
        # names, sizes and times of the files: other files are another graph
        files = state(spark, [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "orders")])
        if key not in cls._known or cls._known[key].files != files:
            cls._known[key] = cls(spark, sf_dir, view, s_values, files)
        return cls._known[key]

    @classmethod
    def forget(cls) -> None:
        """Start anew: later queries build their tables again."""
        cls._known.clear()

    @cached_property
    def inc(self) -> DataFrame:
        return materialize({"h1": h1, "h2": h2}[self.view](self.spark, self.sf_dir), "inc")

    @cached_property
    def ov(self) -> DataFrame:
        return materialize(overlap.overlaps(self.inc, min(self.s_values)), "ov")

    @cached_property
    def adj(self) -> DataFrame:
        return bfs.tagged(overlap.adjacency(self.ov, list(self.s_values)), self.linked)

    @cached_property
    def linked(self) -> DataFrame:
        return materialize(components.connect_levels(self.ov, list(self.s_values)), "linked")

    @cached_property
    def components(self) -> DataFrame:
        return materialize(components.s_components(self.inc, self.ov, list(self.s_values), self.linked), "components")

    @cached_property
    def sizes(self) -> DataFrame:
        return materialize(components.component_sizes(self.components, self.inc), "sizes")

    @cached_property
    def assigned(self) -> DataFrame:
        """A landmark for every 20 hyperedges of a component with more than LB."""
        return self.sizes.where(F.col("size") > LB).select("s", "cc", "size", F.ceil(F.col("size") / 20).alias("n"))

    @cached_property
    def oracle(self) -> oracle.Oracle:
        chosen = materialize(landmarks.select_degree(self.components, self.assigned, self.adj), "landmarks")
        return oracle.Oracle(self.components, self.sizes, chosen, materialize(oracle.labels_of(self.adj, chosen), "labels"), LB)

    def oracle_of(self, most: int) -> oracle.Oracle:
        """The oracle with at most ``most`` landmarks in each component, for graphs with a large one."""
        if most not in self._oracles:
            few = self.sizes.where(F.col("size") > LB).select("s", "cc", "size", F.least("size", F.lit(most)).alias("n"))
            chosen = materialize(landmarks.select_degree(self.components, few, self.adj), "landmarks")
            self._oracles[most] = oracle.Oracle(self.components, self.sizes, chosen, materialize(oracle.labels_of(self.adj, chosen), "labels"), LB)
        return self._oracles[most]

    @cached_property
    def _oracles(self) -> dict[int, oracle.Oracle]:
        return {}

    @cached_property
    def sources(self) -> DataFrame:
        """(s, src): hyperedges divisible by 20."""
        return self.components.where("e % 20 = 0").select("s", F.col("e").alias("src"))

    @cached_property
    def reached(self) -> DataFrame:
        return materialize(bfs.distances(self.adj, self.sources), "reached")

    @cached_property
    def pairs(self) -> DataFrame:
        """(s, p, q): each source with the first hyperedge of its component."""
        return self.components.where("e % 20 = 0").select("s", F.col("e").alias("p"), F.col("cc").alias("q"))

    @cached_property
    def vertex_pairs(self) -> DataFrame:
        """(s, u, v): each vertex divisible by 20 with the next one."""
        u = self.inc.where("v % 20 = 0").select(F.col("v").alias("u")).distinct()
        return exact.with_s(u.withColumn("v", F.col("u") + 1), [2]).select("s", "u", "v")

    @cached_property
    def vertex_edge_pairs(self) -> DataFrame:
        """(s, v, q): each vertex divisible by 20 with the first hyperedge of the next one that has two vertices or more."""
        able = self.inc.join(overlap.edges_of_min_size(self.inc, 2).select("e"), "e")
        first = able.groupBy("v").agg(F.min("e").alias("q")).select((F.col("v") - 1).alias("v"), "q").where("v % 20 = 0")
        mine = self.inc.select("v").distinct()
        return exact.with_s(first.join(mine, "v"), [2]).select("s", "v", "q")

    @cached_property
    def labels(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "orders").select(F.col("o_orderkey").alias("e"), F.col("o_orderpriority").alias("label")).where("label is not null")


# SQL of the same

H1 = "inc AS MATERIALIZED (SELECT DISTINCT l_orderkey AS e, l_partkey AS v FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL)"
H2 = "inc AS MATERIALIZED (SELECT DISTINCT o_custkey AS e, l_partkey AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IS NOT NULL AND l_partkey IS NOT NULL)"
SIZES = "sz AS MATERIALIZED (SELECT e, count(*) AS size FROM inc GROUP BY e)"
OVERLAPS = "ov AS MATERIALIZED (SELECT a.e AS e1, b.e AS e2, count(*) AS w FROM inc a JOIN inc b ON a.v = b.v AND a.e < b.e GROUP BY a.e, b.e)"


def graph_sql(view: str = H1, s_values: tuple[int, ...] = (2, 3)) -> str:
    """inc, sz, ov, lev(s), adj(s, e, nb), mem(s, e)"""
    levels = ", ".join(f"({s})" for s in s_values)
    return f"""{view}, {SIZES}, {OVERLAPS}, lev(s) AS (VALUES {levels}),
        adj AS MATERIALIZED (SELECT s, e1 AS e, e2 AS nb FROM ov, lev WHERE w >= s UNION ALL SELECT s, e2, e1 FROM ov, lev WHERE w >= s),
        mem AS MATERIALIZED (SELECT s, e FROM sz, lev WHERE size >= s)"""


COMPONENTS = """comp(s, e, cc) USING KEY (s, e) AS (
        SELECT s, e, e FROM mem
        UNION
        SELECT a.s, a.e, min(c.cc) FROM comp c JOIN adj a ON a.s = c.s AND a.nb = c.e JOIN recurring.comp o ON o.s = a.s AND o.e = a.e
        GROUP BY a.s, a.e, o.cc HAVING min(c.cc) < o.cc),
    cs AS MATERIALIZED (SELECT c.s, c.cc, count(DISTINCT c.e) AS size, count(DISTINCT v) AS n_vertices FROM comp c JOIN inc USING (e) GROUP BY c.s, c.cc)"""


def bfs_sql(name: str, seeds: str) -> str:
    """name(s, src, e, d): distances from the rows (s, src) of a query."""
    return f"""{name}(s, src, e, d) USING KEY (s, src, e) AS (
        SELECT s, src, src, 0 FROM ({seeds})
        UNION
        SELECT DISTINCT b.s, b.src, a.nb, b.d + 1 FROM {name} b JOIN adj a ON a.s = b.s AND a.e = b.e
        LEFT JOIN recurring.{name} o ON o.s = b.s AND o.src = b.src AND o.e = a.nb WHERE o.e IS NULL)"""


REACHED = bfs_sql("reached", "SELECT s, e AS src FROM mem WHERE e % 20 = 0")
DEGREES = "dg AS MATERIALIZED (SELECT s, e, count(*) AS degree FROM adj GROUP BY s, e)"
LANDMARKS = f"""{DEGREES},
    lmk AS MATERIALIZED (SELECT c.s, c.cc, c.e AS landmark FROM comp c JOIN cs USING (s, cc) LEFT JOIN dg ON dg.s = c.s AND dg.e = c.e WHERE size > {LB}
        QUALIFY row_number() OVER (PARTITION BY c.s, c.cc ORDER BY coalesce(degree, 0) DESC, c.e) <= ceil(size / 20.0))"""
LABELS = bfs_sql("lab", "SELECT s, landmark AS src FROM lmk")
ORACLE = f"{graph_sql()}, {COMPONENTS}, {LANDMARKS}, {LABELS}"
PAIRS = "pr AS MATERIALIZED (SELECT s, e AS p, cc AS q FROM comp WHERE e % 20 = 0)"
SMALL = "CASE size WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1.15 WHEN 4 THEN 1.2525 END"


def bounds_sql(pairs: str, name: str = "bd") -> str:
    """name(s, p, q, lb, ub, d_hat) of the pairs (s, p, q) of a relation; needs ORACLE."""
    return f"""{name}_k AS MATERIALIZED (SELECT x.s, x.p, x.q, size FROM (SELECT DISTINCT s, p, q FROM {pairs}) x JOIN comp a ON a.s = x.s AND a.e = x.p
            JOIN comp b ON b.s = x.s AND b.e = x.q AND b.cc = a.cc JOIN cs ON cs.s = x.s AND cs.cc = a.cc),
        {name}_b AS (SELECT s, p, q, 1.0::DOUBLE AS lb, size::DOUBLE AS ub, ({SMALL})::DOUBLE AS d_hat FROM {name}_k WHERE size <= {LB}
            UNION ALL
            SELECT k.s, p, q, max(abs(l1.d - l2.d))::DOUBLE, min(l1.d + l2.d)::DOUBLE, max(abs(l1.d - l2.d)) + (min(l1.d + l2.d) - max(abs(l1.d - l2.d))) / 2.0::DOUBLE
            FROM {name}_k k JOIN lab l1 ON l1.s = k.s AND l1.e = k.p JOIN lab l2 ON l2.s = k.s AND l2.e = k.q AND l2.src = l1.src WHERE size > {LB} GROUP BY ALL),
        {name} AS MATERIALIZED (SELECT x.s, x.p, x.q, CASE WHEN x.p = x.q AND lb IS NOT NULL THEN 0.0 ELSE coalesce(lb, -1.0) END::DOUBLE AS lb,
            CASE WHEN x.p = x.q AND ub IS NOT NULL THEN 0.0 ELSE coalesce(ub, -1.0) END::DOUBLE AS ub, CASE WHEN x.p = x.q AND d_hat IS NOT NULL THEN 0.0 ELSE coalesce(d_hat, -1.0) END::DOUBLE AS d_hat
            FROM (SELECT DISTINCT s, p, q FROM {pairs}) x LEFT JOIN {name}_b b ON b.s = x.s AND b.p = x.p AND b.q = x.q)"""
