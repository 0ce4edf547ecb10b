"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.lines import line_records, table
from . import audiences, components, copies, encoding, packing, residue, setjoin, together, topn


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.linked_groups(table(spark, sf_dir, "line_graph"))


def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components.linked_groups(table(spark, sf_dir, "line_graph"))
    return found.groupBy("s", "cc").agg(F.count(F.lit(1)).alias("size"))


def p1_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an eighth of all rows in a task, so that forests are merged over several levels at every size."""
    links = table(spark, sf_dir, "line_graph")
    return components.linked_groups(links, max(1, links.count() // 8))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_records(table(spark, sf_dir, "etfs").where(F.col("dataset").isNotNull()), "dataset")
    return lines.select(F.col("dataset").alias("ds"), F.explode("vs").alias("v"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audiences.strong_overlaps(_members(spark, sf_dir), 3, 10).select("ds1", "ds2")


def p2_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audiences.overlap_sizes(_members(spark, sf_dir))[0]


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_records(table(spark, sf_dir, "etfs")).select("id", "vs")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.expand(*setjoin.similar_records(_sets(spark, sf_dir), "0.7", 4))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with at least 4 vertices: its representative, and the links of that to others."""
    members, pairs = setjoin.similar_records(_sets(spark, sf_dir), "0.7", 4)
    ends = pairs.select(F.explode(F.array("id1", "id2")).alias("rep"))
    links = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, "rep", "left").select("id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidates").where("cc >= 0 and num_neig >= 0")
    return topn.top_items(rows, ["s", "cc"], "e", "num_neig", 5).select("s", "cc", "e")


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_groups(line_records(table(spark, sf_dir, "etfs")), "tokens")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).where("id = keep_id").select("keep_id", "copies")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together.associations(_sets(spark, sf_dir), 8, 4.0).select("v1", "v2")


def p6_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together.associations(_sets(spark, sf_dir), 8, 4.0)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.corpus_ids(table(spark, sf_dir, "documents"))


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_sizes": p1_sizes, "p1_merged": p1_merged, "p2_found": p2_found, "p2_overlaps": p2_overlaps, "p3_found": p3_found,
    "p3_classes": p3_classes, "p4_found": p4_found, "p5_found": p5_found, "p5_kept": p5_kept, "p6_found": p6_found, "p6_ratios": p6_ratios,
    "p8_ids": p8_ids, "p9_packing": p9_packing, "p10_found": p10_found,
}

_RECORDS = """
    tok AS (SELECT id, dataset, list_sort(CAST(regexp_extract_all(edge, '[A-Za-z]*([0-9]+)', 1) AS BIGINT[])) AS tokens
            FROM etfs WHERE edge IS NOT NULL),
    rec AS (SELECT id, dataset, tokens, list_sort(list_distinct(tokens)) AS vs FROM tok WHERE len(tokens) > 0)"""
_COMPONENTS = """
    l AS (SELECT DISTINCT s, u, v FROM line_graph WHERE s IS NOT NULL AND u >= 0 AND v >= 0 AND u <> v),
    b AS (SELECT s, u, v FROM l UNION SELECT s, v, u FROM l),
    c(s, e, cc) USING KEY (s, e) AS (
        SELECT s, u, least(u, min(v)) FROM b GROUP BY s, u
        UNION
        SELECT b.s, b.u, min(c.cc) FROM c JOIN b ON b.s = c.s AND b.v = c.e JOIN recurring.c AS o ON o.s = b.s AND o.e = b.u
        GROUP BY b.s, b.u, o.cc HAVING min(c.cc) < o.cc)"""
_OVERLAPS = """
    m AS (SELECT DISTINCT dataset AS ds, unnest(vs) AS v FROM rec WHERE dataset IS NOT NULL),
    z AS (SELECT ds, count(*) AS size FROM m GROUP BY ds),
    o AS (SELECT a.ds AS ds1, b.ds AS ds2, count(*) AS shared FROM m a JOIN m b ON a.v = b.v AND a.ds < b.ds GROUP BY ALL)"""
_SIMILAR = """
    big AS (SELECT id, vs, len(vs) AS k FROM rec WHERE len(vs) >= 4),
    inc AS (SELECT id, k, unnest(vs) AS v FROM big),
    sim AS (SELECT a.id AS id1, b.id AS id2 FROM inc a JOIN inc b ON a.v = b.v AND a.id < b.id
            GROUP BY a.id, b.id, a.k, b.k HAVING 10 * count(*) >= 7 * (a.k + b.k - count(*)))"""
_RATIOS = """
    inc AS (SELECT id, unnest(vs) AS v FROM rec),
    c AS (SELECT v, count(*) AS n FROM inc GROUP BY v),
    p AS (SELECT a.v AS v1, b.v AS v2, count(*) AS n12 FROM inc a JOIN inc b ON a.id = b.id AND a.v < b.v GROUP BY ALL HAVING count(*) >= 8),
    r AS (SELECT v1, v2, c1.n AS n1, c2.n AS n2, n12,
                 n12 * CAST((SELECT count(*) FROM rec) AS DOUBLE) / (CAST(c1.n AS DOUBLE) * c2.n) AS ratio
          FROM p JOIN c c1 ON c1.v = v1 JOIN c c2 ON c2.v = v2)"""
_COPIES = ", g AS (SELECT id, min(id) OVER w AS keep_id, count(*) OVER w AS copies FROM rec WINDOW w AS (PARTITION BY tokens))"

SQL = {
    "p1_found": f"WITH RECURSIVE {_COMPONENTS} SELECT s, e, cc FROM c",
    "p1_sizes": f"WITH RECURSIVE {_COMPONENTS} SELECT s, cc, count(*) AS size FROM c GROUP BY s, cc",
    "p1_merged": f"WITH RECURSIVE {_COMPONENTS} SELECT s, e, cc FROM c",
    "p2_found": f"""WITH {_RECORDS}, {_OVERLAPS}
        SELECT ds1, ds2 FROM o JOIN z a ON a.ds = ds1 JOIN z b ON b.ds = ds2 WHERE 10 * shared >= 3 * least(a.size, b.size)""",
    "p2_overlaps": f"WITH {_RECORDS}, {_OVERLAPS} SELECT ds1, ds2, shared FROM o",
    "p3_found": f"WITH {_RECORDS}, {_SIMILAR} SELECT id1, id2 FROM sim",
    "p3_classes": f"""WITH {_RECORDS}, {_SIMILAR},
        g AS (SELECT id, min(id) OVER w AS rep, count(*) OVER w AS copies FROM big WINDOW w AS (PARTITION BY vs)),
        ends AS (SELECT id1 AS id, id2 AS other FROM sim UNION ALL SELECT id2, id1 FROM sim),
        n AS (SELECT ends.id, count(*) AS links FROM ends JOIN g x ON x.id = ends.id JOIN g y ON y.id = other
              WHERE x.rep = x.id AND y.rep = y.id AND x.rep <> y.rep GROUP BY ends.id)
        SELECT g.id, rep, copies, CAST(coalesce(links, 0) AS BIGINT) AS links FROM g LEFT JOIN n ON n.id = rep""",
    "p4_found": """
        WITH b AS (SELECT s, cc, e, max(num_neig) AS num_neig FROM candidates WHERE cc >= 0 AND num_neig >= 0 AND e IS NOT NULL GROUP BY ALL)
        SELECT s, cc, e FROM b QUALIFY row_number() OVER (PARTITION BY s, cc ORDER BY num_neig DESC, e) <= 5""",
    "p5_found": f"WITH {_RECORDS}{_COPIES} SELECT keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p5_kept": f"WITH {_RECORDS}{_COPIES} SELECT keep_id, copies FROM g WHERE id = keep_id",
    "p6_found": f"WITH {_RECORDS}, {_RATIOS} SELECT v1, v2 FROM r WHERE ratio >= 4",
    "p6_ratios": f"WITH {_RECORDS}, {_RATIOS} SELECT v1, v2, n1, n2, n12, ratio FROM r WHERE ratio >= 4",
}
