"""Pairs and components of sample hypergraphs for s = 1 to 5. $SAMPLE_GRAPHS names a folder of *.hg files, which aren't part of the repository."""

import os
from pathlib import Path

import pytest

from edgeweft.operators import components, overlap
from edgeweft.session import materialize
from edgeweft.sources import files
from pyspark.sql import functions as F

# Fixed values by (hyperedges, vertices). For each s: pairs that overlap in s, hyperedges of that size, components, the largest, components of more than four.
KNOWN = {
    (2157, 2340): ["47203/2157/181/1035/83", "942/1597/766/27/48", "271/985/741/6/1", "62/499/438/6/1", "12/219/207/2/0"],
    (1088, 1161): ["35738/1088/183/816/8", "31686/1047/250/688/7", "29158/750/182/483/5", "20877/629/182/366/5", "11517/504/129/315/4"],
    (2461, 2324): ["225692/2461/205/2238/2", "91086/1686/382/1238/8", "45549/1220/320/821/5", "24115/955/281/616/4", "13619/766/255/472/2"],
    (9906, 5311): ["2402924/9906/1976/7732/14", "666034/6264/712/5430/8", "227858/5134/757/3964/10", "92090/4389/848/3248/12", "45506/3854/1018/2597/13"],
    (9716, 10112): ["104047/9716/5050/4441/16", "57702/4956/333/4404/16", "40559/3743/884/2021/21", "31606/2974/741/1413/22", "25789/2507/630/659/32"],
    (7818, 327): ["593188/7818/1/7818/1", "22593/7818/3063/4640/7", "888/2320/1723/48/45", "19/229/210/5/1", "0/7/7/1/0"],
    (12704, 242): ["2238167/12704/1/12704/1", "64225/12704/3788/8887/1", "1203/4956/4077/57/66", "11/356/345/5/2", "0/9/9/1/0"],
    (38333, 1083): ["4729505/38333/1/38333/1", "200054/13987/1198/12739/2", "44091/8015/2650/5343/1", "16894/5386/2595/2786/1", "8478/3908/2253/1654/1"],
}
GRAPHS = sorted(Path(os.environ["SAMPLE_GRAPHS"]).glob("*.hg")) if "SAMPLE_GRAPHS" in os.environ else []


@pytest.mark.skipif(not GRAPHS, reason="no sample hypergraphs")
@pytest.mark.parametrize("path", GRAPHS, ids=lambda p: p.stem)
def test_known_counts(spark, path):
    inc = materialize(files.read_hypergraph(spark, str(path)).select("e", "v"), "inc")
    counts = overlap.graph_counts(inc).first()
    want = KNOWN[counts["n_edges"], counts["n_vertices"]]
    ov = materialize(overlap.overlaps(inc), "ov")
    # the three ways to find overlaps of two or more agree
    two = ov.where("w >= 2").agg(F.count(F.lit(1)), F.sum("w"), F.sum(F.xxhash64("e1", "e2", "w").cast("decimal(38,0)"))).first()
    for method in ("pairs", "prefix"):
        assert overlap.overlaps(inc, 2, method=method).agg(F.count(F.lit(1)), F.sum("w"), F.sum(F.xxhash64("e1", "e2", "w").cast("decimal(38,0)"))).first() == two
    values = [1, 2, 3, 4, 5]
    pairs = {r.s: r.n for r in overlap.line_graph(ov, 5).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = components.component_sizes(components.s_components(inc, ov, values))
    found = {r.s: r for r in sizes.groupBy("s").agg(F.sum("size").alias("m"), F.count(F.lit(1)).alias("n"), F.max("size").alias("top"), F.sum((F.col("size") > 4).cast("int")).alias("large")).collect()}
    assert [f"{pairs.get(s, 0)}/{found[s].m}/{found[s].n}/{found[s].top}/{found[s].large}" for s in values] == want
