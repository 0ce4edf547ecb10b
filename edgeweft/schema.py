"""Schemas of all frames and files."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _of(**kinds: type) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in kinds.items()])


INCIDENCE = _of(e=LongType, v=LongType)
OVERLAPS = _of(e1=LongType, e2=LongType, w=LongType)
COMPONENTS = _of(s=IntegerType, e=LongType, cc=LongType)
COMPONENT_SIZES = _of(s=IntegerType, cc=LongType, size=LongType, n_vertices=LongType)
LABELS = _of(s=IntegerType, landmark=LongType, e=LongType, dist=IntegerType)
DISTANCES = _of(s=IntegerType, src=LongType, e=LongType, dist=IntegerType)
PAIRS = _of(p=LongType, q=LongType)
S_PAIRS = _of(p=LongType, q=LongType, s=IntegerType)
ELEMENTS = _of(id=LongType)
EDGE_LABELS = _of(id=LongType, label=StringType)
PROFILES = _of(p=LongType, q=LongType, s=IntegerType, d=DoubleType, lb=DoubleType, ub=DoubleType, d_hat=DoubleType)
RUN_STATISTICS = _of(
    dataset=StringType, ts=StringType, offline=DoubleType, online=DoubleType, max_s=IntegerType, lb=IntegerType, l=IntegerType, num_landmarks=IntegerType,
    oracle_size=LongType, num_queries=IntegerType, ls=StringType, la=StringType, alpha=DoubleType, beta=DoubleType,
)
LANDMARKS = _of(landmark=LongType, s=IntegerType, cc=LongType, size=LongType)
CENTRALITIES = _of(id=LongType, real=DoubleType, approx=DoubleType)
REACHABLE = _of(src=LongType, dst=LongType, s=IntegerType, dist=DoubleType)
TOP_K = _of(q=LongType, approx=LongType, real=LongType, s=IntegerType)
EDGE_LIST = _of(u=LongType, v=LongType)
WEIGHTED_EDGE_LIST = _of(u=LongType, v=LongType, w=LongType)
