"""Distance indexes that can be stored: they are built once, saved as Parquet by s, and answer pairs of hyperedges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from . import bfs, hubs
from .coretree import CoreTree


@dataclass
class Index:
    """An index of one kind: named frames that all have a column s."""

    kind: str
    frames: dict[str, DataFrame]

    def save(self, path: str) -> None:
        for name, frame in self.frames.items():
            frame.write.mode("overwrite").partitionBy("s").parquet(f"{path}/{self.kind}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, kind: str, s: int | None = None) -> Index:
        """Read a stored index, only one s of it if given; other partitions aren't touched."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}, not {kind}")
        frames = {}
        for name, columns in KINDS[kind][1].items():
            frame = spark.read.schema(f"{columns}, s int").parquet(f"{path}/{kind}/{name}")
            frames[name] = frame if s is None else frame.where(F.col("s") == s)
        return Index(kind, frames)

    def distances(self, pairs: DataFrame) -> DataFrame:
        """(s, p, q, d) for ``pairs(s, p, q)``; exact, but for kind bits, whose d is an upper bound."""
        return KINDS[self.kind][2](self.frames, pairs)

    def size(self) -> int:
        """Rows of all frames."""
        return sum(x.count() for x in self.frames.values())


def _highway(adj: DataFrame, landmarks: DataFrame) -> dict[str, DataFrame]:
    labels, highway = hubs.highway_labels(adj, landmarks)
    rest = hubs.without_nodes(adj, landmarks.select("s", F.col("landmark").alias("e")))
    return {"labels": materialize(labels, "labels"), "highway": materialize(highway, "highway"), "rest": materialize(rest, "rest")}


def _tree(adj: DataFrame, width: int) -> dict[str, DataFrame]:
    built = CoreTree.build(adj, width)
    return {"labels": built.labels, "core": built.core}


#: Kinds of indexes: what builds them from (adj, landmarks, width), the names and columns of their frames, and what answers pairs.
_LABELS = "e bigint, hub bigint, d int"
KINDS = {
    "highway": (lambda adj, landmarks, width: _highway(adj, landmarks), {"labels": _LABELS, "highway": "hub bigint, hub2 bigint, h int", "rest": "e bigint, nb bigint"}, lambda f, pairs: hubs.around_highway(f["labels"], f["highway"], f["rest"], pairs)),
    "hubs": (lambda adj, landmarks, width: {"labels": materialize(hubs.hub_labels(adj), "labels")}, {"labels": _LABELS}, lambda f, pairs: hubs.hub_distances(pairs, f["labels"])),
    "bits": (lambda adj, landmarks, width: {"labels": materialize(hubs.bit_parallel_labels(adj), "labels")}, {"labels": "root bigint, e bigint, d int, nearer bigint, level bigint"}, lambda f, pairs: hubs.bit_parallel_bounds(pairs, f["labels"]).withColumnRenamed("ub", "d")),
    "coretree": (lambda adj, landmarks, width: _tree(adj, width), {"labels": "e bigint, a bigint, d int", "core": _LABELS}, lambda f, pairs: CoreTree(f["labels"], f["core"]).distances(pairs)),
}


def build(kind: str, adj: DataFrame, landmarks: DataFrame | None = None, width: int = 4) -> Index:
    """An index of ``adj(s, e, nb)``; kind highway needs ``landmarks(s, landmark)``, kind coretree a ``width``."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}, not {kind}")
    if kind == "highway" and landmarks is None:
        raise ValueError("a highway index needs landmarks")
    return Index(kind, KINDS[kind][0](bfs.tagged(adj), landmarks, width))


def answered(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(s, p, q, d) of all ``pairs``, -1 for those without a distance."""
    return pairs.select("s", "p", "q").distinct().join(found, ["s", "p", "q"], "left").select("s", "p", "q", F.coalesce("d", F.lit(-1)).alias("d"))


def distance_statistics(answers: DataFrame) -> DataFrame:
    """(s, n_queries, n_answered, least, most, mean) of ``answers(s, p, q, d)``; distances of -1 only count as queries."""
    known = F.when(F.col("d") >= 0, F.col("d"))
    return answers.groupBy("s").agg(
        F.count(F.lit(1)).alias("n_queries"), F.count(known).alias("n_answered"), F.min(known).alias("least"), F.max(known).alias("most"), F.avg(known).alias("mean")
    )
