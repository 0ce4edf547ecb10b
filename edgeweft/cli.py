"""Settings as key=value, and the experiments over a hypergraph file.

    python -m edgeweft.cli experiment=profiles dataFile=graph.hg dataFolder=./datasets outputFolder=./out maxS=3
"""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass, fields, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import schema
from .operators import bfs, components, exact, indexes, landmarks, metrics, oracle, overlap, sampling
from .session import materialize
from .sources import files, sinks


@dataclass(frozen=True)
class Settings:
    dataFolder: str = "./datasets"
    outputFolder: str = "./out"
    dataFile: str = "graph.hg"
    queryFile: str | None = None
    numLandmarks: int = 100
    landmarkSelection: str = "degree"
    samplePerc: float = 0.4
    numQueries: int = 100
    landmarkAssignment: str = "ranking"
    lb: int = 4
    maxS: int = 2
    alpha: float = 0.5
    beta: float = 0.5
    seed: int = 4
    store: bool = False
    isApproximate: bool = False
    kind: str = "edge"
    k: int = 10
    width: int = 4
    experiment: str = "profiles"

    @property
    def name(self) -> str:
        return self.dataFile.rsplit(".", 1)[0]


def parse(args: list[str]) -> Settings:
    """Settings from key=value; keys are compared without case, unknown keys are an error."""
    kinds = {f.name.lower(): f for f in fields(Settings)}
    given = {}
    for arg in args:
        key, equals, value = arg.partition("=")
        field = kinds.get(key.strip().lower())
        if field is None or not equals:
            raise ValueError(f"not a setting: {arg}")
        kind = str(field.type).split(" |")[0]
        given[field.name] = {"int": int, "float": float, "str": str, "bool": lambda v: v.lower() in ("true", "1", "yes")}[kind](value)
    settings = Settings(**given)
    if settings.kind not in exact.KINDS:
        raise ValueError(f"kind must be one of {exact.KINDS}")
    return settings


class Run:
    """A hypergraph file with its oracle and queries."""

    def __init__(self, spark: SparkSession, settings: Settings) -> None:
        self.spark, self.settings = spark, settings
        self.inc = materialize(files.read_hypergraph(spark, f"{settings.dataFolder}/{settings.dataFile}").select("e", "v"), "inc")
        dimension = overlap.graph_counts(self.inc).first()["dimension"] or 1
        self.s_values = list(range(1, min(settings.maxS, dimension) + 1))
        self.offline = 0.0
        self._oracle: oracle.Oracle | None = None
        self._adj: DataFrame | None = None

    @property
    def adj(self) -> DataFrame:
        if self._adj is None:
            ov = materialize(overlap.overlaps(self.inc), "overlaps")
            linked = materialize(components.connect_levels(ov, self.s_values), "linked")
            self._adj = bfs.tagged(overlap.adjacency(ov, self.s_values), linked)
        return self._adj

    def build(self, **changed) -> oracle.Oracle:
        x = replace(self.settings, **changed)
        began = time.perf_counter()
        assignment = "ranking" if x.landmarkAssignment == "ranking" else "sampling"
        built = oracle.build(self.inc, self.s_values, x.numLandmarks, x.lb, x.alpha, x.beta, x.landmarkSelection, assignment, x.samplePerc, x.seed)
        self.offline = time.perf_counter() - began
        return built

    @property
    def oracle(self) -> oracle.Oracle:
        if self._oracle is None:
            x = self.settings
            path = f"{x.outputFolder}/oracle/{x.name}/S={self.s_values[-1]}/L={x.numLandmarks}/{x.landmarkSelection}-{x.landmarkAssignment}-{x.alpha}-{x.beta}-{x.samplePerc}-{x.seed}"
            if x.store:
                try:
                    self._oracle = oracle.Oracle.load(self.spark, path, x.lb)
                    return self._oracle
                except Exception as missing:  # Spark raises AnalysisException where nothing is stored
                    if "PATH_NOT_FOUND" not in str(missing):
                        raise
            self._oracle = self.build()
            if x.store:
                self._oracle.save(path)
        return self._oracle

    def pairs(self) -> DataFrame:
        """(s, ...) queries of the file, or a sample, by kind."""
        x = self.settings
        names = {"edge": ("p", "q"), "vertex": ("u", "v"), "both": ("v", "q")}[x.kind]
        if x.queryFile:
            found = files.read_pairs(self.spark, x.queryFile).toDF(*names)
        elif x.kind == "vertex":
            vertices = self.inc.select("v").distinct()
            found = sampling.sample_pairs(vertices, [], "v", F.lit(2 * x.numQueries), x.seed).toDF(*names)
        else:
            found = sampling.query_pairs(self.oracle.components, self.inc, x.numQueries, x.kind, x.seed).toDF(*names)
        if x.kind == "edge":
            return oracle.profile_queries(self.inc, found, self.s_values[-1])
        return exact.with_s(found, self.s_values)

    def elements(self) -> DataFrame:
        x = self.settings
        if x.queryFile:
            return files.read_elements(self.spark, x.queryFile).distinct()
        item = "e" if x.kind == "edge" else "v"
        return sampling.select_items(self.inc, item, x.numQueries, x.seed).select(F.col(item).alias("id"))

    def statistics(self, built: oracle.Oracle, online: float, queries: int) -> None:
        x, size = self.settings, built.size_of().first()
        row = (
            x.name, datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), self.offline, online, self.s_values[-1], x.lb, x.numLandmarks, int(size["n_landmarks"]), int(size["n_pairs"]), queries,
            x.landmarkSelection, x.landmarkAssignment, x.alpha, x.beta,
        )
        sinks.write_statistics(self.spark.createDataFrame([row], schema.RUN_STATISTICS), f"{x.outputFolder}/statistics")


def _as_pairs(kind: str, rows: DataFrame) -> DataFrame:
    names = {"edge": ("p", "q"), "vertex": ("u", "v"), "both": ("v", "q")}[kind]
    return rows.select(F.col(names[0]).alias("p"), F.col(names[1]).alias("q"), *[c for c in rows.columns if c not in names])


def _profiles(run: Run, asked: DataFrame, to: str) -> DataFrame:
    x = run.settings
    built = run.oracle
    began = time.perf_counter()
    approx = materialize(_as_pairs(x.kind, oracle.bounds(x.kind, built, run.inc, asked)), "approx")
    online = time.perf_counter() - began
    real = None if x.isApproximate else _as_pairs(x.kind, exact.profiles(x.kind, run.adj, run.inc, asked))
    run.statistics(built, online, approx.count())
    sinks.write_profiles(approx, real, f"{x.outputFolder}/{to}")
    return sinks.merged_profiles(approx, real)


def profiles(run: Run) -> DataFrame:
    """Distance profiles of pairs for all s, exact beside approximate."""
    return _profiles(run, materialize(run.pairs(), "asked"), "profiles")


def single_s(run: Run) -> DataFrame:
    """Distances for the s that each query names."""
    names = {"edge": ("p", "q"), "vertex": ("u", "v"), "both": ("v", "q")}[run.settings.kind]
    rows = files.read_s_pairs(run.spark, run.settings.queryFile) if run.settings.queryFile else None
    asked = run.pairs() if rows is None else rows.toDF(*names, "s").select("s", *names).distinct()
    return _profiles(run, materialize(asked, "asked"), "single")


def centrality(run: Run) -> DataFrame:
    """Closeness of elements at the largest s."""
    x, s = run.settings, run.s_values[-1]
    asked = materialize(run.elements(), "elements")
    if x.kind == "edge":
        approx = oracle.approx_closeness(run.oracle, asked.select(F.lit(s).alias("s"), F.col("id").alias("e"))).select(F.col("e").alias("id"), F.col("closeness").alias("value"))
        real = exact.edge_closeness(run.adj, asked.select(F.lit(s).alias("s"), F.col("id").alias("src"))).select(F.col("src").alias("id"), F.col("closeness").alias("value"))
    else:
        vertices = asked.select(F.col("id").alias("v"))
        approx = oracle.approx_vertex_closeness(run.oracle, run.inc, vertices, s).select(F.col("v").alias("id"), F.col("closeness").alias("value"))
        real = exact.vertex_closeness(run.adj, run.inc, vertices, s).select(F.col("v").alias("id"), F.col("closeness").alias("value"))
    real = None if x.isApproximate else real
    sinks.write_centralities(approx, real, f"{x.outputFolder}/centrality")
    return sinks.merged_centralities(approx, real)


def top_k(run: Run) -> DataFrame:
    """Nearest hyperedges, exact beside approximate, -1 where there are fewer than k."""
    x = run.settings
    queries = materialize(exact.with_s(run.elements().select(F.col("id").alias("q")), run.s_values), "queries")
    approx = materialize(oracle.nearest_landmarks(run.oracle, queries, x.k), "approx")
    real = approx.where("false") if x.isApproximate else materialize(exact.nearest(run.adj, queries, x.k), "real")
    sinks.write_top_k(approx, real, x.k, f"{x.outputFolder}/topk")
    return sinks.merged_top_k(approx, real, x.k)


def top_k_label(run: Run) -> DataFrame:
    """Nearest hyperedges with the same label."""
    x = run.settings
    labels = materialize(files.read_labels(run.spark, f"{x.dataFolder}/{x.name}_labels").select(F.col("id").alias("e"), "label").where("e is not null and label is not null"), "labels")
    chosen = sampling.labelled_members(labels, x.numQueries, x.seed).select(F.col("e").alias("q")).distinct()
    queries = materialize(exact.with_s(chosen, run.s_values), "queries")
    found = materialize(oracle.nearest_estimated(run.oracle, queries, x.k, labels), "approx")
    sinks.write_reachable(found.select(F.col("q").alias("src"), F.col("e").alias("dst"), "s", F.col("d_hat").alias("dist")), f"{x.outputFolder}/reachable")
    if not x.isApproximate:
        real = exact.nearest_with_label(run.adj, queries, labels, x.k)
        sinks.write_reachable(real.select(F.col("q").alias("src"), F.col("e").alias("dst"), "s", "dist"), f"{x.outputFolder}/reachable_exact")
    return found


def line_graph(run: Run) -> DataFrame:
    """Line graphs of all s, a folder each."""
    began = time.perf_counter()
    lines = materialize(overlap.line_graph(overlap.overlaps(run.inc), run.s_values[-1]), "lines")
    sinks.write_line_graph(lines, f"{run.settings.outputFolder}/{run.settings.name}.lg")
    row = [(run.settings.name, datetime.now(timezone.utc).isoformat(" ", "seconds"), time.perf_counter() - began, run.s_values[-1])]
    sinks.write_line_graph_statistics(run.spark.createDataFrame(row, "dataset string, ts string, seconds double, s int"), f"{run.settings.outputFolder}/line_graph_statistics")
    return lines


def compare_components(run: Run) -> DataFrame:
    """(method, s, n_components, seconds): all s at once, and each s from its own overlaps; the results must agree."""
    out = []
    began = time.perf_counter()
    together = materialize(components.s_components(run.inc, overlap.overlaps(run.inc), run.s_values), "together")
    out += [("all", s, together.where(F.col("s") == s).select("cc").distinct().count(), time.perf_counter() - began) for s in run.s_values]
    for s in run.s_values:
        began = time.perf_counter()
        one = materialize(components.s_components(run.inc, overlap.overlaps(run.inc, s), [s]), "one")
        out.append(("each", s, one.select("cc").distinct().count(), time.perf_counter() - began))
        if not one.exceptAll(together.where(F.col("s") == s)).isEmpty():
            raise AssertionError(f"components for s = {s} differ")
    return run.spark.createDataFrame(out, "method string, s int, n_components bigint, seconds double")


def _compared(run: Run, builders: dict) -> DataFrame:
    """(method, seconds, n_pairs, n_landmarks, mae, rmse) of oracles on the same queries."""
    run._oracle = run._oracle or run.build()
    asked = materialize(run.pairs(), "asked")
    real = materialize(_as_pairs(run.settings.kind, exact.profiles(run.settings.kind, run.adj, run.inc, asked)), "real")
    out = []
    for name, make in builders.items():
        began = time.perf_counter()
        built = make()
        size, seconds = built.size_of().first(), time.perf_counter() - began
        approx = _as_pairs(run.settings.kind, oracle.bounds(run.settings.kind, built, run.inc, asked))
        off = metrics.error_metrics(sinks.merged_profiles(approx, real), [], "d", "d_hat").first()
        out.append((name, seconds, int(size["n_pairs"]), int(size["n_landmarks"]), off["mae"], off["rmse"]))
    return run.spark.createDataFrame(out, "method string, seconds double, n_pairs bigint, n_landmarks bigint, mae double, rmse double")


def compare_baselines(run: Run) -> DataFrame:
    """The oracle against one that splits the budget by s, and one without components."""
    x = run.settings
    return _compared(run, {
        "baseline": lambda: oracle.build_baseline(run.inc, run.s_values, x.numLandmarks, x.seed),
        "split": lambda: oracle.build(run.inc, run.s_values, x.numLandmarks, x.lb, x.alpha, x.beta, x.landmarkSelection, "sampling", x.samplePerc, x.seed, split_budget=True),
        "joint": run.build,
    })


def compare_strategies(run: Run) -> DataFrame:
    return _compared(run, {name: (lambda n=name: run.build(landmarkSelection=n)) for name in landmarks.STRATEGIES})


def compare_importance(run: Run) -> DataFrame:
    """Weights of size and s: for sampling they leave the rest to the vertices."""
    grid = [(a, b) for a in (0.5, 0.8, 1.0) for b in (0.5, 0.8, 1.0)] if run.settings.landmarkAssignment == "ranking" else [(a, round(1 - 2 * a, 2)) for a in (0.2, 0.33, 0.4)]
    return _compared(run, {f"{a}-{b}": (lambda a=a, b=b: run.build(alpha=a, beta=b)) for a, b in grid})


def compare_indexes(run: Run) -> DataFrame:
    """(method, s, build_seconds, micros, size, n_queries, n_answered, least, most, mean): every index is built, stored, read back, and asked
    the same pairs; ``micros`` is the time of a query within its batch. Exact kinds must agree; a distance of -1 means none."""
    x = run.settings
    asked = materialize(run.pairs(), "asked")
    if x.kind != "edge":
        raise ValueError("indexes answer pairs of hyperedges")
    n = max(1, asked.count())
    real = materialize(indexes.answered(asked, exact.edge_profiles(run.adj, asked)), "real")
    out = None
    for kind in indexes.KINDS:
        began = time.perf_counter()
        built = indexes.build(kind, run.adj, run.oracle.landmarks.select("s", "landmark"), x.width)
        path = f"{x.outputFolder}/index/{x.name}/S={run.s_values[-1]}/width={x.width}"
        built.save(path)
        seconds = time.perf_counter() - began
        stored = indexes.Index.load(run.spark, path, kind)
        began = time.perf_counter()
        answers = materialize(indexes.answered(asked, stored.distances(asked)), "answers")
        micros = (time.perf_counter() - began) * 1e6 / n
        # nodes without any link are in no index: their distance to themselves is known anyway
        wrong = answers.join(real.withColumnRenamed("d", "real"), ["s", "p", "q"]).where("p <> q and (d <> real)" if kind != "bits" else "d >= 0 and d < real")
        if not wrong.isEmpty():
            raise AssertionError(f"distances of the index {kind} differ")
        rows = indexes.distance_statistics(answers).select(F.lit(kind).alias("method"), "s", F.lit(seconds).alias("build_seconds"), F.lit(micros).alias("micros"), F.lit(stored.size()).alias("size"), "n_queries", "n_answered", "least", "most", "mean")
        out = rows if out is None else out.unionByName(rows)
    return out


EXPERIMENTS = {
    "profiles": profiles, "single": single_s, "centrality": centrality, "topk": top_k, "topk-label": top_k_label, "line-graph": line_graph, "components": compare_components,
    "baselines": compare_baselines, "strategies": compare_strategies, "importance": compare_importance, "indexes": compare_indexes,
}


def run_experiment(spark: SparkSession, settings: Settings) -> DataFrame:
    if settings.experiment not in EXPERIMENTS:
        raise ValueError(f"experiment must be one of {sorted(EXPERIMENTS)}")
    return EXPERIMENTS[settings.experiment](Run(spark, settings))


def main() -> None:
    settings = parse(sys.argv[1:])
    spark = SparkSession.builder.appName(f"edgeweft {settings.experiment}").getOrCreate()
    run_experiment(spark, settings).show(20, False)


if __name__ == "__main__":
    main()
