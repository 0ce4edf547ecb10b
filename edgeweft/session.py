"""Session settings and tables that cut lineage.

Iterative operators write each round to a Parquet table in the shared folder that the
session names in ``spark.checkpoint.dir`` and read it back. The next round then starts
from files that every executor can reach, so a lost executor costs only the tasks that
were running on it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_CLEARED_AT_EXIT: set[str] = set()


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("edgeweft")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage-cutting tables.

    It is what ``spark.checkpoint.dir`` says. Where that is unset, a temporary folder is
    made, which is only allowed on a local master: on a cluster the executors would not
    see it.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        made = tempfile.mkdtemp(prefix="edgeweft-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _LOCAL_DIRS[app] = "file://" + made
    return _LOCAL_DIRS[app]


def _path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    own = f"{shared_dir(spark)}/{app}"
    if app not in _CLEARED_AT_EXIT:
        _CLEARED_AT_EXIT.add(app)
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        atexit.register(_delete, at.getFileSystem(spark._jsc.hadoopConfiguration()), at)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _delete(fs, at) -> None:
    """Delete the tables of a session in the shared folder when its driver ends."""
    try:
        fs.delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        return


def folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared folder, for files that aren't a frame of :func:`materialize`."""
    return _path(spark, label)


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once, wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    if not package.is_dir():  # the package is in a zip that was shipped already
        return
    made = tempfile.mkdtemp(prefix="edgeweft-package-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{made}/edgeweft", "zip", package.parent, package.name))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the files."""
    spark = df.sparkSession
    ship(spark)
    path = _path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._edgeweft_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_edgeweft_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def state(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, size and time of every file below ``paths``; what doesn't exist has none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            for x in fs.listStatus(at):
                out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return tuple(sorted(out))


def shuffle_width(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Number of partitions so that none gets more than about ``rows_per_task`` rows."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // rows_per_task))
