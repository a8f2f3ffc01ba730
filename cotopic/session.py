"""Session helpers: a local session for tests and benches, and the shared scratch folder.

Library operators never create a session; they work on the one their input DataFrames
belong to.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "cotopic",
                  extra: dict | None = None) -> SparkSession:
    """A local session configured like the tests and the bench expect (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("COTOPIC_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    The setting is read from the session and never replaced. Only a local-mode session
    without one (tests) gets a fresh temporary folder; a cluster session without one is an
    error, because a machine-local folder is not shared by the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cotopic-ckpt-"))  # one machine: a local folder is shared
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster (e.g. on HDFS or S3)")
    return sc.getCheckpointDir()


_SCOPE: ContextVar["ScratchScope | None"] = ContextVar("scratch scope", default=None)


class ScratchScope:
    """The scratch tables written inside a ``scratch_scope``."""

    def __init__(self, outer: "ScratchScope | None"):
        self.outer, self.paths = outer, []

    def own(self, path: str) -> None:
        self.paths.append(path)

    def keep(self, prefix: str) -> None:
        """Leave the tables of this name to the scope around this one (to nobody, where there is none)."""
        kept = [p for p in self.paths if p.rsplit("/", 1)[-1].startswith(f"{prefix}-")]
        self.paths = [p for p in self.paths if p not in kept]
        if self.outer is not None:
            self.outer.paths += kept


@contextmanager
def scratch_scope(spark: SparkSession):
    """Drop every scratch table written inside the block when it ends, also after a failure.

    Results that read scratch tables must be used, or written elsewhere, inside the block. Tables are dropped through Spark's file
    system, so any shared folder will do.
    """
    scope = ScratchScope(_SCOPE.get())
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        drop_paths(spark, scope.paths)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(conf).delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder for a table written by a job; the innermost ``scratch_scope`` owns it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPE.get() is not None:
        _SCOPE.get().own(path)
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the lineage, and a lost
    executor costs a re-read, never a recomputation of everything before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Keep ``df`` materialized for several actions inside the block, released after it.

    Project the needed columns before persisting: a persisted plan keeps every column it
    has. Cached blocks lost with an executor are recomputed from lineage.
    """
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
