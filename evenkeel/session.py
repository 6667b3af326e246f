"""Session defaults and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "evenkeel") -> SparkSession:
    """A local session; on a cluster the submitter's settings win and this is not needed."""
    return (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without spark.checkpoint.dir (a test) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="evenkeel-")
    return _own_folder[context.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and go on from there: one pass, and any executor may be lost."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/evenkeel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def on_all_cores(cached: DataFrame, rows: int) -> DataFrame:
    """Deal a cached table with fewer partitions than cores out once; a large table is left as it is."""
    cores = cached.sparkSession.sparkContext.defaultParallelism
    if rows < 10_000 or cached.rdd.getNumPartitions() >= cores:
        return cached
    return cached.repartition(cores)
