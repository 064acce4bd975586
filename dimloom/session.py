"""Session settings and the shared folder that long jobs cut their lineage into."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that hold from a laptop to a large cluster. Partition counts and
# memory belong to the cluster, so they are not set here.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join key even where that costs a shuffle later on.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows already dealt out by one key serve a join on that key and more.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Before a query runs, sizes are guesses from compressed files: broadcast only what is
    # small beyond doubt, and leave the rest to the sizes measured at run time.
    "spark.sql.autoBroadcastJoinThreshold": "2m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16m",
}


def tune(spark: SparkSession) -> None:
    """Apply the settings above where the session's owner has set nothing."""
    for key, value in SCALE_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def local_session(app: str, cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    partitions = cores if isinstance(cores, int) else (os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tune(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder. A cluster session
    without one is an error: executors cannot share a machine-local folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="dimloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


# Scratch paths given out by this process.
_given: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder."""
    _given.append(f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def release(spark: SparkSession) -> None:
    """Remove all scratch tables of this process: for when the results built on them have been written."""
    from dimloom.sources.files import Files

    while _given:
        path = _given.pop()
        Files(spark, path).remove(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows once below the shared folder and read them from there.

    A lost executor then re-reads files instead of recomputing, and every later read sees
    the same rows. A columnar table lets later reads skip columns, which a checkpoint's
    row files would not.
    """
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
