"""Session settings and reliable materialisation."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "logmill", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # folders of frames no longer used are removed
        .getOrCreate()
    )


def any_session() -> SparkSession:
    """The active session, or one with the master that spark-submit or the environment configures, or else a local one."""
    active = SparkSession.getActiveSession()
    if active is None and ("PYSPARK_GATEWAY_PORT" in os.environ or "SPARK_REMOTE" in os.environ or "MASTER" in os.environ):
        return SparkSession.builder.appName("logmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return active or local_session()


def spread(scan: DataFrame) -> DataFrame:
    """A scan over all cores, for plans that compute much for each row.

    Only a scan of less than half as many partitions as there are cores is repartitioned, which few and small files give; all
    others stay as they are. scan must be no more than a scan, since its partitions are planned here.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder; elsewhere an unset folder is an error,
    since a machine-local path would not survive the loss of an executor.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "logmill-checkpoints")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from there.

    For a frame that several later plans read: each of them would compute it again otherwise.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
