"""Session helpers shared by every query: table loading and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "clauseloom", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer parts than there are cores, as with one small file. Large inputs have
    more parts than that and stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < parts < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder (spark.checkpoint.dir) is used as it is set; only on one machine, as in tests, a temporary
    folder stands in where nothing is set. On a cluster that is an error: executors don't share local folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "clauseloom-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from the written copy: computed once, and safe against the loss
    of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
