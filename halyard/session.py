"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from halyard.errors import BackendError


def build(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "8g", app: str = "halyard") -> SparkSession:
    """A session with the settings that tests and benchmarks use."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``, read lazily so that pruning reaches the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    ``spark.checkpoint.dir`` of the session wins. Only where neither it nor the
    context names a folder a temporary one is made, in local mode alone (as in
    tests): executors of a cluster would not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise BackendError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="halyard-checkpoint-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint that survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
