"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A key holding a large share of the rows is split across tasks at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "pressgauge", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A session on one machine that names none (a test) gets a temporary one. On a cluster that would lose
    what other machines write, so there it is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pressgauge-ckpt-")
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the cluster's shared checkpoint folder and read it back."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


READ_PARTITIONS = "pressgauge.read.partitions"


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A table, dealt anew to `partitions` tasks if a number is given or the session names one (READ_PARTITIONS).

    This is advice on layout and never changes answers: a file of fewer row groups than the cluster has cores keeps
    the rest of them idle. Tables of many row groups are better read as they are, without a shuffle.
    """
    partitions = partitions or int(spark.conf.get(READ_PARTITIONS, "0"))
    read = spark.read.parquet(path)
    return read.repartition(partitions) if partitions else read
