"""Where intermediate tables go, so that lost executors cost no more than the step that lost them."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; where that is unset, a folder of our own in local mode, an error on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="meshwright-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint from now on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and checkpoints that no DataFrame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def store(df: DataFrame) -> str:
    """Write an intermediate table, compressed, to the shared checkpoint folder; drop() removes it."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with a number __row of each, written once to the shared folder and read from there.

    A number taken anew at each scan depends on how the scan splits its files,
    which changes with the executors at hand. Names that begin with two
    underscores are the operators' own; a table that has __row is refused.
    """
    if "__row" in df.columns:
        raise ValueError("rename the column __row")
    return df.sparkSession.read.parquet(store(df.withColumn("__row", F.monotonically_increasing_id())))
