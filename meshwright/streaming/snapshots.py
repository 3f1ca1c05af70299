"""Fields over time: a folder of Parquet with a partition per time, written step by step and read as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.sources.files import write_mesh
from meshwright.sources.generate import Mesh


class SnapshotWriter:
    """Appends fields (i, v) at times; the mesh is written once (reuse) or with each time (update)."""

    def __init__(self, path: str, mesh: Mesh, reuse_mesh: bool = True):
        self.path, self.mesh, self.reuse = path, mesh, reuse_mesh
        if reuse_mesh:
            write_mesh(mesh, f"{path}/mesh")

    def write_cells(self, values: DataFrame, t: float, name: str = "cell_data") -> None:
        """Values (cell, v) at a time."""
        values.select("cell", "v", F.lit(float(t)).alias("t")).write.mode("append").partitionBy("t").parquet(f"{self.path}/{name}")

    def write(self, field: DataFrame, t: float) -> None:
        if not self.reuse:
            write_mesh(self.mesh, f"{self.path}/mesh_t={t!r}")
        field.select("i", "v", F.lit(float(t)).alias("t")).write.mode("append").partitionBy("t").parquet(f"{self.path}/field")


def read(spark: SparkSession, path: str, t: float | None = None) -> DataFrame:
    """(i, v, t); a given time reads its own partition only."""
    rows = spark.read.schema("i bigint, v double, t double").parquet(f"{path}/field")
    return rows if t is None else rows.where(F.col("t") == t)


def norms_over_time(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (t, squared_norm, linf), brought up to date as snapshots arrive."""
    rows = spark.readStream.schema("i bigint, v double, t double").parquet(f"{path}/field")
    return rows.groupBy("t").agg(F.sum(F.col("v") * F.col("v")).alias("squared_norm"), F.max(F.abs("v")).alias("linf"))
