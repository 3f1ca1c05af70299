"""Named tables with attributes in one folder: what other tools keep in a hierarchical file, as Parquet."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Store:
    """A folder of tables; mode r (read), w (begin anew) or a (add). Paths are any that Spark can reach."""

    spark: SparkSession
    path: str
    mode: str = "a"

    def __post_init__(self) -> None:
        if self.mode not in ("r", "w", "a"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.mode == "w":
            folder, files = self._at("")
            files.delete(folder, True)

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _writable(self) -> None:
        if self.mode == "r":
            raise PermissionError(f"{self.path} is open for reading only")

    def has_dataset(self, name: str) -> bool:
        where, files = self._at(name)
        return files.exists(where)

    def write_dataset(self, name: str, rows: DataFrame) -> None:
        """Rows in place of what the name had; all partitions write at once."""
        self._writable()
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def read_dataset(self, name: str, index: str | None = None, first: int | None = None, end: int | None = None, cast: dict[str, str] | None = None) -> DataFrame:
        """Rows, of an index range if given (a filter that reaches the scan), with columns cast."""
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        if index is not None:
            rows = rows.where((F.col(index) >= (first or 0)) & (F.col(index) < (end if end is not None else 2**63 - 1)))
        return rows.withColumns({c: F.col(c).cast(t) for c, t in (cast or {}).items()})

    def set_attribute(self, name: str, key: str, value: str | int | float | list) -> None:
        self._writable()
        row = [(key, json.dumps(value))]
        self.spark.createDataFrame(row, "key string, value string").coalesce(1).write.mode("append").json(f"{self.path}/{name}.attributes")

    def attributes(self, name: str) -> dict:
        """The last value written under each key."""
        if not self.has_dataset(f"{name}.attributes"):
            return {}
        rows = self.spark.read.schema("key string, value string").json(f"{self.path}/{name}.attributes").select("key", "value", F.col("_metadata.file_modification_time").alias("t"))
        return {r["key"]: json.loads(r["value"]) for r in rows.orderBy("t").collect()}
