"""Intermediate tables that are used more than once, written to a folder that all executors share."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Staging:
    """Tables written below ``root``; ``remove`` deletes them when nothing that reads them is needed any more."""

    spark: SparkSession
    root: str
    written: list[str] = field(default_factory=list)

    def stage(self, table: DataFrame) -> DataFrame:
        """Writes the table once and reads it back, so later steps neither repeat nor depend on the work before."""
        target = f"{self.root}/scanloom/{uuid.uuid4().hex}"
        table.write.parquet(target)
        self.written.append(target)
        return self.spark.read.schema(table.schema).parquet(target)

    def remove(self) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        while self.written:
            path = hadoop.Path(self.written.pop())
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# Folder of local sessions that name none, by the choice of whoever runs them.
_local: list[str] = []


def use_local_folder(folder: str) -> None:
    """Where sessions on one machine that name no folder stage; others need one that is shared."""
    _local[:] = [folder]


def staging(spark: SparkSession, folder: str | None = None) -> Staging:
    """Staging below ``folder``, or below the one in ``spark.checkpoint.dir``. Without either there is none to use."""
    root = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not root and _local and spark.sparkContext.master.startswith("local["):
        root = _local[0]
    if not root:
        raise ValueError("name a folder that all executors share, as an argument or in spark.checkpoint.dir")
    return Staging(spark, root.rstrip("/"))
