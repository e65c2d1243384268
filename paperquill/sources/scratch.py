"""Tables of one run, in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where the session names no folder: only for a session whose executors are the driver's own process.
UNSET = "file:///tmp/paperquill-tables"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below spark.checkpoint.dir, which driver and executors share.

    Without that setting, a local session gets a folder of this machine, and any other an error: executors would each write
    to their own disk.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{(root or UNSET).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saver(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table and reads it again, which cuts its lineage. What it wrote stays until delete_saved()."""
    root = scratch_folder(spark, name)
    n = iter(range(1 << 30))

    def save(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(n):04d}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    save.root = root
    return save


def delete_saved(spark: SparkSession, save: Callable) -> None:
    """Remove the tables of a saver, when nothing reads them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(save.root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
