"""Sessions, and the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir; a temporary one only where all runs in one process."""
    global _local
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        if _local is None:
            _local = tempfile.mkdtemp(prefix="assaylake-")
            atexit.register(shutil.rmtree, _local, True)
        root = f"file://{_local}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor only costs a reread."""
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def session(master: str = "local[*]", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster the submit command sets master and shared folder."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return builder.getOrCreate()
