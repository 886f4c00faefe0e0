"""Shared pieces: the shared work folder, written intermediate tables, and ordering without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.session import work_folder as work_path

#: White space between words, as the contracts give it.
SPACE = "[\\x20\\x09-\\x0D]+"

def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor only costs a reread."""
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Work:
    """Tables of one run in the shared folder, to be deleted together after their last reader."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(work_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def discard(self) -> None:
        while self.paths:
            discard(self.spark, self.paths.pop())


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """The row as one column, `row`, so that its columns, whatever their names, meet none of an operator's own."""
    return F.struct(*(F.col("`" + n.replace("`", "``") + "`") for n in df.columns)).alias("row")


def words(text: Column) -> Column:
    """The words of a text; an array without empty strings."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def unit_bits(key: Column, seed: str) -> Column:
    """52 pseudo-random bits of a key as a long; the same on every run and engine (md5)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")


def ranged(spark: SparkSession, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df written in range partitions of the order, with the partition's number as `pid`.

    Rows with equal keys share a partition. The table is small for each row (ids and sizes), so a partition fits a task.
    """
    return written(spark, df.repartitionByRange(partitions(spark), *order).withColumn("pid", F.spark_partition_id()), name)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], before: bool) -> DataFrame:
    """Add sums over all rows up to each row (before: without it), in the order that df was ranged by.

    One window for each range partition, and the partitions' totals, one row for each, joined back.
    """
    inside = W.partitionBy("pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    df = df.withColumns({f"_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    total = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    parts = df.groupBy(F.col("pid").alias("_pid")).agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    parts = parts.select("_pid", *(F.coalesce(F.sum(f"__{k}").over(total), F.lit(0)).alias(f"__{k}") for k in sums))
    out = df.join(F.broadcast(parts), df["pid"] == parts["_pid"])  # a row for each partition
    return out.withColumns({k: F.col(f"_{k}") + F.col(f"__{k}") for k in sums}).drop("_pid", *(f"_{k}" for k in sums), *(f"__{k}" for k in sums))
