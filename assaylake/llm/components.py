"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import discard, work_path


def _write(spark: SparkSession, links: DataFrame) -> tuple[DataFrame, str]:
    path = work_path(spark, "links")
    links.write.parquet(path)
    return spark.read.schema("u bigint, v bigint").parquet(path), path


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Of links(u, v): node, component (its smallest node) for every node of a link.

    Steps double what a node sees, so their number grows with the logarithm of the longest chain. Each is a minimum for
    each node, combined before the shuffle, and a join back, which Spark may split where one node has very many links.
    """
    both = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = _write(spark, both)
    mark = None
    while True:
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after, new_path = _write(spark, small)
        # A star is its own image: the links stay as they are once each node points to its component's smallest.
        new_mark = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(spark, path)
        if new_mark == mark:
            break
        now, path, mark = after, new_path, new_mark
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
