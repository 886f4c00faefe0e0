"""The library's tables made from the driver's: vectors, occurrences, metrics, histories, patients and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as samples: study is the label, 8 of 10 studies train."""
    split = F.when(F.pmod("label", F.lit(10)) < 8, "train").when(F.pmod("label", F.lit(10)) == 8, "validation").otherwise("test")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("vec_id").alias("ord"), F.col("label").cast("bigint").alias("study"), split.alias("split"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def raw_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d).withColumn("values", F.transform("values", lambda x: F.pow(F.lit(2.0), x)))


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """parts as samples of suppliers as studies."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("sample"), F.col("l_suppkey").alias("study")).distinct()


def predictions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("model_id"), F.col("l_linenumber").cast("bigint").alias("repeat"), F.pmod("l_orderkey", F.lit(5)).alias("fold"),
        F.col("l_suppkey").alias("donor"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5 * (1 - F.col("l_discount"))).alias("p"),
    )


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("model_id", "repeat", "fold").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2))).alias("rmse"))


def history(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(order).cast("bigint").alias("epoch"), F.col("value").alias("score"), F.col("event_type").alias("method"))


def patients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("patient"), F.floor(F.col("c_custkey") / 2).alias("donor"), F.col("c_acctbal").alias("kdri"), F.col("c_mktsegment").alias("stratum"), "c_name")


def outcomes_long(spark: SparkSession, d: str) -> DataFrame:
    """Averages of each customer's orders; a priority is a time, and any behind the third is the last."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("o_orderpriority")), F.lit(0).cast("bigint")) - 1, F.lit(len(PRIORITIES)))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("patient"), order.cast("int").alias("time_ord"), "o_totalprice")
    return rows.groupBy("patient", "time_ord").agg(F.avg("o_totalprice").alias("egfr"))


def outcomes_wide(spark: SparkSession, d: str) -> DataFrame:
    each = [F.max(F.when(F.col("time_ord") == k, F.col("egfr"))).alias(c) for k, c in enumerate(("egfr_7d", "egfr_3m", "egfr_6m", "egfr_12m"))]
    return patients(spark, d).select("patient", "donor").join(outcomes_long(spark, d).groupBy("patient").agg(*each), "patient", "left")


#: The same for SQL: names of common table expressions.
SQL = {
    "cells": "SELECT vec_id AS sample_id, label::BIGINT AS study, CASE WHEN label % 10 < 8 THEN 'train' WHEN label % 10 = 8 THEN 'validation' ELSE 'test' END AS split, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings",
    "raw": "SELECT * REPLACE (pow(2.0, value) AS value) FROM cells",
    "occ": "SELECT DISTINCT l_partkey AS sample, l_suppkey AS study FROM lineitem",
    "pred": "SELECT l_returnflag || l_linestatus AS model_id, l_linenumber::BIGINT AS repeat, l_orderkey % 5 AS fold, l_suppkey AS donor, l_extendedprice / 1000 AS y, l_quantity * 1.5 * (1 - l_discount) AS p FROM lineitem",
    "met": "SELECT model_id, repeat, fold, sqrt(avg((y - p) * (y - p))) AS rmse FROM pred GROUP BY ALL",
    "hist": "SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS score, event_type AS method FROM events",
    "pat": "SELECT c_custkey AS patient, c_custkey // 2 AS donor, c_acctbal AS kdri, c_mktsegment AS stratum, c_name FROM customer",
    "long": "SELECT o_custkey AS patient, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END::INT AS time_ord, avg(o_totalprice) AS egfr FROM orders GROUP BY ALL",
    "wide": "SELECT p.patient, p.donor, max(egfr) FILTER (time_ord = 0) AS egfr_7d, max(egfr) FILTER (time_ord = 1) AS egfr_3m, max(egfr) FILTER (time_ord = 2) AS egfr_6m, max(egfr) FILTER (time_ord = 3) AS egfr_12m FROM pat p LEFT JOIN long l ON l.patient = p.patient GROUP BY p.patient, p.donor",
}
NEEDS = {"raw": ["cells"], "met": ["pred"], "wide": ["pat", "long"]}


def sql(body: str, *names: str) -> str:
    """The body after the expressions it names, with what they need before them."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "WITH " + "RECURSIVE " * ("RECURSIVE" in body) + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + body.replace("RECURSIVE", "")
