"""Reading labelled matrices, clinical tables, metadata text and project layouts; writing verified exports."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

REQUEST_FIELDS = {"method", "split_seed", "train_fraction", "validation_fraction", "training", "split_file"}


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: csv, tsv or txt, parquet or pq. All columns of text files are read as strings and cast where used."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv", "txt"):
        return spark.read.csv(path, header=True, sep="," if suffix == "csv" else "\t")
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    if suffix in ("xlsx", "xls"):
        import pandas as pd  # needs an Excel engine, on the driver: sheets are small

        return spark.createDataFrame(pd.read_excel(path))
    raise ValueError(f"no reader for .{suffix}")


def typed(df: DataFrame, schema: T.StructType, strict: bool) -> DataFrame:
    """Casts by a schema: strict raises on what does not parse, else it becomes null."""
    return df.select(*((F.col(f.name).cast(f.dataType) if strict else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema.fields))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*((F.nanvl(c, F.lit(None)) if t in ("double", "float") else F.col(c)).alias(c) for c, t in df.dtypes))


def inspect(df: DataFrame, id_column: str, most: int = 12) -> tuple[dict, DataFrame]:
    """Counts, and a read of evenly spread sample columns alone; the scan is pruned to them."""
    samples = [c for c in df.columns if c != id_column]
    step = (len(samples) - 1) / max(1, most - 1)
    chosen = samples if len(samples) <= most else list(dict.fromkeys(samples[int(k * step)] if k < most - 1 else samples[-1] for k in range(most)))
    return {"columns": len(df.columns), "samples": len(samples), "rows": df.count()}, df.select(id_column, *chosen)


def soft_samples(lines: DataFrame) -> DataFrame:
    """lines(line_no, line) of one SOFT text to a row for each ^SAMPLE block: sample, title, platform, source."""
    start = F.when(F.col("line").startswith("^SAMPLE"), 1).otherwise(0)
    rows = lines.withColumn("block", F.sum(start).over(W.orderBy("line_no"))).filter("block > 0")  # one metadata file
    text = F.trim(F.regexp_extract("line", r"=\s*(.*)$", 1))

    def value(field: str):
        return F.first(F.when(F.col("line").startswith(field), text), ignorenulls=True)

    return rows.groupBy("block").agg(value("^SAMPLE").alias("sample"), value("!Sample_title").alias("title"), value("!Sample_platform_id").alias("platform"), value("!Sample_source_name").alias("source")).drop("block")


def scan_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, size and time of files that fit, in order of their lower-case names; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime").orderBy(F.lower(F.element_at(F.split("path", "/"), -1)))


def scan_records(spark: SparkSession, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON records of run folders: the readable ones, and the names of those that are not."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", "true").option("multiLine", "true").json(root).withColumn("path", F.input_file_name())
    return rows.filter("_broken IS NULL").drop("_broken"), rows.filter("_broken IS NOT NULL").select("path")


def resolve_data_directory(explicit: str | None, variable: str, recognizable: tuple[str, ...], environ: Mapping[str, str] = os.environ, here: str = ".") -> str:
    """The folder given, else the environment's, else ./data if it has what is recognized, else ./data all the same."""
    if explicit:
        return os.path.abspath(explicit)
    if environ.get(variable):
        return os.path.abspath(environ[variable])
    local = os.path.join(here, "data")
    return os.path.abspath(local if any(os.path.exists(os.path.join(local, x)) for x in recognizable) or not os.path.isdir(here) else local)


def load_request(text: str, fields: set[str] = REQUEST_FIELDS) -> dict:
    request = json.loads(text)
    if unknown := set(request) - fields:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return request


def write_verified(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Write, read back, and fail unless both agree in rows and content."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    mark = lambda x: x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*x.columns))).first()
    if mark(df) != mark(back):
        raise ValueError(f"{path} is not what was written")
    return back


def export(df: DataFrame, root: str, formats: tuple[str, ...] = ("parquet", "csv")) -> None:
    """One folder for each format; arrays become JSON text where the format has no arrays."""
    for kind in formats:
        flat = df if kind != "csv" else df.select(*((F.to_json(c) if t.startswith("array") else F.col(c)).alias(c) for c, t in df.dtypes))
        (flat.write.mode("overwrite").option("header", True) if kind == "csv" else flat.write.mode("overwrite")).format(kind).save(f"{root}/{kind}")


def rewrite_manifest(manifest: DataFrame, name: str, description: str) -> DataFrame:
    return manifest.withColumn("description", F.when(F.col("matrix_name") == name, description).otherwise(F.col("description")))
