"""Matrices as vector tables, and the sample, study and probe tables around them: loading, scopes, catalogs, virtual unions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.functions import ids, vectors
from assaylake.operators import order


def resolve_column(df: DataFrame, candidates: Iterable[str], case_sensitive: bool = True) -> str:
    """The first candidate that is a column."""
    have = {c if case_sensitive else c.lower(): c for c in df.columns}
    for c in candidates:
        if (c if case_sensitive else c.lower()) in have:
            return have[c if case_sensitive else c.lower()]
    raise ValueError(f"none of {list(candidates)} is among {df.columns[:10]}")


def infer_orientation(rows: list[str], columns: list[str]) -> str:
    """Which axis holds samples, from the first 30 sample ids of each: array-file marks that are left count 3, short names with _ count 1."""
    marks = {}
    for axis, labels in (("samples_rows", rows), ("samples_columns", columns)):
        names = [ids.plain_sample_id(x) for x in labels[:30]]
        marks[axis] = sum(3 for x in names if re.search(r"\.cel|primeview", x, re.IGNORECASE)) + sum(1 for x in names if "_" in x and len(x) < 80)
    if marks["samples_rows"] != marks["samples_columns"]:
        return max(marks, key=marks.get)
    return "samples_rows" if len(rows) <= len(columns) else "samples_columns"


def vector_table(wide: DataFrame, label: str, orientation: str, order: str) -> DataFrame:
    """A wide table as sample_id, ord, values: labels normalized, later duplicates dropped, cells cast to float.

    With samples in columns the table is turned round: each cell a row, then a vector for each sample in row order.
    """
    features = [c for c in wide.columns if c not in (label, order)]
    if not features:
        raise ValueError("the matrix has no columns of values")
    if orientation == "samples_rows":
        rows = wide.select(ids.sample_id(F.col(label)).alias("sample_id"), F.col(order).cast("bigint").alias("ord"), F.array(*(F.col(f"`{c}`").cast("float") for c in features)).alias("values"))
    else:
        cells = wide.select(order, F.explode(F.array(*(F.struct(F.lit(c).alias("s"), F.lit(k).cast("bigint").alias("ord"), F.col(f"`{c}`").cast("float").alias("v")) for k, c in enumerate(features)))).alias("c"))
        rows = cells.groupBy("c.s", "c.ord").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("c.v").alias("v")))).alias("r"))
        rows = rows.select(ids.sample_id(F.col("s")).alias("sample_id"), "ord", F.transform("r", lambda r: r["v"]).alias("values"))
    first = W.partitionBy("sample_id").orderBy("ord")
    return rows.withColumn("_at", F.row_number().over(first)).filter("_at = 1").drop("_at")


def catalog(occurrences: DataFrame) -> DataFrame:
    """For each study: memberships, distinct samples, memberships of samples that other studies have too, canonical studies of its
    samples, if there is such a column, and its place in the natural order of accessions."""
    shared = occurrences.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))  # partial sums first, so one very common sample is no matter
    rows = occurrences.join(shared, "sample")
    canonical = [F.countDistinct("canonical").alias("canonical_studies")] if "canonical" in occurrences.columns else []
    out = rows.groupBy("study").agg(F.count(F.lit(1)).alias("memberships"), F.countDistinct("sample").alias("samples"), F.sum((F.col("n") > 1).cast("bigint")).alias("shared"), *canonical)
    return order.numbered(out, [ids.accession_number(F.col("study").cast("string")), F.col("study")])


def row_ranges(df: DataFrame, by: str, order: str) -> DataFrame:
    """The half-open range of rows of each group."""
    return df.groupBy(by).agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop"), F.count(F.lit(1)).alias("n"))


def gather_columns(df: DataFrame, column_map: list[int], values: str = "values") -> DataFrame:
    """Columns in the order of a map of 0-based positions; a position that is not there is an error."""
    at = F.array(*map(F.lit, column_map))
    ok = F.size(values) > max(column_map)
    return df.withColumn(values, F.when(ok, vectors.gather(values, at)).otherwise(F.raise_error(F.lit("a mapped column is missing")).cast("array<double>")))


def probe_map(have: list[str], want: list[str]) -> list[int]:
    """Where each wanted probe stands; identity and not position aligns matrices."""
    if len(set(have)) < len(have):
        raise ValueError("probe ids repeat")
    at = {p: k for k, p in enumerate(have)}
    if missing := [p for p in want if p not in at]:
        raise ValueError(f"probes are missing: {missing[:5]}")
    return [at[p] for p in want]


def union_source(primary: DataFrame, supplement: DataFrame) -> DataFrame:
    """Rows of both with fresh, gapless ord, the supplement after the primary; columns by name."""
    n = primary.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("n"))  # one row
    moved = supplement.crossJoin(F.broadcast(n)).withColumn("ord", F.col("ord") + F.col("n")).drop("n")
    return primary.unionByName(moved, allowMissingColumns=True)


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A left join that fails on a key without a match."""
    there = table.withColumn("_there", F.lit(True))
    out = df.join(there, key, "left")
    checked = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no {key} "), F.col(key).cast("string"))).cast(table.schema[key].dataType))
    return out.withColumn(key, checked).drop("_there")


def provenance(samples: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each sample with its studies in natural order."""
    each = occurrences.groupBy("sample").agg(F.array_sort(F.collect_set(F.struct(ids.accession_number(F.col("study").cast("string")).alias("k"), F.col("study").cast("string").alias("s")))).alias("r"))
    return samples.join(each, "sample", "left").select(samples["*"], F.array_join(F.transform("r", lambda r: r["s"]), ",").alias("studies"))


def preview(df: DataFrame, rows: int = 8, columns: int = 12) -> DataFrame:
    return df.orderBy("ord").limit(rows).withColumn("values", F.slice("values", 1, columns))


class ExpressionStore:
    """A folder of Parquet tables: `samples`, `occurrences`, `probes`, and `matrix` in partitions of `method`."""

    TABLES = ("samples", "occurrences", "probes", "matrix")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def opened(cls, spark: SparkSession, root: str, required: Iterable[str] = TABLES) -> ExpressionStore:
        """The store of a folder, refused if a table that is needed is not there, or has ids that are not text."""
        out = cls(spark, root)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(out.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if missing := [t for t in required if not files.exists(path(f"{out.root}/{t}"))]:
            raise FileNotFoundError(f"{out.root} lacks {missing}")
        for name in required:
            if odd := [c for c, t in out.table(name).dtypes if c in ("sample", "sample_id", "study", "probe_id") and t != "string"]:
                raise ValueError(f"ids of {name} are not text: {odd}")
        return out

    def table(self, name: str) -> DataFrame:
        if name not in self.TABLES:
            raise ValueError(f"no table {name}; there are {self.TABLES}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def view(self, method: str, study: str | None = None) -> DataFrame:
        """All samples of a method, or those of one study; the partition and the study are pushed down."""
        rows = self.table("matrix").filter(F.col("method") == method)
        if study is not None:
            rows = rows.join(self.table("occurrences").filter(F.col("study") == study).select(F.col("sample").alias("sample_id")), "sample_id", "left_semi")
        return rows

    def write(self, name: str, df: DataFrame) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy("method") if name == "matrix" else writer).parquet(f"{self.root}/{name}")
