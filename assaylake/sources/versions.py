"""Tables that are replaced as a whole: staged, verified, then named by a log; and sums over a stream that are committed with it.

A version is a folder that nothing refers to until an entry of the log does. The log has a file for each version, numbered without a
gap, with what the version was made from; the last one is the present table, those before stay readable. A driver that dies
before the entry leaves the table as it was. One driver writes at a time; the store is any that Hadoop's file systems open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from assaylake.operators import sums
from assaylake.operators.contracts import ContractError


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._store = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def entries(self) -> list[dict]:
        """What the log has, the oldest first."""
        if not self._store.exists(self._path("_log")):
            return []
        names = sorted(x.getPath().getName() for x in self._store.listStatus(self._path("_log")))
        out = []
        for name in (n for n in names if n.endswith(".json")):
            stream = self._store.open(self._path(f"_log/{name}"))
            try:
                out.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return out

    def last(self) -> dict | None:
        return next(reversed(self.entries()), None)

    def stage(self) -> str:
        return f"versions/{uuid.uuid4().hex}"

    def commit(self, folder: str, about: dict) -> dict:
        """Make a staged folder the present version. Until the entry is renamed to its number, nothing has happened."""
        entries = self.entries()
        entry = {"number": len(entries), "folder": folder, "about": about}
        at, part = self._path(f"_log/{len(entries):020d}.json"), self._path(f"_log/{uuid.uuid4().hex}.part")
        stream = self._store.create(part, False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True, default=str).encode()))
        stream.close()
        if self._store.exists(at) or not self._store.rename(part, at):
            raise ContractError(f"{self.root} was changed meanwhile")
        return entry

    def write(self, folder: str, name: str, df: DataFrame) -> DataFrame:
        """df as a table of a staged folder, read back, and an error unless rows and content are what was written."""
        path, seen = f"{self.root}/{folder}/{name}", Observation()
        marks = [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("mark")]
        df.observe(seen, *marks).write.parquet(path)
        back = self.table(folder, name, df.schema)
        if back.agg(*marks).first().asDict() != seen.get:
            raise ContractError(f"{path} is not what was written")
        return back

    def table(self, folder: str, name: str, schema: StructType | str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/{folder}/{name}")

    def replace(self, df: DataFrame, about: dict, checks: Iterable[Callable[[DataFrame], None]] = ()) -> dict:
        """Stage df, verify it, run the checks on what is read back, then switch to it. What was there stays as an older version."""
        folder = self.stage()
        back = self.write(folder, "data", df)
        for check in checks:
            check(back)
        return self.commit(folder, about)

    def read(self, wanted: dict | None = None, number: int | None = None) -> DataFrame:
        """The present version, or an older one by its number; it must have been made from what is wanted."""
        entries = self.entries()
        if not entries:
            raise ContractError(f"{self.root} has no version")
        entry = entries[-1 if number is None else number]
        if wrong := {k: entry["about"].get(k) for k, v in (wanted or {}).items() if entry["about"].get(k) != v}:
            raise ContractError(f"{self.root} was made from {wrong}, not from {({k: wanted[k] for k in wrong})}")
        return self.table(entry["folder"], "data")


# --- sums over units that come as a stream


TOTALS = StructType([StructField("n", LongType()), StructField("sums", ArrayType(DoubleType()))])


class Accumulation:
    """Sums of vectors over units, each counted once, that survive a restart.

    A batch adds the units that no version has, and commits its sums, the units it added, the batch's number and the contract in one
    entry. A batch that is repeated after a failure is either in the log, and then left out, or not, and then added to what was there
    before. A version holds its own units alone, so that a commit is as large as its batch.
    """

    def __init__(self, spark: SparkSession, root: str, contract: dict):
        self.versions, self.contract = Versions(spark, root), json.loads(json.dumps(contract, sort_keys=True))
        self._checked()

    def _checked(self) -> dict | None:
        last = self.versions.last()
        if last is not None and last["about"]["contract"] != self.contract:
            raise ContractError(f"{self.versions.root} was made under another contract")
        return last

    def done(self) -> DataFrame | None:
        """The units that are in the sums."""
        folders = [f"{self.versions.root}/{e['folder']}/done" for e in self.versions.entries()]
        return self.versions.spark.read.parquet(*folders) if folders else None

    def totals(self) -> dict:
        last = self._checked()
        return {"n": 0, "sums": None} if last is None else self.versions.table(last["folder"], "totals", TOTALS).first().asDict()

    def add(self, batch: DataFrame, number: int) -> None:
        """batch(unit, values); of rows of a unit the one with the smallest hash of its values counts."""
        last = self._checked()
        if last is not None and last["about"]["batch"] >= number:
            return
        fresh = batch.groupBy("unit").agg(F.min(F.struct(F.xxhash64("values").alias("h"), F.col("values"))).alias("v")).select("unit", "v.values")
        done = self.done()
        if done is not None:
            fresh = fresh.join(done, "unit", "left_anti")
        folder = self.versions.stage()
        added = self.versions.write(folder, "units", fresh)  # what is summed and what is done are read from one table
        self.versions.write(folder, "done", added.select("unit"))
        found = sums.folded(added.select("values"), [], _summed).first()
        before = self.totals()
        n, total = before["n"], before["sums"]
        if found is not None and found["sums"]:
            n += added.count()
            total = found["sums"] if total is None else [a + b for a, b in zip(total, found["sums"], strict=True)]
        self.versions.write(folder, "totals", self.versions.spark.createDataFrame([(n, total)], TOTALS))
        self.versions.commit(folder, {"batch": number, "contract": self.contract})

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Add what is there of a stream of unit and values, batch by batch."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        if batch.num_rows:
            for key, _, x in sums.blocks(batch, 0, 0):
                yield key, x.sum(axis=0)
