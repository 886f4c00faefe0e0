"""A Python data source for .npy matrices: one partition for each block of rows, read from its byte range or written to it.

Writing needs the numbers of rows and columns, as options, and a column `ord` of places 0, 1, ...: where a row goes follows from its place.
The driver lays out a file of the final size under another name, tasks write their rows into it, and it is renamed when all rows were
written. A task that is run again writes the same bytes to the same places. Rows of another width, or with values that are not finite,
fail the write, and a failed write leaves nothing. As bytes are written in place, the file must be on a file system that all executors mount.
A file that is there with the same size and header is kept as it is with the option reuse=true.
"""

from __future__ import annotations

import ast
import io
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK_BYTES = 16 << 20


def header(source) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, whether in column order, and where the data begins."""
    magic = source.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    n, size = (2, "<H") if magic[6] == 1 else (4, "<I")
    length = struct.unpack(size, source.read(n))[0]
    fields = ast.literal_eval(source.read(length).decode())
    return fields["shape"], np.dtype(fields["descr"]), fields["fortran_order"], 8 + n + length


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _open(self):
        store, at = fs.FileSystem.from_uri(self.path)
        return store.open_input_file(at)

    def partitions(self) -> list[Rows]:
        with self._open() as f:
            shape, kind, column_order, _ = header(f)
        if len(shape) != 2 or column_order:
            raise ValueError(f"a matrix in row order is needed; this has shape {shape}, column order {column_order}")
        step = max(1, BLOCK_BYTES // max(1, shape[1] * kind.itemsize))
        return [Rows(a, min(a + step, shape[0])) for a in range(0, shape[0], step)]

    def read(self, part: Rows | None):
        if part is None:
            return
        with self._open() as f:
            shape, kind, _, start = header(f)
            width = shape[1] * kind.itemsize
            f.seek(start + part.first * width)
            block = np.frombuffer(f.read((part.last - part.first) * width), kind).reshape(-1, shape[1]).astype(np.float32)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * shape[1], pa.int32()), pa.array(block.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.last), pa.int64()), values], names=["ord", "values"])


@dataclass
class Written(WriterCommitMessage):
    rows: int
    places: int  # their sum


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        store, self.path = fs.FileSystem.from_uri(options["path"])
        if not isinstance(store, fs.LocalFileSystem):
            raise ValueError("rows are written in place, which only a mounted file system can do")
        self.shape, self.kind = (int(options["rows"]), int(options["columns"])), np.dtype(options.get("dtype", "<f4"))
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(self.kind), "fortran_order": False, "shape": self.shape})
        self.head, self.width = out.getvalue(), self.shape[1] * self.kind.itemsize
        self.size = len(self.head) + self.shape[0] * self.width
        self.kept = options.get("reuse", "false").lower() == "true" and self._same()
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        if not self.kept:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            with open(self.part, "wb") as f:
                f.write(self.head)
                f.truncate(self.size)

    def _same(self) -> bool:
        if not os.path.isfile(self.path) or os.path.getsize(self.path) != self.size:
            return False
        with open(self.path, "rb") as f:
            return f.read(len(self.head)) == self.head

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        rows = places = 0
        if self.kept:
            return Written(0, 0)
        with open(self.part, "r+b") as f:
            for batch in iterator:
                at = batch.column(batch.schema.get_field_index("ord")).to_numpy()
                values = batch.column(batch.schema.get_field_index("values"))
                if values.null_count or (np.diff(values.offsets.to_numpy()) != self.shape[1]).any():
                    raise ValueError(f"a row has not {self.shape[1]} values")
                if len(at) and (at.min() < 0 or at.max() >= self.shape[0]):
                    raise ValueError(f"a place is not among {self.shape[0]} rows")
                block = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.shape[1])
                if not np.isfinite(block).all():
                    raise ValueError("a value is missing or not finite")
                block, order = block.astype(self.kind), np.argsort(at, kind="stable")
                edges = np.flatnonzero(np.diff(at[order], prepend=-2) != 1)
                for lo, hi in zip(edges, [*edges[1:], len(at)], strict=True):  # runs of neighbours in one go
                    f.seek(len(self.head) + int(at[order[lo]]) * self.width)
                    f.write(block[order[lo:hi]].tobytes())
                rows, places = rows + len(at), places + int(at.sum())
            f.flush()
            os.fsync(f.fileno())
        return Written(rows, places)

    def commit(self, messages: list) -> None:
        if self.kept:
            return
        rows, places = (sum(getattr(m, c) for m in messages if m is not None) for c in ("rows", "places"))
        if (rows, places) != (self.shape[0], self.shape[0] * (self.shape[0] - 1) // 2):
            os.remove(self.part)
            raise ValueError(f"{rows} rows were written, or not each place once, of {self.shape[0]}")
        os.replace(self.part, self.path)

    def abort(self, messages: list) -> None:
        if not self.kept and os.path.exists(self.part):
            os.remove(self.part)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "ord bigint, values array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options))


def write(df: DataFrame, path: str, rows: int, columns: int, **options: str) -> None:
    """df(ord, values) as a matrix of so many rows and columns."""
    register(df.sparkSession)
    writer = df.select(F.col("ord").cast("bigint").alias("ord"), F.transform("values", lambda x: x.cast("float")).alias("values")).write.format("npy").mode("append")
    writer.options(rows=rows, columns=columns, **options).save(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
