"""Files that are there whole or not at all, kept backups, contracts of what was computed, and their hashes. Small files, on the driver."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import time
from collections.abc import Iterable
from pathlib import Path

import numpy as np

from assaylake.operators.contracts import ContractError


def replace(path: str | Path, data: bytes) -> None:
    """Write beside the file, then put in its place."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    with part.open("wb") as out:
        out.write(data)
        out.flush()
        os.fsync(out.fileno())
    part.replace(path)


def csv_bytes(columns: list[str], rows: Iterable[tuple]) -> bytes:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows(rows)
    return out.getvalue().encode()


def write_csv(path: str | Path, columns: list[str], rows: Iterable[tuple]) -> None:
    replace(path, csv_bytes(columns, rows))


def write_json(path: str | Path, value: object) -> None:
    replace(path, canonical(value))


def write_npz(path: str | Path, **arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    replace(path, out.getvalue())


def write_split(folder: str | Path, name: str, seed: int, columns: list[str], rows: Iterable[tuple]) -> Path:
    path = Path(folder) / "splits" / f"{name}_seed{seed}.csv"
    write_csv(path, columns, rows)
    return path


def append_csv(path: str | Path, columns: list[str], rows: Iterable[tuple]) -> None:
    """Rows at the end; the header once; a file with other columns is an error."""
    path = Path(path)
    data = csv_bytes(columns, rows)
    head, body = data.split(b"\n", 1)
    if path.exists() and path.stat().st_size:
        with path.open("rb") as x:
            if x.readline().rstrip(b"\n") != head:
                raise ContractError(f"{path} has other columns")
        data = body
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as out:
        out.write(data)


def install(path: str | Path, data: bytes) -> Path | None:
    """Replace a file and keep what was there under a time stamp; returns where."""
    path, kept = Path(path), None
    if path.exists():
        kept = path.with_name(f"{path.name}.{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}.bak")
        while kept.exists():
            kept = kept.with_name(kept.name + ".1")
        os.link(path, kept)
    replace(path, data)
    return kept


def canonical(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()


def contract_hash(value: object) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def manifest_hash(columns: list[str], rows: Iterable[tuple]) -> str:
    """Of the rows in order, whatever the order they come in."""
    return hashlib.sha256(csv_bytes(columns, sorted(rows, key=lambda r: tuple(map(str, r))))).hexdigest()


def array_hash(x: np.ndarray) -> str:
    """Of type, shape and little-endian content."""
    x = np.ascontiguousarray(x)
    return hashlib.sha256(canonical([x.dtype.newbyteorder("<").str, list(x.shape)]) + x.astype(x.dtype.newbyteorder("<")).tobytes()).hexdigest()


def file_hash(path: str | Path, block: int = 1 << 20) -> str:
    found = hashlib.sha256()
    with Path(path).open("rb") as x:
        while data := x.read(block):
            found.update(data)
    return found.hexdigest()


def keep_manifest(path: str | Path, columns: list[str], rows: list[tuple]) -> str:
    """Write a manifest once: one that is there must say the same. Returns its hash."""
    wanted = manifest_hash(columns, rows)
    if Path(path).exists():
        with Path(path).open(newline="") as x:
            have = list(csv.reader(x))
        if not have or have[0] != columns or manifest_hash(columns, [tuple(r) for r in have[1:]]) != manifest_hash(columns, [tuple(map(str, r)) for r in rows]):
            raise ContractError(f"{path} is immutable and differs")
    else:
        write_csv(path, columns, sorted(rows, key=lambda r: tuple(map(str, r))))
    return wanted
