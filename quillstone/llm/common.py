"""Shared pieces: shared-folder checkpoints, Arrow text batches and numpy kernels over UTF-8 bytes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels; one longer document is handled alone.
CHUNK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def prepare(spark: SparkSession) -> None:
    """Lets the Python workers import this package and gives checkpoints a folder where none is set.

    On a cluster spark.checkpoint.dir names a shared folder and is used as it is, and must be set; the package is
    installed there or sent with --py-files. Only a session whose executors are threads of this process gets a temporary
    folder, which goes when the process ends.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="quillstone-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and reads them from there: later steps don't recompute them."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls as empty, and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text (or one row) and ``most`` rows, with bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = as_bytes(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = min(i + most, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def sample(rows: DataFrame, size: int, salt: int, key: str = "doc_id") -> DataFrame:
    """About ``size`` rows, chosen by a hash of their id: a training sample whose size doesn't grow with the table."""
    total = rows.count()
    if total <= size:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * size / total))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n or more of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes of a kind, by default all but ASCII white space; runs end with their row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid
    last[:-1] &= ~last[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


def running_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand; sums: those of ``data``, if at hand."""
    sums = running_sums(data) if sums is None else sums
    _, down = _power(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows of all n-word shingles (fewer words: the whole sequence as one), and words per row."""
    starts, ends, row = word_spans(data, off)
    count = np.bincount(row, minlength=len(off) - 1)
    if not len(starts):
        return np.zeros(0, np.uint64), row, count
    h = span_hashes(data, starts, ends)
    first = np.concatenate(([0], np.cumsum(count)))
    local = np.arange(len(h)) - first[row]
    full = local + n <= count[row]
    at = np.flatnonzero(full)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_BASE) + h[at + k])
    hashes, rows = out, row[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        more = np.empty(len(short), np.uint64)
        for k, r in enumerate(short):
            acc = np.uint64(int(count[r]))
            with np.errstate(over="ignore"):
                for x in h[first[r] : first[r] + count[r]]:
                    acc = mix(np.asarray(acc * np.uint64(_BASE) + x))[()]
            more[k] = acc
        hashes, rows = np.concatenate((hashes, more)), np.concatenate((rows, short))
    return hashes, rows, count
