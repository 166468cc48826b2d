"""Helpers shared by the training-data operators.

The text helpers work on whole Arrow columns with numpy, in slices of a few MB, so that a
task's memory follows the Arrow batch and not the number of words in it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])

# Freed Arrow buffers go back to the system, so that a worker that waits for tasks holds little.
pa.set_memory_pool(pa.system_memory_pool())

#: Rows of an Arrow batch: texts may be long, and a batch is in memory on both sides.
BATCH_ROWS = 1000

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that a slice of text holds; see ``byte_slices``.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Makes the package importable in the Python workers, bounds Arrow batches, and sets a checkpoint folder where none is set.

    The folder that the cluster names in ``spark.checkpoint.dir`` is used as it is; only a
    local session without one gets a new temporary folder.
    """
    sc = spark.sparkContext
    paths = [p for p in (sc.environment.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark


def fresh(name: str, columns: list[str]) -> str:
    """The name, with as many ``_`` before it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = splitmix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = _BYTES[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("p", _MUL), ("q", _INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and, for n texts, n + 1 offsets into them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return b, o - o[0]


def byte_slices(b: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts the bytes at white space or text starts into slices of about SLICE_BYTES."""
    at, n = 0, len(b)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        while end < n and not (_SPACE[b[end - 1]] or _SPACE[b[end]]):
            step = np.flatnonzero(_SPACE[b[end : end + SLICE_BYTES]])
            near = cuts[np.searchsorted(cuts, end)]
            end = int(min(near, end + step[0] if len(step) else end + SLICE_BYTES, n))
            if end == near:
                break
        yield at, end
        at = end


def text_slices(column: pa.Array, most: int = 2 * SLICE_BYTES) -> Iterator[pa.Array]:
    """Parts of a column of about that many bytes, or one text where it is longer, so that what is made of them stays small."""
    off = utf8(column)[1]
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield column.slice(at, end - at)
        at = end


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a column of texts and, for n texts, n + 1 offsets into them.

    A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Equal
    words have equal hashes wherever they stand: the hash is a polynomial of the word's bytes,
    taken from prefix sums over the slice and shifted back to the word's start.
    """
    b, off = utf8(column)
    out, starts = [], []
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[off] = True
    for lo, hi in byte_slices(b, off):
        part = b[lo:hi]
        word = ~_SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[lo + 1 : hi]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[lo + 1 : hi]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        p, q = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[part] * p[: len(part)], out=total[1:])
        out.append(splitmix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64)))
        starts.append(s + lo)
    if not out:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(out), np.searchsorted(np.concatenate(starts), off)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words; run i starts at word i."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        total = splitmix(total * _MUL + words[k : k + n])
    return total



def shared_name(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share; ``prepare`` has set it."""
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *folders: str) -> None:
    """Deletes folders that the caller has made, on whatever store they are."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, at: str) -> DataFrame:
    """The table as read back from where it is now written, so that what comes later does not run it again."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
