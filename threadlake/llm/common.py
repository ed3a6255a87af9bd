"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1 / HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Texts a Python worker gets at once; bounds its memory without cutting any text.
ARROW_ROWS = 1000
#: Bytes of a batch that a function sees at once; a longer row is one batch.
BATCH_BYTES = 16 << 20

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table NAME.parquet of a data folder, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset (tests), a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="threadlake-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS, size: str = "16m") -> None:
    """Sets how many rows, and about how many bytes, an Arrow batch to Python holds. Plans read it when they run, so it is
    a hint: pieces() bounds what functions see."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Returns memory that a task has freed to the system: workers are kept, and what one task needed stays with them else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(b: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of consecutive rows, each of about size bytes or one row; whatever session settings made of it."""
    if b.nbytes <= size or b.num_rows < 2:
        if b.num_rows:
            yield b
        return
    half = b.num_rows // 2
    yield from pieces(b.slice(0, half), size)
    yield from pieces(b.slice(half), size)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, size: int = BATCH_BYTES, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with a function from batch to batch, each of about size bytes or one row; done is called after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, size):
                if (out := fn(part)) is not None:
                    yield out
        if done:
            done()
        give_back()

    return df.mapInArrow(run, schema)


def join_unique(rows: DataFrame, unique: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to unique, which holds each key once with the number n of rows that have it.

    Keys with more than total / HOT_SHARE rows are fewer than HOT_SHARE, so they are broadcast and their rows stay where
    they are; all others are joined by shuffle, where no key has more than that share. how is inner or left; for left,
    keys missing from unique are in the second part.
    """
    hot = unique.filter(F.col(n) > max(1, total // HOT_SHARE))
    rest = unique.filter(F.col(n) <= max(1, total // HOT_SHARE))
    names = F.broadcast(hot.select(key))
    there = rows.join(F.broadcast(hot), key, "inner")
    other = rows.join(names, key, "left_anti").join(rest.hint("shuffle_hash") if how == "inner" else rest, key, how)
    return there.unionByName(other)


class Buffer:
    """The UTF-8 bytes of a batch's string column with offsets; null is empty."""

    def __init__(self, col: pa.Array):
        col = col.cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
        n = len(col)
        _, offs, data = col.buffers()
        o = np.frombuffer(offs, np.int64, n + 1 + col.offset)[col.offset :] if n else np.zeros(1, np.int64)
        lo, hi = int(o[0]), int(o[-1])
        self.data = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
        self.offsets = o - lo
        self.n = n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_RANDOM = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once.
_PIECES = 1 << 20


def piece_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece of the bytes; pieces are not empty, in order, and don't overlap."""
    out = np.zeros(len(begin), np.uint64)
    if not len(begin):
        return out
    size = end - begin
    total = np.cumsum(size)
    powers = np.cumprod(np.full(min(int(size.max()), _PIECES), _BASE))
    i = 0
    while i < len(begin):
        if size[i] > _PIECES:  # a long piece, block by block
            shift, value = np.ones(1, np.uint64), np.zeros(1, np.uint64)
            for a in range(int(begin[i]), int(end[i]), _PIECES):
                block = data[a : min(a + _PIECES, int(end[i]))]
                value += shift * (_RANDOM[block] * powers[: len(block)]).sum(dtype=np.uint64)
                shift = shift * powers[len(block) - 1]
            out[i] = value[0]
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + _PIECES)))
        own = size[i:j]
        if j - i > 1 and own[-1] > _PIECES:
            j -= 1
            own = own[:-1]
        first = np.cumsum(own) - own
        at = np.arange(int(own.sum())) - np.repeat(first, own)
        out[i:j] = np.add.reduceat(_RANDOM[data[np.repeat(begin[i:j], own) + at]] * powers[at], first)
        i = j
    return mix64(out)
