"""Parts of single files, so that several tasks read one: members of gzip files, and records of CSV files.

A gzip file may have many members, which readers take for one text. Those that are written here say in an extra field of their
header how long they are, so the next is found without decompressing; files without such fields are one partition. A line feed
ends a CSV record where the quotes before it are even in number, so records are found by counting quotes.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES = 4 << 20
#: Bytes that a partition has at least.
GZIP_SPLIT = 1 << 20
CSV_SPLIT = 8 << 20

_PLAIN = b"\x1f\x8b\x08\x00"
_FIELD = struct.Struct("<H2sHQ")  # length of the extra field, its name, length of its value, bytes of the member


def join(parts: list[Path], to: Path, header: bool = False) -> None:
    """Puts the parts together and removes them: gzip members with their length in the header, and of header lines, which all parts
    have, the first."""
    packed, head = to.suffix == ".gz", 0
    if not packed and len(parts) == 1:
        parts[0].replace(to)
        return
    with open(to, "wb") as out:
        for k, path in enumerate(parts):
            with open(path, "rb") as part:
                if packed:
                    start = part.read(10)
                    if start[:4] == _PLAIN:
                        out.write(start[:3] + b"\x04" + start[4:] + _FIELD.pack(12, b"TL", 8, path.stat().st_size + _FIELD.size))
                    else:
                        out.write(start)
                elif header and not k:
                    head = len(part.readline())
                    part.seek(0)
                else:
                    part.seek(head)
                shutil.copyfileobj(part, out, 1 << 24)
            path.unlink()


def members(path) -> list[int]:
    """Where a gzip file's members begin; 0 only where one doesn't say how long it is."""
    out, at, size = [], 0, os.path.getsize(path)
    with open(path, "rb") as f:
        while at < size:
            head = os.pread(f.fileno(), 10 + _FIELD.size, at)
            if len(head) < 10 + _FIELD.size or head[:4] != b"\x1f\x8b\x08\x04":
                return [0]
            length, name, width, n = _FIELD.unpack(head[10:])
            if (length, name, width) != (12, b"TL", 8) or n <= len(head):
                return [0]
            out.append(at)
            at += n
    return out if out and at == size else [0]


def records(path, least: int | None = None) -> list[int] | None:
    """Where runs of CSV records begin, of so many bytes at least. None where carriage returns or a byte order mark may mean that
    records end otherwise, or quotes don't match."""
    least = CSV_SPLIT if least is None else least
    out, at, odd, size = [0], 0, 0, os.path.getsize(path)
    with open(path, "rb") as f:
        while block := f.read(BLOCK_BYTES):
            if b"\r" in block or (not at and block.startswith(b"\xef\xbb\xbf")):
                return None
            data = np.frombuffer(block, np.uint8)
            quotes = np.flatnonzero(data == 34)
            while (from_ := max(out[-1] + least, at)) < at + len(block):
                feed = block.find(b"\n", from_ - at)
                while feed >= 0 and (odd + np.searchsorted(quotes, feed)) % 2:
                    feed = block.find(b"\n", feed + 1)
                if feed < 0 or at + feed + 1 >= size:
                    break
                out.append(at + feed + 1)
            odd = (odd + len(quotes)) % 2
            at += len(block)
    return None if odd else out


def split_records(data: bytes) -> list[bytes]:
    """The records of whole CSV records' bytes, without line feeds at their end; empty lines are none."""
    if b'"' not in data:
        return [x for x in data.split(b"\n") if x]
    values = np.frombuffer(data, np.uint8)
    feeds = np.flatnonzero(values == 10)
    ends = feeds[np.searchsorted(np.flatnonzero(values == 34), feeds) % 2 == 0].tolist()
    out = [data[a:b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(data)])]
    return [x for x in out if x]


@dataclass
class _Run(InputPartition):
    path: str
    start: int
    end: int


def _lines(part: _Run) -> Iterator[list[bytes]]:
    with open(part.path, "rb") as f:
        f.seek(part.start)
        left, rest, inflate = part.end - part.start, b"", zlib.decompressobj(31)
        while left > 0:
            data = f.read(min(left, BLOCK_BYTES // 4))
            left -= len(data)
            if not data:
                raise ValueError(f"{part.path} ends before {part.end}")
            texts = [rest]
            while data:
                texts.append(inflate.decompress(data))
                data = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
            whole, feed, rest = b"".join(texts).rpartition(b"\n")
            if feed:
                yield whole.split(b"\n")
        if rest:
            yield [rest]


class _Reader(DataSourceReader):
    def __init__(self, path: str, cuts: list[int] | None):
        self.path, self.cuts = path, cuts

    def partitions(self) -> list[InputPartition]:
        return [_Run(self.path, a, b) for a, b in zip(self.cuts, [*self.cuts[1:], os.path.getsize(self.path)])]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        if self.path.endswith(".gz"):
            lots = _lines(partition)
        else:
            with open(partition.path, "rb") as f:
                f.seek(partition.start)
                lots = [split_records(f.read(partition.end - partition.start))]
        for lot in lots:
            for k in range(0, len(lot), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(lot[k : k + 50_000], pa.binary())], names=["value"])


class FileParts(DataSource):
    """Format file_parts: lines of a gzip file, or records of a CSV file (option path), by partitions that begin at cuts."""

    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def schema(self) -> str:
        return "value binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["file"], json.loads(self.options["cuts"]))


def _read(spark: SparkSession, path, cuts: list[int]) -> DataFrame:
    spark.dataSource.register(FileParts)
    rows = spark.read.format("file_parts").option("file", str(path)).option("cuts", json.dumps(cuts)).load()
    return rows.select(F.col("value").cast("string").alias("value"))


def read_lines(spark: SparkSession, path, least: int | None = None) -> DataFrame:
    """Lines of a text file in order, column value."""
    if str(path).endswith(".gz"):
        cuts = [0]
        for at in members(path):
            if at - cuts[-1] >= (GZIP_SPLIT if least is None else least):
                cuts.append(at)
        if len(cuts) > 1:
            return _read(spark, path, cuts)
    return spark.read.option("lineSep", "\n").text(str(path))


def read_csv(spark: SparkSession, path, least: int | None = None) -> DataFrame:
    """A CSV table in order, every value a text."""
    how = {"header": "true", "multiLine": "true", "escape": '"', "inferSchema": "false"}
    rows = spark.read.options(**how).csv(str(path))
    least = CSV_SPLIT if least is None else least
    if not os.path.isfile(path) or os.path.getsize(path) < 2 * least or not (cuts := records(path, least)) or len(cuts) < 2:
        return rows
    with open(path, "rb") as f:
        header = f.readline()
    if header.count(b'"') % 2 or not header.strip():
        return rows
    cuts[0] = len(header)
    schema = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in rows.columns)
    made = _read(spark, path, cuts).select(F.from_csv("value", schema, {"escape": '"', "multiLine": "true"}).alias("_row"))
    return made.select("_row.*")
