"""Lines of Zstandard files with windows up to 2 GiB, which Hadoop's codec refuses, as a Spark source and as iterators.

A frame can't be split, but a file may have many, which readers take for one text: the archives written here have a frame for
every few megabytes of lines. All frames of a file are read, and lines may go on from one into the next. A partition is a run of
whole frames; a file of one frame is one partition, so repartition after the first filter.
"""

from __future__ import annotations

import io
import json
import logging
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import ArchiveFile

logger = logging.getLogger(__name__)
MAX_WINDOW = 2**31
BATCH_BYTES = 4 << 20
#: Bytes of lines in a frame that is written, about; and bytes of frames that a partition has at least.
FRAME_BYTES = 8 << 20
SPLIT_BYTES = 1 << 20
SCHEMA = "value string, line_no bigint, kind string, month string, path string"


@dataclass
class ReadProgress:
    bytes_read: int = 0
    total_bytes: int = 0
    lines_read: int = 0
    errors: int = 0

    @property
    def percent(self) -> float:
        return 100.0 * self.bytes_read / self.total_bytes if self.total_bytes else 0.0


def read_zst_lines(path, max_window_size: int = MAX_WINDOW) -> Iterator[tuple[str, int]]:
    """(line, compressed bytes read so far) for lines that aren't blank; only line feeds end lines."""
    with open(path, "rb") as f:
        stream = zstandard.ZstdDecompressor(max_window_size=max_window_size).stream_reader(f, read_across_frames=True)
        for line in io.TextIOWrapper(stream, encoding="utf-8", newline="\n"):
            line = line.removesuffix("\n")
            if line.strip():
                yield line, f.tell()


class _Part:
    """The next n bytes of a file."""

    def __init__(self, f, n: int):
        self.f, self.left = f, n

    def read(self, size: int = -1) -> bytes:
        data = self.f.read(self.left if size < 0 else min(size, self.left))
        self.left -= len(data)
        return data


def read_zst_blocks(path, max_window_size: int = MAX_WINDOW, size: int = BATCH_BYTES, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """Whole lines in blocks of about size bytes. With the frames from start to end only, those lines that begin after the first
    line feed there, or at the file's start, and up to the first one after end."""
    total = os.path.getsize(path)
    end = total if end is None else end
    with open(path, "rb") as f:
        f.seek(start)
        stream = zstandard.ZstdDecompressor(max_window_size=max_window_size).stream_reader(_Part(f, end - start), read_across_frames=True)
        rest: list[bytes] = []
        inside = not start
        while chunk := stream.read(size):
            if not inside:
                _, feed, chunk = chunk.partition(b"\n")
                if not feed:
                    continue
                inside = True
            whole, feed, tail = chunk.rpartition(b"\n")
            if not feed:
                rest.append(chunk)
                continue
            yield b"".join([*rest, whole])
            rest = [tail]
        if inside and end < total:
            f.seek(end)
            stream = zstandard.ZstdDecompressor(max_window_size=max_window_size).stream_reader(f, read_across_frames=True)
            while chunk := stream.read(1 << 16):
                head, feed, _ = chunk.partition(b"\n")
                rest.append(head)
                if feed:
                    break
        if any(rest):
            yield b"".join(rest)


def frames(path) -> list[int]:
    """Where a file's frames begin, by the sizes that their blocks give; 0 only where the file isn't made of whole frames."""
    out, at, size = [], 0, os.path.getsize(path)
    with open(path, "rb") as f:
        while at < size:
            head = os.pread(f.fileno(), 18, at)
            if head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5 and len(head) >= 8:  # to be skipped
                at += 8 + int.from_bytes(head[4:8], "little")
                continue
            if head[:4] != zstandard.FRAME_HEADER or len(head) < 9:
                return [0]
            out.append(at)
            at += zstandard.frame_header_size(head)
            last = 0
            while not last:
                block = os.pread(f.fileno(), 3, at)
                about = int.from_bytes(block, "little")
                last, kind = about & 1, about >> 1 & 3
                if len(block) < 3 or kind == 3:
                    return [0]
                at += 3 + (1 if kind == 1 else about >> 3)
            at += 4 * (head[4] >> 2 & 1)
    return [0, *out[1:]] if at == size else [0]


def splits(path, least: int | None = None) -> list[tuple[int, int]]:
    """Runs of whole frames, (start, end), of so many bytes at least."""
    least = SPLIT_BYTES if least is None else least
    cuts = [0]
    for at in frames(path):
        if at - cuts[-1] >= least:
            cuts.append(at)
    return list(zip(cuts, [*cuts[1:], os.path.getsize(path)]))


def write_archives(lines: DataFrame, root, order: str = "line_no") -> list[Path]:
    """Lines (value, kind of comments or submissions, month) as archives below root; the files. They are sorted in ranges, each
    task writes its range's parts of files as frames, and the parts are put together."""
    names = {"comments": "RC", "submissions": "RS"}
    work = Path(root, f".work-{uuid.uuid4().hex}")
    work.mkdir(parents=True, exist_ok=True)
    folder = str(work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, out, done = TaskContext.get().partitionId(), None, None, []
        held, n = [], 0

        def frame() -> None:
            nonlocal held, n
            if held:
                out.write(zstandard.ZstdCompressor().compress(b"".join(held)))
            held, n = [], 0

        for b in batches:
            values = b.column(0).to_pylist()
            first = 0
            for to, run_of in groupby(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                k = sum(1 for _ in run_of)
                if to != at:
                    if out:
                        frame()
                        out.close()
                    at = to
                    path = f"{folder}/{uuid.uuid4().hex}"
                    out = open(path, "wb")
                    done.append((*to, task, path))
                data = "\n".join(values[first : first + k]).encode() + b"\n"
                held.append(data)
                n += len(data)
                first += k
                if n >= FRAME_BYTES:
                    frame()
        if out:
            frame()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["kind", "month", "task", "path"])

    rows = lines.repartitionByRange("kind", "month", order).sortWithinPartitions("kind", "month", order).select("value", "kind", "month")
    parts = sorted(rows.mapInArrow(run, "kind string, month string, task int, path string").collect())  # a few rows for each task
    made = []
    for (kind, month), own in groupby(parts, lambda r: (r["kind"], r["month"])):
        to = Path(root, kind, f"{names[kind]}_{month}.zst")
        to.parent.mkdir(parents=True, exist_ok=True)
        with open(to, "wb") as out:
            for r in own:
                with open(r["path"], "rb") as part:
                    shutil.copyfileobj(part, out, 1 << 24)
        made.append(to)
    shutil.rmtree(work)
    return sorted(made)


def read_zst_records(path, filter_fn: Callable[[dict], bool] | None = None, progress_callback: Callable[[ReadProgress], None] | None = None, progress_interval: int = 10_000) -> Iterator[dict]:
    """Records that the filter keeps; lines that aren't JSON are counted and skipped."""
    with ZstReader(path, filter_fn) as reader:
        for record in reader:
            if progress_callback and reader.lines_read % progress_interval == 0:
                progress_callback(reader.progress)
            yield record
        if progress_callback:
            progress_callback(reader.progress)


def count_records(path, filter_fn: Callable[[dict], bool] | None = None) -> tuple[int, int]:
    """(all records, those that the filter keeps)."""
    total = kept = 0
    for record in read_zst_records(path):
        total += 1
        kept += filter_fn is None or bool(filter_fn(record))
    return total, kept


class ZstReader:
    """Iterates over a file's records and counts lines, errors and records."""

    def __init__(self, file_path, filter_fn: Callable[[dict], bool] | None = None, show_progress: bool = False):
        self.file_path, self.filter_fn, self.show_progress = Path(file_path), filter_fn, show_progress
        self.lines_read = self.errors = self.records_yielded = 0
        self.progress = ReadProgress(total_bytes=self.file_path.stat().st_size)

    def __enter__(self) -> ZstReader:
        return self

    def __exit__(self, *exc: object) -> None:
        return None

    def __iter__(self) -> Iterator[dict]:
        for line, at in read_zst_lines(self.file_path):
            self.lines_read += 1
            self.progress.bytes_read, self.progress.lines_read = at, self.lines_read
            try:
                record = json.loads(line)
            except json.JSONDecodeError:
                self.errors += 1
                self.progress.errors = self.errors
                logger.warning("%s, line %d is no JSON", self.file_path.name, self.lines_read)
                continue
            if self.filter_fn is None or self.filter_fn(record):
                self.records_yielded += 1
                yield record


def count_archives(spark: SparkSession, archives: list[ArchiveFile], filter_fn: Callable[[dict], bool] | None = None) -> list[tuple[str, str, int, int, int]]:
    """(kind, month, records, errors, records that the filter keeps) of each archive, one task a file. The reader and the count
    must agree."""
    of = [(str(a.path), a.file_type, a.month_str) for a in archives]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, kind, month in (of[k] for k in b.column(0).to_pylist()):
                with ZstReader(path) as reader:
                    n = sum(1 for _ in reader)
                total, kept = count_records(path, filter_fn)
                if total != n or reader.progress.percent != 100.0:
                    raise ValueError(f"the reader and the count of {path} differ")
                out.append({"kind": kind, "month": month, "records": n, "errors": reader.errors, "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("kind", pa.string()), ("month", pa.string()), ("records", pa.int64()), ("errors", pa.int64()), ("kept", pa.int64())]))

    rows = spark.range(0, len(of), 1, max(1, len(of))).mapInArrow(run, "kind string, month string, records long, errors long, kept long")
    return [tuple(r) for r in rows.collect()]  # a row for each file


@dataclass
class _File(InputPartition):
    path: str
    kind: str
    month: str
    start: int
    end: int
    first: int


class _Reader(DataSourceReader):
    def __init__(self, files: list[dict]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        # lines are numbered within partitions, and those of later ones higher
        return [_File(**f, start=a, end=b, first=k << 40) for f in self.files for k, (a, b) in enumerate(splits(f["path"]))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.string()), ("line_no", pa.int64()), ("kind", pa.string()), ("month", pa.string()), ("path", pa.string())])
        first = partition.first
        for block in read_zst_blocks(partition.path, start=partition.start, end=partition.end):
            lines = [line for line in block.split(b"\n") if line.strip()]
            k = len(lines)
            if k:
                names = (pa.repeat(pa.scalar(v, pa.string()), k) for v in (partition.kind, partition.month, partition.path))
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string()), pa.array(range(first, first + k), pa.int64()), *names], schema=schema)
            first += k


class ZstLines(DataSource):
    """Format zst_lines; option files is a JSON list of {path, kind, month}."""

    @classmethod
    def name(cls) -> str:
        return "zst_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]))


def read_archives(spark: SparkSession, archives: list[ArchiveFile]) -> DataFrame:
    """Lines of archives: value, line_no, kind (comments or submissions), month, path."""
    if not archives:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(ZstLines)
    files = [{"path": str(a.path), "kind": a.file_type, "month": a.month_str} for a in archives]
    return spark.read.format("zst_lines").option("files", json.dumps(files)).load()
