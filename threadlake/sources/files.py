"""Readers and writers of the extracted layout <root>/<community>/<YYYY-MM>/<files>, and of single files.

The exact file names are a contract, so a table is written by Spark in partitions and its part files are then put together under
their names. Rows are sorted in ranges, so many tasks write one file, in order, and a large file is read by many tasks (see
parts). Paths are on a file system that driver and executors share.
"""

from __future__ import annotations

import csv
import gzip
import json
import re
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import parts

_MONTH = re.compile(r"[0-9]{4}-[0-9]{2}")
#: Rows of a part file at most, which becomes a member of a gzip file.
PART_ROWS = 100_000
_PART = re.compile(r"part-(\d+)-.*?c(\d+)\.")
_CSV = {"header": "true", "escape": '"', "nullValue": "", "emptyValue": ""}


def _in_order(path: Path) -> tuple[int, int]:
    """By a part file's task and its place among the task's files."""
    m = _PART.match(path.name)
    return int(m[1]), int(m[2])


def month_folders(root) -> list[str]:
    return sorted(p.name for p in Path(root).iterdir() if p.is_dir() and _MONTH.fullmatch(p.name))


def read_json(path) -> dict | None:
    """None where the file is missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def write_json(path, data: dict) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")
    part.replace(path)


def read_month(spark: SparkSession, root, month: str, kind: str) -> DataFrame | None:
    """Typed records of a month (kind: comment or submission): JSON lines if there are such, else CSV, else None."""
    folder = Path(root, month)
    lines = folder / f"{kind}s.jsonl.gz"
    if lines.exists():
        rows = parts.read_lines(spark, lines).filter(F.trim("value") != "")
        return schema.parse(rows.select("value", F.lit(month).alias("month"), F.monotonically_increasing_id().alias("line_no")), kind)
    table = folder / f"{kind}s.csv"
    if table.exists() and table.stat().st_size:
        cells = read_csv(spark, table)
        value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cells.columns]))
        return schema.parse(cells.select(value.alias("value"), F.lit(month).alias("month"), F.monotonically_increasing_id().alias("line_no")), kind)
    return None


def read_months(spark: SparkSession, root, months: list[str], kind: str) -> DataFrame | None:
    out = None
    for m in months:
        part = read_month(spark, root, m, kind)
        if part is not None:
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path) -> DataFrame:
    """A CSV table, every value a text."""
    return parts.read_csv(spark, path)


def csv_columns(records: DataFrame, kind: str) -> DataFrame:
    names = schema.COMMENT_CSV if kind == "comment" else schema.SUBMISSION_CSV
    return records.select(*[F.col(n).cast("string").alias(n) for n in names])


def write_single(df: DataFrame, path, kind: str = "csv", order: list | None = None) -> int:
    """One file of a DataFrame: CSV with header (also without rows), or lines of its one column; how many rows."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    work = path.parent / f".work-{uuid.uuid4().hex}"
    df, spark = df.orderBy(*order) if order else df, df.sparkSession
    if kind == "csv":
        df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).write.options(**_CSV).csv(str(work))
        n = read_csv(spark, work).count()
    else:
        df.write.option("maxRecordsPerFile", PART_ROWS).option("compression", "gzip" if path.suffix == ".gz" else "none").text(str(work))
        n = parts.read_lines(spark, work).count()
    made = sorted((p for p in work.iterdir() if p.name.startswith("part-")), key=_in_order)
    if made:
        parts.join(made, path, kind == "csv")
    elif path.suffix == ".gz":
        path.write_bytes(gzip.compress(b""))
    else:
        path.write_text(",".join(df.columns) + "\n" if kind == "csv" else "")
    shutil.rmtree(work)
    return n


def write_grouped(df: DataFrame, root, name: str, keys: dict[str, str], kind: str, order: list[str]) -> list[Path]:
    """A file NAME in <root>/<key>/... for each value of the keys (folder level to column): jsonl writes column raw, csv the
    others. The files, in order."""
    root = Path(root)
    root.mkdir(parents=True, exist_ok=True)
    work = root / f".work-{uuid.uuid4().hex}"
    keyed = df.withColumns({f"_{k}": F.col(c) for k, c in keys.items()})
    levels = [f"_{k}" for k in keys]
    keyed = keyed.repartitionByRange(*levels, *order).sortWithinPartitions(*levels, *order)
    if kind == "jsonl":
        keyed.select(*levels, F.col("raw").alias("value")).write.partitionBy(*levels).options(maxRecordsPerFile=PART_ROWS, compression="gzip").text(str(work))
    else:
        columns = [c for c in df.columns if c not in ("raw", "line_no", *keys.values())]
        keyed.select(*levels, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).write.partitionBy(*levels).options(**_CSV).csv(str(work))
    out = []
    for folder in sorted({p.parent for p in work.rglob("part-*")}):
        values = [p.partition("=")[2] for p in folder.relative_to(work).parts]
        to = root.joinpath(*values, name)
        to.parent.mkdir(parents=True, exist_ok=True)
        parts.join(sorted(folder.glob("part-*"), key=_in_order), to, kind == "csv")
        out.append(to)
    shutil.rmtree(work)
    return out


# ---- record-at-a-time writers for small outputs


class JsonlWriter:
    """JSON lines, gzipped for names in .gz; count says how many."""

    def __init__(self, path, compress: bool = True):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self._file = gzip.open(self.path, "wt", encoding="utf-8") if compress else open(self.path, "w", encoding="utf-8")
        self.count = 0

    def write(self, record: dict) -> None:
        self._file.write(json.dumps(record, ensure_ascii=False) + "\n")
        self.count += 1

    def close(self) -> None:
        self._file.close()

    def __enter__(self):
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


class CsvWriter:
    """CSV of records; the columns are given or those of the first record. A header is written even without records."""

    def __init__(self, path, fields: list[str] | None = None, extra_fields: bool = False):
        self.path, self.fields = Path(path), list(fields) if fields else None
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self._file = open(self.path, "w", newline="", encoding="utf-8")
        self._writer, self.count = None, 0
        if self.fields:
            self._head()

    def _head(self) -> None:
        self._writer = csv.writer(self._file)
        self._writer.writerow(self.fields)

    @staticmethod
    def text(value: object) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return "true" if value else "false"
        return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)

    def write(self, record: dict) -> None:
        if self._writer is None:
            self.fields = list(record)
            self._head()
        self._writer.writerow([self.text(record.get(f)) for f in self.fields])
        self.count += 1

    close, __enter__, __exit__ = JsonlWriter.close, JsonlWriter.__enter__, JsonlWriter.__exit__


class StreamingThreadWriter(JsonlWriter):
    """One nested thread a line."""

    def write_thread(self, thread: dict) -> None:
        self.write(thread)


class ThreadWriter:
    """Threads kept until save() writes them as one JSON array."""

    def __init__(self, path):
        self.path, self.threads = Path(path), []

    def add(self, thread: dict) -> None:
        self.threads.append(thread)

    def save(self) -> None:
        self.path.write_text(json.dumps(self.threads, ensure_ascii=False), encoding="utf-8")


def write_records_csv(records: list[dict], path, kind: str) -> int:
    """Records as the CSV file of comments or submissions."""
    with CsvWriter(path, schema.COMMENT_CSV if kind == "comment" else schema.SUBMISSION_CSV) as w:
        for r in records:
            w.write(r)
    return w.count
