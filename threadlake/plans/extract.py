"""Extraction of communities from monthly archives."""

from __future__ import annotations

import re
import shutil
import time
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import community_folder, now, readable_duration
from ..operators import authors, filters
from ..session import session
from ..sources import files
from ..sources.archives import ArchiveFile, discover_archives, get_months_in_range
from ..sources.zst import read_archives
from .manifest import Manifest

_MONTH_AUTHORS = "author comment_count submission_count comment_score_total avg_comment_score submission_score_total avg_submission_score first_seen_utc last_seen_utc".split()


@dataclass
class ExtractionStats:
    subreddit: str
    month: str
    submissions_count: int = 0
    comments_count: int = 0
    duration_seconds: float = 0.0

    def __str__(self) -> str:
        return f"{self.subreddit}/{self.month}: {self.submissions_count:,} submissions and {self.comments_count:,} comments in {readable_duration(self.duration_seconds)}"


@dataclass
class ExtractionResult:
    subreddits: list[str]
    months_processed: int
    total_submissions: int
    total_comments: int
    duration_seconds: float
    stats: list[ExtractionStats] = field(default_factory=list)


def archives_of(root, comments_subdir: str, submissions_subdir: str) -> list[ArchiveFile]:
    if not Path(root).exists():
        raise ValueError(f"there is no folder {root}")
    found = discover_archives(root, comments_subdir, submissions_subdir)
    if not found:
        raise ValueError(f"there are no archives in {root}")
    return found


def records_of(spark: SparkSession, archives: list[ArchiveFile]) -> tuple[DataFrame, DataFrame]:
    """(comments, submissions), typed, with month and line_no."""
    out = []
    for kind in ("comment", "submission"):
        lines = read_archives(spark, [a for a in archives if a.file_type == f"{kind}s"]).select("value", "month", "line_no")
        out.append(schema.parse(lines, kind))
    return out[0], out[1]


class SubredditExtractor:
    """Extracts communities, by keywords if wanted, with author statistics; months already done are skipped.

    One job reads the pending archives, a file a partition, and keeps the matching records as Parquet, from which all files
    are written. workers and show_progress are accepted; Spark decides on parallelism.
    """

    def __init__(self, archive_path, output_path, subreddits: list[str], output_format: str = "both", comments_subdir: str = "comments", submissions_subdir: str = "submissions", show_progress: bool = True, include_patterns: list[str] | None = None, exclude_patterns: list[str] | None = None, force: bool = False, workers: int = 1, spark: SparkSession | None = None, exact_round: bool = False):
        if output_format not in ("csv", "jsonl", "both"):
            raise ValueError(f"output_format is csv, jsonl or both, not {output_format!r}")
        self.archives = archives_of(archive_path, comments_subdir, submissions_subdir)
        self.output_path, self.output_format, self.force = Path(output_path), output_format, force
        self.subreddits = list(dict.fromkeys(s.lower().removeprefix("r/") for s in subreddits))
        self.include, self.exclude = list(include_patterns or []), list(exclude_patterns or [])
        for p in self.include + self.exclude:
            re.compile(p)
        self.spark = spark or session()
        self.manifest = Manifest(self.output_path, subreddits=sorted(self.subreddits), include=self.include, exclude=self.exclude, format=output_format)

    def run(self, start_month: str | None = None, end_month: str | None = None) -> ExtractionResult:
        began = time.time()
        months = self.manifest.pending(get_months_in_range(self.archives, start_month, end_month), self.force)
        result = ExtractionResult(self.subreddits, len(months), 0, 0, 0.0)
        if months:
            self._extract(months, result, began)
        result.duration_seconds = time.time() - began
        return result

    def _extract(self, months: list[str], result: ExtractionResult, began: float) -> None:
        work = self.output_path / f".work-{uuid.uuid4().hex}"
        comments, submissions = records_of(self.spark, [a for a in self.archives if a.month_str in months])
        kept = {}
        for kind, records in (("comment", comments), ("submission", submissions)):
            own = filters.keywords(filters.communities(records, self.subreddits), kind, self.include, self.exclude)
            own.withColumn("_dir", F.lower("subreddit")).write.parquet(str(work / kind))
            kept[kind] = self.spark.read.parquet(str(work / kind))
        keys = {"s": "_dir", "m": "month"}
        for kind, records in kept.items():
            if self.output_format in ("jsonl", "both"):
                files.write_grouped(records, self.output_path, f"{kind}s.jsonl.gz", keys, "jsonl", ["line_no"])
            if self.output_format in ("csv", "both"):
                names = schema.COMMENT_CSV if kind == "comment" else schema.SUBMISSION_CSV
                files.write_grouped(records.select("_dir", "month", "line_no", *names).withColumnRenamed("month", "_month"), self.output_path, f"{kind}s.csv", {"s": "_dir", "m": "_month"}, "csv", ["line_no"])
        monthly = authors.by_month(authors.activity(*(kept[k].withColumn("subreddit", F.col("_dir")) for k in ("comment", "submission"))))
        monthly.write.parquet(str(work / "authors"))
        monthly = self.spark.read.parquet(str(work / "authors"))
        files.write_grouped(monthly.select(F.col("subreddit").alias("_dir"), F.col("month").alias("_month"), *_MONTH_AUTHORS), self.output_path, "authors.csv", {"s": "_dir", "m": "_month"}, "csv", ["author"])
        counts = {(r["subreddit"], r["month"]): r for r in monthly.groupBy("subreddit", "month").agg(F.sum("submission_count").alias("s"), F.sum("comment_count").alias("c")).collect()}
        seconds = time.time() - began
        done: dict[str, dict] = {m: {} for m in months}
        for (name, month), r in sorted(counts.items(), key=lambda x: (x[0][1], x[0][0])):
            stats = ExtractionStats(name, month, r["s"], r["c"], seconds)
            result.stats.append(stats)
            result.total_submissions += r["s"]
            result.total_comments += r["c"]
            done[month][name] = [r["s"], r["c"]]
            about = {"subreddit": name, "month": month, "submissions_count": r["s"], "comments_count": r["c"], "extracted_at": now(), "extraction_duration_seconds": seconds}
            files.write_json(self.output_path / community_folder(name) / month / "metadata.json", about | {"include_patterns": self.include, "exclude_patterns": self.exclude})
        for name in {k[0] for k in counts}:
            self._finish(name)
        self.manifest.done(done)
        shutil.rmtree(work)

    def _finish(self, name: str) -> None:
        """The community's own files, from all its months on disk."""
        folder = self.output_path / community_folder(name)
        months = {m: about for m in files.month_folders(folder) if (about := files.read_json(folder / m / "metadata.json"))}
        parts = [files.read_csv(self.spark, folder / m / "authors.csv").withColumns({"month": F.lit(m), "subreddit": F.lit(name)}) for m in months if (folder / m / "authors.csv").exists()]
        if parts:
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            numbers = [c for c in _MONTH_AUTHORS if c != "author" and not c.startswith("avg")]
            every = every.withColumns({c: F.col(c).cast("bigint") for c in numbers})
            files.write_single(authors.by_community(every).select(*_MONTH_AUTHORS, "months_active"), folder / "authors.csv", order=["author"])
        total = {k: sum(a.get(k, 0) for a in months.values()) for k in ("submissions_count", "comments_count")}
        files.write_json(folder / "metadata.json", {"subreddit": name, "months": sorted(months), "total_submissions": total["submissions_count"], "total_comments": total["comments_count"], "extracted_at": now(), "output_format": self.output_format, "include_patterns": self.include, "exclude_patterns": self.exclude})
