"""Plans over whole archives: catalogue, index of communities, pattern search; and the index of authors across communities."""

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
from ..functions.text import now
from ..operators import authors, catalogue, filters
from ..session import session
from ..sources import files
from ..sources.archives import get_months_in_range
from .extract import archives_of, records_of
from .manifest import Manifest


class _OverArchives:
    def __init__(self, archive_path, output_path, comments_subdir: str = "comments", submissions_subdir: str = "submissions", show_progress: bool = True, spark: SparkSession | None = None):
        self.archives = archives_of(archive_path, comments_subdir, submissions_subdir)
        self.output_path, self.spark = Path(output_path), spark or session()

    def _pending(self, done: list[str], start: str | None, end: str | None) -> list[str]:
        return [m for m in get_months_in_range(self.archives, start, end) if m not in done]

    def _records(self, months: list[str]) -> tuple[DataFrame, DataFrame]:
        return records_of(self.spark, [a for a in self.archives if a.month_str in months])


def _done(store: Path) -> list[str]:
    """Months whose partition was written whole."""
    return sorted(p.name.partition("=")[2] for p in store.glob("month=*") if (p / "_DONE").exists())


class ArchiveCatalogue(_OverArchives):
    """A row for each community and month. Months are kept as partitions beside the CSV file and replaced whole."""

    def run(self, start_month: str | None = None, end_month: str | None = None, min_activity: int = 1) -> dict[str, int]:
        store = self.output_path.with_name(f"{self.output_path.stem}_months")
        months = self._pending(_done(store), start_month, end_month)
        if months:
            rows = catalogue.catalogue(authors.activity(*self._records(months)), min_activity)
            _write_months(rows, store, months)
        every = _read_months(self.spark, store)
        n = seen = 0
        if every is not None:
            n = files.write_single(every.select("subreddit", "month", "n_submissions", "n_comments", "n_unique_authors"), self.output_path, order=["month", "subreddit"])
            seen = every.select("subreddit").distinct().count()
        return {"months_processed": len(months), "subreddits_seen": seen, "rows_written": n}


def _write_months(rows: DataFrame, store: Path, months: list[str]) -> None:
    work = store.with_name(f".work-{uuid.uuid4().hex}")
    rows.repartition("month").write.partitionBy("month").parquet(str(work))
    store.mkdir(parents=True, exist_ok=True)
    for m in months:
        to = store / f"month={m}"
        shutil.rmtree(to, ignore_errors=True)
        part = work / f"month={m}"
        part.replace(to) if part.exists() else to.mkdir()
        (to / "_DONE").touch()
    shutil.rmtree(work)


def _read_months(spark: SparkSession, store: Path) -> DataFrame | None:
    paths = [str(store / f"month={m}") for m in _done(store) if any((store / f"month={m}").glob("*.parquet"))]
    if not paths:
        return None
    return spark.read.option("basePath", str(store)).option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(*paths).withColumn("month", F.col("month").cast("string"))


class SubredditIndex(_OverArchives):
    """A row for each community over all months that have been scanned so far, also by runs before."""

    def run(self, start_month: str | None = None, end_month: str | None = None, min_records: int = 1) -> dict[str, int]:
        store = self.output_path.with_name(f"{self.output_path.stem}_months")
        months = self._pending(_done(store), start_month, end_month)
        if months:
            comments, submissions = self._records(months)
            _write_months(catalogue.month_index(submissions, comments), store, months)
        every = _read_months(self.spark, store)
        n = 0
        if every is not None:
            rows = catalogue.community_index(every, min_records)
            n = files.write_single(rows, self.output_path, order=["subreddit"])
        return {"months_processed": len(months), "subreddits_written": n}


class CrossSubIndex:
    """Authors active in several extracted communities."""

    def __init__(self, paths: list, spark: SparkSession | None = None):
        self.paths, self.spark, self.stats, self.least = [Path(p) for p in paths], spark or session(), None, 2

    @classmethod
    def from_directory(cls, extracted_dir, subreddits: list[str] | None = None, spark: SparkSession | None = None) -> CrossSubIndex:
        wanted = {s.lower() for s in subreddits} if subreddits else None
        folders = sorted(p for p in Path(extracted_dir).iterdir() if (p / "authors.csv").exists())
        return cls([p for p in folders if wanted is None or p.name.lower() in wanted], spark)

    def build(self, min_subreddits: int = 2) -> CrossSubIndex:
        self.least, self.stats = min_subreddits, None
        for p in self.paths:
            part = files.read_csv(self.spark, p / "authors.csv").withColumn("subreddit", F.lit(p.name))
            self.stats = part if self.stats is None else self.stats.unionByName(part)
        if self.stats is not None:
            counts = ("comment_count", "submission_count", "comment_score_total", "submission_score_total", "months_active", "first_seen_utc", "last_seen_utc")
            self.stats = self.stats.withColumns({c: F.col(c).cast("bigint") for c in counts})
        return self

    def save(self, output_dir) -> dict[str, int]:
        if self.stats is None:
            return {"authors": 0, "pairs": 0}
        first = ["author", "subreddit"]
        rows = authors.across_communities(self.stats, self.least)
        rows = rows.select(*first, *[c for c in self.stats.columns if c not in first])
        pairs = files.write_single(rows, Path(output_dir, "author_activity.csv"), order=first)
        n = files.write_single(authors.across_summary(self.stats, self.least), Path(output_dir, "author_summary.csv"), order=["author"])
        return {"authors": n, "pairs": pairs}


@dataclass
class SearchStats:
    month: str
    comments_matched: int = 0
    submissions_matched: int = 0
    duration_seconds: float = 0.0


@dataclass
class SearchResult:
    pattern: str
    months_processed: int
    total_comments: int
    total_submissions: int
    duration_seconds: float
    stats: list[SearchStats] = field(default_factory=list)


class WordSearcher:
    """Every comment and submission of the archives with a pattern, as files for each month.

    The text decides; with compat_prefilter the raw JSON line must have the pattern too.
    """

    def __init__(self, archive_path, output_path, pattern: str, case_sensitive: bool = False, search_comments: bool = True, search_submissions: bool = True, output_format: str = "jsonl", workers: int = 1, force: bool = False, show_progress: bool = True, comments_subdir: str = "comments", submissions_subdir: str = "submissions", spark: SparkSession | None = None, compat_prefilter: bool = False):
        re.compile(pattern)
        self.archives = archives_of(archive_path, comments_subdir, submissions_subdir)
        self.output_path, self.pattern, self.case_sensitive, self.force = Path(output_path), pattern, case_sensitive, force
        self.kinds = [k for k, on in (("comment", search_comments), ("submission", search_submissions)) if on]
        self.output_format, self.raw_first, self.spark = output_format, compat_prefilter, spark or session()
        self.manifest = Manifest(self.output_path, pattern=pattern, case=case_sensitive, kinds=self.kinds, format=output_format, raw=compat_prefilter)

    def run(self, start_month: str | None = None, end_month: str | None = None) -> SearchResult:
        began = time.time()
        months = self.manifest.pending(get_months_in_range(self.archives, start_month, end_month), self.force)
        counts: dict[str, dict] = {m: {"comment": 0, "submission": 0} for m in months}
        if months:
            both = dict(zip(("comment", "submission"), records_of(self.spark, [a for a in self.archives if a.month_str in months])))
            for kind in self.kinds:
                work = self.output_path / f".work-{uuid.uuid4().hex}"
                filters.search(both[kind], kind, self.pattern, self.case_sensitive, self.raw_first).write.parquet(str(work))
                found = self.spark.read.parquet(str(work))
                if self.output_format in ("jsonl", "both"):
                    files.write_grouped(found, self.output_path, f"{kind}s.jsonl.gz", {"m": "month"}, "jsonl", ["line_no"])
                if self.output_format in ("csv", "both"):
                    names = schema.COMMENT_CSV if kind == "comment" else schema.SUBMISSION_CSV
                    files.write_grouped(found.select(F.col("month").alias("_dir"), "line_no", *names), self.output_path, f"{kind}s.csv", {"m": "_dir"}, "csv", ["line_no"])
                for r in found.groupBy("month").count().collect():
                    counts[r["month"]][kind] = r["count"]
                shutil.rmtree(work)
        seconds = time.time() - began
        for m, n in counts.items():
            about = {"month": m, "pattern": self.pattern, "comments_matched": n["comment"], "submissions_matched": n["submission"], "duration_seconds": seconds, "completed_at": now()}
            files.write_json(self.output_path / m / "metadata.json", about)
        self.manifest.done(counts)
        every = self.manifest.months
        total = {k: sum(n[k] for n in every.values()) for k in ("comment", "submission")}
        files.write_json(self.output_path / "metadata.json", {"pattern": self.pattern, "months": sorted(every), "total_comments": total["comment"], "total_submissions": total["submission"], "completed_at": now()})
        stats = [SearchStats(m, n["comment"], n["submission"], seconds) for m, n in sorted(counts.items())]
        return SearchResult(self.pattern, len(months), sum(s.comments_matched for s in stats), sum(s.submissions_matched for s in stats), seconds, stats)

    def assemble_results(self) -> dict[str, int]:
        return assemble_search_results(self.output_path, self.spark)


def assemble_search_results(output_path, spark: SparkSession | None = None) -> dict[str, int]:
    """All months' matches as comments.csv and submissions.csv with a month column first; unfinished months are left out."""
    spark, root = spark or session(), Path(output_path)
    months = [m for m in files.month_folders(root) if (root / m / "metadata.json").exists()]
    out = {}
    for kind, names in (("comment", schema.COMMENT_CSV), ("submission", schema.SUBMISSION_CSV)):
        rows = files.read_months(spark, root, months, kind)
        if rows is None:
            (root / f"{kind}s.csv").write_text(",".join(["month", *names]) + "\n")
            out[f"{kind}s"] = 0
        else:
            out[f"{kind}s"] = files.write_single(rows.select("month", *names), root / f"{kind}s.csv")
    return out
