"""An extracted community: trees, signals, frames, graphs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, frames, graph, signals, tree
from ..session import session
from ..sources import files, parts
from ..sources.tables import materialize

#: What trees and graphs need of records, and what detectors see besides.
COMMENT_CORE = ("month", "line_no", "id", "link_id", "parent_id", "author", "created_utc", "score")
SUBMISSION_CORE = ("month", "line_no", "id", "author", "created_utc", "score", "title")
_SEEN = ("stickied", "distinguished", "removed_by_category")


@dataclass
class SubredditMetadata:
    subreddit: str = ""
    months: list[str] = field(default_factory=list)
    total_submissions: int = 0
    total_comments: int = 0
    extracted_at: str = ""
    output_format: str = ""

    @classmethod
    def from_dict(cls, data: dict) -> SubredditMetadata:
        return cls(**{k: data[k] for k in cls.__dataclass_fields__ if k in data})


class SubredditData:
    """Access to an extracted community; frames are Spark DataFrames, toPandas() gives pandas ones."""

    def __init__(self, path, spark: SparkSession | None = None, link_scope: str = "month"):
        self.path, self.spark, self.link_scope = Path(path), spark or session(), link_scope
        if not self.path.exists():
            raise ValueError(f"there is no folder {path}")
        about = files.read_json(self.path / "metadata.json")
        self.metadata = SubredditMetadata.from_dict(about) if about else SubredditMetadata(self.path.name, files.month_folders(self.path), output_format="unknown")

    @property
    def subreddit(self) -> str:
        return self.metadata.subreddit

    @property
    def months(self) -> list[str]:
        return self.metadata.months

    def _records(self, kind: str, month: str | None) -> DataFrame:
        out = files.read_months(self.spark, self.path, [month] if month else self.months, kind)
        if out is None:
            raise ValueError(f"{self.path} has no {kind}s" + (f" for {month}" if month else ""))
        return out

    def comments(self, month: str | None = None) -> DataFrame:
        return self._records("comment", month)

    def submissions(self, month: str | None = None) -> DataFrame:
        return self._records("submission", month)

    all_comments, all_submissions = comments, submissions

    def tree(self, month: str | None = None) -> DataFrame:
        return tree.build(self.comments(month), self.submissions(month), self.link_scope)

    def _once(self, month: str | None, *columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(comments, submissions, tree), of records with one id the last; over all months an id counts once. With the columns that
        are wanted of comments and of submissions, files are parsed once and records shuffled without all others."""
        both = [self.comments(month), self.submissions(month)]
        if columns:
            both = [df.select(*names) for df, names in zip(both, columns)]
        c, s = (filters.last_wins(df, "id", ("month", "line_no")) for df in both)
        if columns:
            c, s = materialize(c, "comments"), materialize(s, "submissions")
        return c, s, tree.build(c, s, self.link_scope)

    def threads(self, month: str | None = None) -> DataFrame:
        """month, submission_id, value: a thread's nested JSON."""
        return tree.nested(self.tree(month), self.comments(month), self.submissions(month), self.link_scope)

    def get_submission(self, submission_id: str) -> dict | None:
        rows = filters.first_by_id(self.submissions(), submission_id).collect()
        return json.loads(rows[0]["raw"]) if rows else None

    def get_thread(self, submission_id: str) -> dict | None:
        rows = self.threads().filter(F.col("submission_id") == submission_id).orderBy("month").limit(1).collect()
        return json.loads(rows[0]["value"]) if rows else None

    def submission_count(self, month: str | None = None) -> int:
        return self.submissions(month).count()

    def comment_count(self, month: str | None = None) -> int:
        return self.comments(month).count()

    def month_stats(self, month: str) -> dict:
        found = files.read_json(self.path / month / "metadata.json")
        return found or {"month": month, "submissions_count": self.submission_count(month), "comments_count": self.comment_count(month)}

    def signals(self, month: str | None = None) -> DataFrame | None:
        out = None
        for m in [month] if month else self.months:
            path = self.path / m / "signals.csv"
            if path.exists():
                part = files.read_csv(self.spark, path)
                part = part.select("record_id", "record_type", *[F.col(f"`{c}`").cast("boolean").alias(c) for c in part.columns[2:]])
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def comments_dataframe(self, month: str | None = None, signals: bool = True, fill_signals: bool = False) -> DataFrame:
        c, s, t = self._once(month)
        return frames.comments_frame(t, c, s, self.signals(month) if signals else None, fill_signals)

    def submissions_dataframe(self, month: str | None = None, signals: bool = True, fill_signals: bool = False) -> DataFrame:
        return frames.submissions_frame(self.submissions(month), self.signals(month) if signals else None, fill_signals)

    def export_comment_graph(self, output_dir, month: str | None = None) -> dict[str, int]:
        c, s, t = self._once(month, COMMENT_CORE, SUBMISSION_CORE)
        out, t = Path(output_dir), materialize(t, "tree")
        return {"nodes": files.write_single(graph.comment_nodes(t, s, c), out / "comment_graph_nodes.csv"), "edges": files.write_single(graph.comment_edges(t), out / "comment_graph_edges.csv")}

    def export_author_graph(self, output_dir, month: str | None = None) -> dict[str, int]:
        c, s, t = self._once(month, COMMENT_CORE, SUBMISSION_CORE)
        out, t = Path(output_dir), materialize(t, "tree")
        return {"nodes": files.write_single(graph.author_nodes(t, s, c), out / "author_graph_nodes.csv", order=["author"]), "edges": files.write_single(graph.author_edges(t), out / "author_graph_edges.csv", order=["source", "target"])}


def load_subreddit(path, spark: SparkSession | None = None) -> SubredditData:
    return SubredditData(path, spark)


class TreeBuilder:
    """Writes threads.jsonl.gz for the months of an extracted community. db_path is accepted: with it comments link to
    submissions of all months."""

    def __init__(self, extracted_path, db_path=None, spark: SparkSession | None = None):
        self.data = SubredditData(extracted_path, spark, "all" if db_path else "month")

    def build_month(self, month: str) -> int:
        if not (self.data.path / month / "submissions.jsonl.gz").exists():
            return 0
        c = files.read_month(self.data.spark, self.data.path, month, "comment")
        s = self.data.submissions(month)
        if c is None:
            c = files.schema.parse(s.limit(0).select(F.col("raw").alias("value"), "month", "line_no"), "comment")
        rows = tree.nested(tree.build(c, s, self.data.link_scope), c, s, self.data.link_scope)
        return files.write_single(rows.select("value"), self.data.path / month / "threads.jsonl.gz", "text")

    def build_all_months(self) -> dict[str, int]:
        return {m: self.build_month(m) for m in files.month_folders(self.data.path)}


def load_threads(path, spark: SparkSession | None = None) -> DataFrame:
    """The nested threads of a file, a JSON text each in column value."""
    return parts.read_lines(spark or session(), path).filter(F.trim("value") != "")


def scan_threads(path, spark: SparkSession | None = None) -> DataFrame:
    """The records of a file of nested threads as rows in walk order, as of tree.flat()."""
    return tree.flat(load_threads(path, spark))


def in_walk_order(found: DataFrame, submissions: DataFrame) -> DataFrame:
    """Signals (with submission_id and walk_order) in the order of submissions, each before its comments as the walk meets them."""
    place = submissions.groupBy(F.col("id").alias("submission_id")).agg(F.max("line_no").alias("_line"))
    rows = found.join(place, "submission_id", "left").orderBy("_line", "submission_id", "walk_order", "record_id")
    return rows.drop("_line", "submission_id", "walk_order")


class SignalDetector:
    """Runs detectors over an extracted community's threads and writes signals.csv for each month."""

    def __init__(self, extracted_path, detectors: list[signals.Detector], spark: SparkSession | None = None):
        signals.check(detectors)
        self.detectors, self.data = detectors, SubredditData(extracted_path, spark)

    def detect(self, month: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        c, s, t = self.data._once(month, (*COMMENT_CORE, "body", *_SEEN), (*SUBMISSION_CORE, "selftext", *_SEEN))
        return signals.detect(frames.signal_rows(t, c, s), self.detectors, keep)

    def run_month(self, month: str) -> int:
        if not (self.data.path / month / "submissions.jsonl.gz").exists():
            return 0
        found = materialize(self.detect(month, ("submission_id", "walk_order")), "signals")  # sorting reads it twice
        found = in_walk_order(found, self.data.submissions(month))
        return files.write_single(found, self.data.path / month / "signals.csv")

    def run_all_months(self) -> dict[str, int]:
        return {m: self.run_month(m) for m in self.data.months}
