"""Frames of comments and submissions with thread features, and the analyses over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import DELETED, REMOVED



def comments_frame(tree: DataFrame, comments: DataFrame, submissions: DataFrame, signals: DataFrame | None = None, fill_signals: bool = False) -> DataFrame:
    """A row for each comment of a thread: its columns, depth, walk_order, thread_size, time_since_submission and the
    submission's id, title, score and author; the month is the thread's. signals adds a column for each signal, null where
    none fired unless fill_signals."""
    drop = [c for c in ("month", "author", "created_utc", "line_no") if c in comments.columns]
    wide = comments.drop(*drop)
    about = submissions.select(F.col("id").alias("submission_id"), F.col("title").alias("submission_title"), F.col("score").alias("submission_score"), F.col("author").alias("submission_author"), F.col("created_utc").alias("_s"))
    out = tree.select("month", "submission_id", "id", "depth", "walk_order", "author", "created_utc", "thread_size").join(about, "submission_id").join(wide, "id")
    out = out.withColumn("time_since_submission", F.col("created_utc") - F.col("_s")).drop("_s")
    return with_signals(out, signals, "comment", fill_signals)


def submissions_frame(submissions: DataFrame, signals: DataFrame | None = None, fill_signals: bool = False) -> DataFrame:
    return with_signals(submissions, signals, "submission", fill_signals)


def with_signals(frame: DataFrame, signals: DataFrame | None, record_type: str, fill: bool = False) -> DataFrame:
    if signals is None:
        return frame
    names = [c for c in signals.columns if c not in ("record_id", "record_type")]
    if clash := set(names) & set(frame.columns):
        raise ValueError(f"signals are named as columns: {sorted(clash)}")
    own = signals.filter(F.col("record_type") == record_type).drop("record_type").withColumnRenamed("record_id", "id")
    out = frame.join(own, "id", "left")
    return out.fillna(False, names) if fill else out


def signal_rows(tree: DataFrame, comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """The rows that detectors see, comments and submissions alike."""
    text = lambda c, df: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
    flag = lambda df: (F.col("stickied") if "stickied" in df.columns else F.lit(False)).cast("boolean").alias("stickied")
    op = submissions.select(F.col("id").alias("submission_id"), F.col("author").alias("submission_author"))
    c = comments.select("id", "body", "score", "parent_id", flag(comments), text("distinguished", comments), text("removed_by_category", comments))
    c = tree.select("id", "submission_id", "depth", "walk_order", "author", "created_utc").join(c, "id").join(op, "submission_id")
    none = F.lit(None).cast("string")
    c = c.select(F.col("id").alias("record_id"), F.lit("comment").alias("record_type"), "author", "body", none.alias("title"), none.alias("selftext"), "score", "parent_id", "depth", "stickied", "distinguished", "removed_by_category", "submission_id", "submission_author", "created_utc", "walk_order")
    s = submissions.select(F.col("id").alias("record_id"), F.lit("submission").alias("record_type"), "author", none.alias("body"), text("title", submissions), text("selftext", submissions), "score", none.alias("parent_id"), F.lit(0).alias("depth"), flag(submissions), text("distinguished", submissions), text("removed_by_category", submissions), F.col("id").alias("submission_id"), F.col("author").alias("submission_author"), "created_utc", F.lit(-1).cast("bigint").alias("walk_order"))
    return c.unionByName(s)


def top(frame: DataFrame, n: int, by: str, tie: str = "id") -> DataFrame:
    """The n rows with the highest value; equal ones by the tie column."""
    return frame.orderBy(F.col(by).desc_nulls_last(), tie).limit(n)


def status(text: str = "selftext") -> Column:
    return F.when(F.col(text) == REMOVED, "removed").when(F.col(text) == DELETED, "deleted").otherwise("live")


def status_counts(frame: DataFrame, text: str = "selftext") -> DataFrame:
    return frame.groupBy(status(text).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def depth_histogram(frame: DataFrame) -> DataFrame:
    return frame.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def score_by_depth(frame: DataFrame) -> DataFrame:
    return frame.groupBy("depth").agg(F.avg("score").alias("mean_score"), F.median("score").alias("median_score"), F.count("score").alias("n"))


def response_hours(frame: DataFrame) -> DataFrame:
    """Count, mean, standard deviation, least, quartiles and greatest of hours until top-level comments."""
    h = F.col("time_since_submission") / 3600
    quartiles = [F.percentile(h, q).alias(k) for k, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    return frame.filter("depth = 0").agg(F.count(h).alias("n"), F.avg(h).alias("mean"), F.stddev_samp(h).alias("std"), F.min(h).alias("least"), *quartiles, F.max(h).alias("most"))


def signal_summary(frame: DataFrame, signal: str) -> DataFrame:
    """How many rows have the signal, and their mean depth and score."""
    return frame.filter(F.col(signal)).agg(F.count(F.lit(1)).alias("n"), F.avg("depth").alias("mean_depth"), F.avg("score").alias("mean_score"))


def signal_rate(frame: DataFrame, signal: str) -> DataFrame:
    """Per month: how often the signal fired, of how many rows that have it, in percent."""
    fired = F.count_if(F.col(signal))
    return frame.groupBy("month").agg(fired.alias("fired"), F.count(signal).alias("n"), F.round(100 * fired / F.count(signal), 2).alias("percent"))


def monthly_volume(frame: DataFrame) -> DataFrame:
    return frame.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


def in_degree(edges: DataFrame) -> DataFrame:
    """How many others reply to each author; edges as of graph.author_edges(), one for each pair."""
    return edges.groupBy("target").agg(F.count(F.lit(1)).alias("repliers"))


def prolific(frame: DataFrame, n: int = 10) -> DataFrame:
    return top(frame.groupBy("author").agg(F.count(F.lit(1)).alias("n")), n, "n", "author")


