"""Columns computed from records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETED, REMOVED = "[deleted]", "[removed]"


def created_datetime(c: str = "created_utc") -> Column:
    return F.timestamp_seconds(F.col(c))


def month_of(c: str = "created_utc") -> Column:
    return F.date_format(F.timestamp_seconds(F.col(c)), "yyyy-MM")


def is_deleted(text: str) -> Column:
    """text: body of comments, selftext of submissions."""
    return F.coalesce(F.col("author") == DELETED, F.lit(False)) | F.coalesce(F.col(text) == DELETED, F.lit(False))


def is_removed(text: str) -> Column:
    return F.coalesce(F.col(text) == REMOVED, F.lit(False)) | F.col("removed_by_category").isNotNull()


def is_top_level() -> Column:
    return F.coalesce(F.col("parent_id").startswith("t3_"), F.lit(False))


def submission_id() -> Column:
    return F.regexp_replace("link_id", "^t3_", "")


def parent_comment_id() -> Column:
    return F.when(F.col("parent_id").startswith("t1_"), F.expr("substring(parent_id, 4)"))


def permalink(kind: str) -> Column:
    if kind == "comment":
        made = F.concat(F.lit("/r/"), F.col("subreddit"), F.lit("/comments/"), submission_id(), F.lit("/_/"), F.col("id"), F.lit("/"))
    else:
        made = F.concat(F.lit("/r/"), F.col("subreddit"), F.lit("/comments/"), F.col("id"), F.lit("/"))
    return F.when(F.length("permalink") > 0, F.col("permalink")).otherwise(made)


def search_text(kind: str) -> Column:
    """Title and selftext of submissions, body of comments; never null."""
    if kind == "comment":
        return F.coalesce(F.col("body"), F.lit(""))
    return F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" "), F.coalesce(F.col("selftext"), F.lit("")))


def known_author(c: str = "author") -> Column:
    """Neither null, empty nor deleted."""
    return F.coalesce((F.col(c) != "") & (F.col(c) != DELETED), F.lit(False))


def filled_author(c: str = "author") -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(DELETED))


def number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
