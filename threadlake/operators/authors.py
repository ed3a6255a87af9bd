"""Author statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import filled_author, known_author, number


def activity(comments: DataFrame | None, submissions: DataFrame | None) -> DataFrame:
    """Both kinds as (subreddit, month, author, score, created_utc, is_comment)."""
    parts = []
    for df, is_comment in ((comments, True), (submissions, False)):
        if df is not None:
            parts.append(df.select("subreddit", "month", F.col("author"), number("score").alias("score"), number("created_utc").alias("created_utc"), F.lit(is_comment).alias("is_comment")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sums() -> list[Column]:
    c = F.col("is_comment")
    zero = F.lit(0).cast("bigint")
    return [
        F.count_if(c).alias("comment_count"),
        F.count_if(~c).alias("submission_count"),
        F.coalesce(F.sum(F.when(c, F.col("score"))), zero).alias("comment_score_total"),
        F.coalesce(F.sum(F.when(~c, F.col("score"))), zero).alias("submission_score_total"),
        F.min("created_utc").alias("first_seen_utc"),
        F.max("created_utc").alias("last_seen_utc"),
    ]


def average(total: str, count: str, digits: int | None = 2) -> Column:
    """Null where the count is 0."""
    out = F.when(F.col(count) > 0, F.col(total) / F.col(count))
    return out if digits is None else F.round(out, digits)


def with_averages(stats: DataFrame, digits: int | None = 2) -> DataFrame:
    return stats.withColumns({"avg_comment_score": average("comment_score_total", "comment_count", digits), "avg_submission_score": average("submission_score_total", "submission_count", digits)})


def by_month(rows: DataFrame, digits: int | None = 2) -> DataFrame:
    """Per (subreddit, month, author); rows as from activity(). Missing authors count as deleted."""
    return with_averages(rows.withColumn("author", filled_author()).groupBy("subreddit", "month", "author").agg(*_sums()), digits)


def by_community(monthly: DataFrame, digits: int | None = 2) -> DataFrame:
    """Per (subreddit, author) from the monthly statistics; a time of 0 counts as unknown, hence null."""
    sums = [F.sum(c).alias(c) for c in ("comment_count", "submission_count", "comment_score_total", "submission_score_total")]
    times = [F.nullif(F.min("first_seen_utc"), F.lit(0)).alias("first_seen_utc"), F.nullif(F.max("last_seen_utc"), F.lit(0)).alias("last_seen_utc")]
    return with_averages(monthly.groupBy("subreddit", "author").agg(*sums, *times, F.count_distinct("month").alias("months_active")), digits)


def across_communities(stats: DataFrame, min_subreddits: int = 2) -> DataFrame:
    """The rows of authors known in at least so many communities."""
    stats = stats.filter(known_author())
    # stats have a row for each author and community, far fewer than records: one shuffle by author, nothing computed twice
    several = F.size(F.collect_set("subreddit").over(Window.partitionBy("author")))
    return stats.withColumn("_n", several).filter(F.col("_n") >= min_subreddits).drop("_n")


def across_summary(stats: DataFrame, min_subreddits: int = 2) -> DataFrame:
    """One row for each such author, with the communities joined by |."""
    names = F.array_join(F.array_sort(F.collect_set("subreddit")), "|")
    return (
        stats.filter(known_author())
        .groupBy("author")
        .agg(
            F.count_distinct("subreddit").alias("n_subreddits"), names.alias("subreddits"), F.sum("comment_count").alias("total_comments"), F.sum("submission_count").alias("total_submissions"),
            F.sum("months_active").alias("total_months_active"), F.min("first_seen_utc").alias("first_seen_utc"), F.max("last_seen_utc").alias("last_seen_utc"),
        )
        .filter(F.col("n_subreddits") >= min_subreddits)
    )
