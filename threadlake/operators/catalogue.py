"""Catalogue of communities and months, and index of communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import known_author


def catalogue(rows: DataFrame, min_activity: int = 1, approximate: bool = False) -> DataFrame:
    """Per (subreddit, month): submissions, comments, distinct known authors; rows as from authors.activity()."""
    author = F.when(known_author(), F.col("author"))
    distinct = F.approx_count_distinct(author) if approximate else F.count_distinct(author)
    counts = rows.filter(F.col("subreddit") != "").groupBy("subreddit", "month").agg(F.count_if(~F.col("is_comment")).alias("n_submissions"), F.count_if("is_comment").alias("n_comments"), distinct.alias("n_unique_authors"))
    return counts.filter(F.col("n_submissions") + F.col("n_comments") >= min_activity)


def month_index(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """Per (subreddit, month): the first id that isn't empty (submissions before comments, in file order), counts, whether
    any submission is over 18, and the most subscribers of a submission."""
    s = submissions.select("subreddit", "month", "subreddit_id", "line_no", F.lit(0).alias("rank"), F.coalesce("over_18", F.lit(False)).alias("over_18"), F.coalesce("subreddit_subscribers", F.lit(0)).cast("bigint").alias("subscribers"))
    c = comments.select("subreddit", "month", "subreddit_id", "line_no", F.lit(1).alias("rank"), F.lit(False).alias("over_18"), F.lit(0).cast("bigint").alias("subscribers"))
    named = F.col("subreddit_id") != ""
    first = F.min_by(F.when(named, F.col("subreddit_id")), F.when(named, F.struct("rank", "line_no")))
    return (
        s.unionByName(c)
        .filter(F.col("subreddit") != "")
        .groupBy("subreddit", "month")
        .agg(F.coalesce(first, F.lit("")).alias("subreddit_id"), F.count_if(F.col("rank") == 0).alias("n_submissions"), F.count_if(F.col("rank") == 1).alias("n_comments"), F.bool_or("over_18").alias("over_18"), F.max("subscribers").alias("subreddit_subscribers"))
    )


def community_index(monthly: DataFrame, min_records: int = 1) -> DataFrame:
    """Per subreddit over all months."""
    named = F.col("subreddit_id") != ""
    first = F.min_by(F.when(named, F.col("subreddit_id")), F.when(named, F.col("month")))
    out = monthly.groupBy("subreddit").agg(
        F.coalesce(first, F.lit("")).alias("subreddit_id"), F.sum("n_submissions").alias("n_submissions"), F.sum("n_comments").alias("n_comments"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.count("month").alias("months_active"), F.bool_or("over_18").alias("over_18"), F.max("subreddit_subscribers").alias("subreddit_subscribers"),
    )
    return out.filter(F.col("n_submissions") + F.col("n_comments") >= min_records)
