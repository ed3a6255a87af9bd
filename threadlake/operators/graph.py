"""Conversation graph and author graph, from a tree as of tree.build()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import known_author, number


def comment_nodes(tree: DataFrame, submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """node_id, type, author, score, created_utc, depth: submissions at 0, comments one below their place in the tree."""
    top = submissions.select(F.concat(F.lit("t3_"), "id").alias("node_id"), F.lit("submission").alias("type"), "author", number("score").alias("score"), number("created_utc").alias("created_utc"), F.lit(0).alias("depth"))
    scores = comments.select("id", number("score").alias("score"))
    below = tree.join(scores, "id").select(F.concat(F.lit("t1_"), "id").alias("node_id"), F.lit("comment").alias("type"), "author", "score", "created_utc", (F.col("depth") + 1).alias("depth"))
    return top.unionByName(below)


def comment_edges(tree: DataFrame) -> DataFrame:
    """source (parent), target (comment), time_delta in seconds."""
    source = F.when(F.col("parent").isNull(), F.concat(F.lit("t3_"), "submission_id")).otherwise(F.concat(F.lit("t1_"), "parent"))
    return tree.select(source.alias("source"), F.concat(F.lit("t1_"), "id").alias("target"), (F.col("created_utc") - F.col("parent_created_utc")).alias("time_delta"))


def author_nodes(tree: DataFrame, submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """Per known author: comment_count, total_score with that of submissions, first and last time."""
    scores = comments.select("id", number("score").alias("score"))
    said = tree.join(scores, "id").select("author", "score", "created_utc", F.lit(1).alias("n"))
    asked = submissions.select("author", number("score").alias("score"), number("created_utc").alias("created_utc"), F.lit(0).alias("n"))
    rows = said.unionByName(asked).filter(known_author())
    return rows.groupBy("author").agg(F.sum("n").cast("bigint").alias("comment_count"), F.sum("score").alias("total_score"), F.min("created_utc").alias("first_seen_utc"), F.max("created_utc").alias("last_seen_utc"))


def author_edges(tree: DataFrame) -> DataFrame:
    """Per (source, target), who replies and to whom: weight, first_interaction_utc; replies to oneself stay."""
    rows = tree.filter(known_author("author") & known_author("parent_author"))
    return rows.groupBy(F.col("author").alias("source"), F.col("parent_author").alias("target")).agg(F.count(F.lit(1)).alias("weight"), F.min("created_utc").alias("first_interaction_utc"))
