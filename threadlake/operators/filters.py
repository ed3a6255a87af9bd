"""Filters over records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import search_text
from ..functions.regex import any_of, matches


def communities(records: DataFrame, names: list[str]) -> DataFrame:
    """Records of the named communities, whatever the case; a leading r/ in a name is ignored."""
    wanted = sorted({n.lower().removeprefix("r/") for n in names})
    return records.filter(F.lower("subreddit").isin(wanted))


def keywords(records: DataFrame, kind: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Records whose text has any of include, if there are such, and none of exclude."""
    text = search_text(kind)
    if include:
        records = records.filter(any_of(text, include))
    if exclude:
        records = records.filter(~any_of(text, exclude))
    return records


def search(records: DataFrame, kind: str, pattern: str, case_sensitive: bool = False, raw_first: bool = False) -> DataFrame:
    """Records whose text has the pattern; with raw_first only those whose raw JSON line has it too."""
    if raw_first:
        records = records.filter(matches(F.col("raw"), pattern, case_sensitive))
    return records.filter(matches(search_text(kind), pattern, case_sensitive))


def months(records: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Records with month from start to end, both included; a partition filter where month is a partition."""
    if start:
        records = records.filter(F.col("month") >= start)
    if end:
        records = records.filter(F.col("month") <= end)
    return records


def first_by_id(records: DataFrame, record_id: str) -> DataFrame:
    """The record with that id that comes first by month and line; no rows if there is none."""
    return records.filter(F.col("id") == record_id).orderBy("month", "line_no").limit(1)


def last_wins(records: DataFrame, key: str = "id", order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """One record for each key, the last by order; partial aggregation before the shuffle, no window."""
    best = F.max_by(F.struct(*[F.col(c) for c in records.columns]), F.struct(*[F.col(c) for c in order]))
    return records.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")
