"""Boolean signals over threads: detectors are column expressions, so all of a preset run in one projection.

Rows come from frames.signal_rows(): record_type, author, body, title, selftext, score, parent_id, depth, stickied,
distinguished, removed_by_category, submission_author. A detector of one's own overrides comment() or submission(), or
comment_rows() for a function over pandas rows in Arrow batches where no expression will do.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import is_deleted, is_removed, is_top_level, known_author
from ..functions.regex import matches

ROW_COLUMNS = ("record_id", "record_type", "author", "body", "title", "selftext", "score", "parent_id", "depth", "stickied", "distinguished", "removed_by_category", "submission_id", "submission_author", "created_utc")


class Detector:
    """Fires for nothing, until a subclass says otherwise."""

    def __init__(self, name: str):
        self.name = name

    def comment(self) -> Column:
        return F.lit(False)

    def submission(self) -> Column:
        return F.lit(False)

    def column(self) -> Column:
        made = F.when(F.col("record_type") == "comment", self.comment()).otherwise(self.submission())
        return F.coalesce(made, F.lit(False)).alias(self.name)


class RowDetector(Detector):
    """A Python function from a row (a named tuple of ROW_COLUMNS) to bool; runs in Arrow batches."""

    def __init__(self, name: str, fn: Callable, record_type: str = "comment"):
        super().__init__(name)
        self.fn, self.record_type = fn, record_type

    def _made(self) -> Column:
        fn = self.fn

        @F.pandas_udf("boolean")
        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([bool(fn(r)) for r in rows.itertuples(index=False)], dtype=bool)

        return run(F.struct(*ROW_COLUMNS))

    def comment(self) -> Column:
        return self._made() if self.record_type in ("comment", "both") else F.lit(False)

    def submission(self) -> Column:
        return self._made() if self.record_type in ("submission", "both") else F.lit(False)


class RegexDetector(Detector):
    """Any of the fields, each by itself, has the pattern."""

    def __init__(self, name: str, pattern: str, record_type: str = "comment", fields: list[str] | None = None, case_sensitive: bool = False):
        super().__init__(name)
        if record_type not in ("comment", "submission", "both"):
            raise ValueError(f"record_type is comment, submission or both, not {record_type!r}")
        self.pattern, self.record_type, self.fields, self.case_sensitive = pattern, record_type, fields, case_sensitive
        matches(F.lit(""), pattern)

    def _any(self, default: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for f in self.fields or default:
            text = F.coalesce(F.col(f).cast("string"), F.lit("")) if f in ROW_COLUMNS else F.lit("")
            out = out | matches(text, self.pattern, self.case_sensitive)
        return out

    def comment(self) -> Column:
        return self._any(("body",)) if self.record_type in ("comment", "both") else F.lit(False)

    def submission(self) -> Column:
        return self._any(("title", "selftext")) if self.record_type in ("submission", "both") else F.lit(False)


class _Range(Detector):
    field = ""

    def __init__(self, name: str, low: int | None = None, high: int | None = None):
        super().__init__(name)
        if low is None and high is None:
            raise ValueError(f"{name}: give the least value, the greatest, or both")
        self.low, self.high = low, high

    def _within(self) -> Column:
        value = F.coalesce(F.col(self.field), F.lit(0))
        out = F.lit(True)
        if self.low is not None:
            out = out & (value >= self.low)
        if self.high is not None:
            out = out & (value <= self.high)
        return out


class ScoreDetector(_Range):
    """The score lies between two bounds, both included."""

    field = "score"

    def __init__(self, name: str, min_score: int | None = None, max_score: int | None = None, record_type: str = "both"):
        super().__init__(name, min_score, max_score)
        self.record_type = record_type

    def comment(self) -> Column:
        return self._within() if self.record_type in ("comment", "both") else F.lit(False)

    def submission(self) -> Column:
        return self._within() if self.record_type in ("submission", "both") else F.lit(False)


class DepthDetector(_Range):
    """The depth of a comment lies between two bounds, both included."""

    field = "depth"

    def __init__(self, name: str, min_depth: int | None = None, max_depth: int | None = None):
        super().__init__(name, min_depth, max_depth)

    def comment(self) -> Column:
        return self._within()


class AuthorIsOPDetector(Detector):
    def comment(self) -> Column:
        return known_author("submission_author") & (F.col("author") == F.col("submission_author"))


class StickiedCommentDetector(Detector):
    def comment(self) -> Column:
        return F.coalesce("stickied", F.lit(False))


class ModDistinguishedDetector(Detector):
    def comment(self) -> Column:
        return F.col("distinguished").isNotNull()

    submission = comment


class ContentRemovedDetector(Detector):
    def comment(self) -> Column:
        return is_removed("body")

    def submission(self) -> Column:
        return is_removed("selftext")


class AuthorDeletedDetector(Detector):
    def comment(self) -> Column:
        return is_deleted("body")

    def submission(self) -> Column:
        return is_deleted("selftext")


class TopLevelCommentDetector(Detector):
    """By parent_id: a comment that became a root for want of its parent isn't top-level."""

    def comment(self) -> Column:
        return is_top_level()


class DeltaAwardedDetector(Detector):
    def comment(self) -> Column:
        body = F.coalesce("body", F.lit(""))
        return body.contains("Δ") | F.lower(body).contains("!delta")


class AITAVerdictDetector(Detector):
    def comment(self) -> Column:
        return matches(F.coalesce("body", F.lit("")), r"\b(NTA|YTA|ESH|NAH|INFO)\b")


_GENERAL = (("stickied_comment", StickiedCommentDetector), ("mod_distinguished", ModDistinguishedDetector), ("content_removed", ContentRemovedDetector), ("author_deleted", AuthorDeletedDetector), ("top_level_comment", TopLevelCommentDetector), ("op_comment", AuthorIsOPDetector))
_MORE = {"general": None, "cmv": ("delta_awarded", DeltaAwardedDetector), "aita": ("aita_verdict", AITAVerdictDetector)}
_SAME = {"changemyview": "cmv", "amitheasshole": "aita"}


def get_detectors(preset: str = "general") -> list[Detector]:
    """The detectors of a preset: general, cmv (changemyview) or aita (amitheasshole)."""
    key = preset.strip().lower()
    key = _SAME.get(key, key)
    if key not in _MORE:
        raise ValueError(f"no preset {preset!r}; there are {', '.join([*_MORE, *_SAME])}")
    return [kind(name) for name, kind in (*_GENERAL, *([_MORE[key]] if _MORE[key] else []))]


def check(detectors: list[Detector]) -> None:
    names = [d.name for d in detectors]
    if not names:
        raise ValueError("no detectors")
    if len(set(names)) < len(names):
        raise ValueError(f"detectors share names: {names}")
    if clash := set(names) & set(ROW_COLUMNS):
        raise ValueError(f"detectors are named as columns: {sorted(clash)}")


def detect(rows: DataFrame, detectors: list[Detector], keep: tuple[str, ...] = ()) -> DataFrame:
    """record_id, record_type, the columns to keep, and a column for each detector, for the rows where any fires."""
    check(detectors)
    out = rows.select("record_id", "record_type", *keep, *[d.column() for d in detectors])
    fired = F.lit(False)
    for d in detectors:
        fired = fired | F.col(f"`{d.name}`")
    return out.filter(fired)
