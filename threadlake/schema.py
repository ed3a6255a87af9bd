"""Record schemas: a fixed core with coercions and defaults, and the raw line as carrier of everything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name:kind[=default]; s string, t string that is never other than text, l bigint, d double, b boolean, j JSON text, e edited.
_COMMON = """
id:s name:t author:t=[deleted] author_flair_text:s author_flair_css_class:s author_fullname:s subreddit:t= subreddit_id:t
subreddit_name_prefixed:s subreddit_type:s created_utc:l=0 retrieved_on:l edited:e score:l=0 stickied:b=false locked:b=false
archived:b=false distinguished:s removed_by_category:s gilded:l=0 total_awards_received:l permalink:s
"""
_COMMENT = "link_id:t= parent_id:t= body:t= controversiality:l=0 collapsed:b collapsed_reason:s is_submitter:b=false"
_SUBMISSION = """
subreddit_subscribers:l title:t= selftext:t= url:t domain:s thumbnail:s upvote_ratio:d num_comments:l=0 num_crossposts:l
is_self:b=true is_video:b=false is_original_content:b=false is_reddit_media_domain:b=false is_meta:b=false is_crosspostable:b
is_robot_indexable:b over_18:b=false spoiler:b=false full_link:s crosspost_parent:s crosspost_parent_list:j media:j
media_embed:j secure_media:j secure_media_embed:j preview:j gallery_data:j media_metadata:j link_flair_text:s
link_flair_css_class:s link_flair_type:s link_flair_template_id:s contest_mode:b=false suggested_sort:s post_hint:s category:s
"""


def _fields(*texts: str) -> dict[str, tuple[str, str | None]]:
    out = {}
    for item in " ".join(texts).split():
        name, _, kind = item.partition(":")
        kind, eq, default = kind.partition("=")
        out[name] = (kind, default if eq else None)
    return out


FIELDS = {"comment": _fields(_COMMON, _COMMENT), "submission": _fields(_COMMON, _SUBMISSION)}
#: Column order of the CSV files.
COMMENT_CSV = (
    "id created_utc author subreddit body score link_id parent_id permalink controversiality stickied distinguished "
    "is_submitter gilded author_flair_text subreddit_id edited archived locked removed_by_category total_awards_received"
).split()
SUBMISSION_CSV = (
    "id created_utc author subreddit title selftext score num_comments url domain permalink is_self over_18 spoiler stickied "
    "locked upvote_ratio gilded distinguished author_flair_text link_flair_text subreddit_id subreddit_subscribers edited "
    "archived removed_by_category total_awards_received crosspost_parent"
).split()


def _bigint(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))


def _typed(name: str, kind: str, default: str | None, keys: Column) -> Column:
    c = F.col(f"_r.{name}")
    if kind == "l":
        out = _bigint(c)
    elif kind == "d":
        out = c.try_cast("double")
    elif kind == "b":
        out = F.when(c.rlike(r"^-?[0-9.]+$"), c.try_cast("double") != 0).otherwise(c.try_cast("boolean"))
    else:
        out = c
    if default is not None:
        value = F.lit(default).cast({"l": "bigint", "b": "boolean"}.get(kind, "string"))
        if name == "author":  # a missing author differs from one that is null
            return F.when(F.array_contains(keys, name), out).otherwise(value)
        out = F.coalesce(out, value)
    return out


def parse(lines: DataFrame, kind: str) -> DataFrame:
    """Typed records of raw JSON lines (column value), other columns kept. kind: comment or submission.

    All fields are read as text and cast, so files of different years agree. Lines that aren't JSON objects, and those
    without an id, are dropped. The raw line stays in column raw. edited becomes its text, with is_edited and edited_utc.
    """
    fields = FIELDS[kind]
    schema = ", ".join(f"`{f}` STRING" for f in fields)
    rest = [c for c in lines.columns if c != "value"]
    parsed = lines.filter(F.ltrim("value").startswith("{")).withColumn("_r", F.from_json("value", schema)).filter("_r.id IS NOT NULL")
    keys = F.json_object_keys("value")
    cols = [_typed(n, k, d, keys).alias(n) for n, (k, d) in fields.items()]
    edited = F.col("_r.edited")
    extra = [
        (edited.isNotNull() & ~F.lower(edited).isin("false", "0")).alias("is_edited"),
        F.when(~F.lower(edited).isin("true", "false"), _bigint(edited)).alias("edited_utc"),
        F.col("value").alias("raw"),
    ]
    return parsed.select(*rest, *cols, *extra)


def extras(records: DataFrame, kind: str, to: str = "extra") -> DataFrame:
    """Adds a map of the raw line's keys outside the fixed core to their JSON texts."""
    known = F.array(*[F.lit(f) for f in FIELDS[kind]])
    every = F.from_json("raw", "map<string,string>")
    return records.withColumn(to, F.map_filter(every, lambda k, _: ~F.array_contains(known, k)))
