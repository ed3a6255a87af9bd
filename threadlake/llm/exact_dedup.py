r"""Exact deduplication by 128-bit content hash, with comparison of bytes inside groups.

Texts are equal when identical after each run `[\x20\x09-\x0D]+` has become one space. The plan: (1) group by (hash,
normalised text), with partial aggregation before the shuffle, so a hot group of copies reaches the shuffle as one row a
map task and equality of bytes is decided by the grouping itself; the result has the smallest id, the number of rows and
SHA-256 for each distinct text. (2) Join rows to groups by hash; the few keys that may be hot are broadcast, at most
common.HOT_SHARE of them. (3) Only where one hash covers different texts, which is counted first, rows are joined by
(hash, normalised text) instead.

Defined results: null counts as the empty text, and all empty texts form one group; the smallest id stays, so there are
no ties; rows repeated with one id are reported as often as they occur, each kept if the id is; an empty table gives an
empty result; extra columns of the input are not read by classify() and pass through exact_dedup() whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_unique, materialize

#: Every run of white space that isn't already one plain space.
_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = hash128) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256. hash_fn is a parameter so that tests can force collisions."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm")).withColumn("_h", hash_fn(F.col("_norm")))
    groups = rows.groupBy("_h", "_norm").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.withColumn("_sha", F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)))
    groups = materialize(groups.select("_h", "_sha", "keep_id", "group_size"), "exact-groups")
    per_hash = groups.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts"))
    clash = per_hash.filter("_texts > 1").select("_h")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).head()[0]
    if not clash.head(1):
        out = join_unique(rows.select("_id", "_h"), groups, "_h", "group_size", total)
    else:  # one hash, several texts: their SHA-256, made from the same bytes, is part of the key
        keyed = rows.withColumn("_sha", F.unhex(F.sha2(F.col("_norm").cast("binary"), 256))).select("_id", F.concat("_h", "_sha").alias("_key"))
        out = join_unique(keyed, groups.withColumn("_key", F.concat("_h", "_sha")), "_key", "group_size", total)
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one for each distinct text, with all their columns."""
    keep = classify(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_keep")).distinct()
    return docs.join(keep.hint("shuffle_hash"), docs[id_col] == keep["_keep"], "left_semi")
