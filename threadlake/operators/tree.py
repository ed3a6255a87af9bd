"""Reply trees.

Rows go to Python with ids, times and authors only, partitioned and sorted by thread. A part of whole threads is walked at
once, with arrays: parents are found by one sort, depths by following parents twice as far each round, and the order of a
depth-first walk from the sizes of subtrees. Comments without their parent in the thread become roots; those on a cycle, or
below one, are reached from no root and vanish.

Threads of more than LARGE comments are few and may be larger than a task: their walk is a list of both visits of each
comment, ranked by Spark joins that jump twice as far each round.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .filters import last_wins

#: Rows walked at once, about; and comments of a thread that a task walks at most.
PART = 50_000
LARGE = 1_000_000

_NAMES = ["month", "submission_id", "id", "parent", "depth", "walk_order", "author", "created_utc", "parent_author", "parent_created_utc", "thread_size"]
_OUT = "month string, submission_id string, id string, parent string, depth int, walk_order bigint, author string, created_utc bigint, parent_author string, parent_created_utc bigint, thread_size bigint"


def _changes(rows: pa.Table) -> np.ndarray:
    """Whether a row's thread differs from the row's before."""
    out = np.ones(len(rows), bool)
    if len(rows) > 1:
        differ = [pc.fill_null(pc.not_equal(rows.column(k).slice(1), rows.column(k).slice(0, len(rows) - 1)), True) for k in (0, 1)]
        out[1:] = pc.or_(*differ).to_numpy(zero_copy_only=False)
    return out


def walk(thread: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, place in the walk and thread size of each row, depth -1 where no root leads to it. Rows are grouped by thread (numbers
    that ascend) with siblings in order; parent is the parent's row or -1."""
    n = len(thread)
    up, depth = parent.copy(), (parent >= 0).astype(np.int64)
    for _ in range(max(1, n.bit_length()) + 1):
        far = up >= 0
        if not far.any():
            break
        depth[far] += depth[up[far]]
        up[far] = up[up[far]]
    depth[up >= 0] = -1
    size = (depth >= 0).astype(np.int64)
    order = np.argsort(depth, kind="stable")
    edge = np.searchsorted(depth[order], np.arange(int(depth.max(initial=-1)) + 2))
    levels = [order[a:b] for a, b in zip(edge, edge[1:])]
    for level in levels[:0:-1]:
        np.add.at(size, parent[level], size[level])
    place = np.zeros(n, np.int64)
    for k, level in enumerate(levels):
        # siblings stand in order: what earlier ones hold comes before
        group = thread[level] if not k else parent[level]
        by = np.argsort(group, kind="stable")
        own, group = size[level][by], group[by]
        before = np.cumsum(own) - own
        first = np.append(True, group[1:] != group[:-1])
        before -= before[first][np.cumsum(first) - 1]
        place[level[by]] = before + (place[group] + 1 if k else 0)
    total = np.bincount(thread, depth >= 0, int(thread.max(initial=0)) + 1).astype(np.int64) if n else np.zeros(0, np.int64)
    return depth, place, total[thread]


def _walked(rows: pa.Table) -> pa.RecordBatch:
    """rows of whole threads: month, sid, id, parent_id, author, created, s_author, s_created, siblings in order."""
    thread = np.cumsum(_changes(rows)) - 1
    ids = rows.column(2).combine_chunks().dictionary_encode()
    number = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    said = rows.column(3).combine_chunks()
    target = pc.index_in(pc.if_else(pc.starts_with(said, "t1_"), pc.utf8_slice_codeunits(said, 3), None), value_set=ids.dictionary, skip_nulls=True)
    wanted = pc.fill_null(target, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(ids.dictionary))
    key = thread * width + number
    by = np.argsort(key)
    look = thread * width + wanted
    at = np.minimum(np.searchsorted(key[by], look), max(0, len(key) - 1))
    parent = np.where((wanted >= 0) & (key[by][at] == look), by[at], -1)
    depth, place, size = walk(thread, parent)
    kept = np.flatnonzero(depth >= 0)
    out = rows.take(pa.array(kept))
    up = pa.array(parent[kept], mask=parent[kept] < 0)
    above = lambda mine, of_root: pc.if_else(pc.is_valid(up), rows.column(mine).take(up), out.column(of_root))
    cols = [out.column(0), out.column(1), out.column(2), rows.column(2).take(up), pa.array(depth[kept].astype(np.int32)), pa.array(place[kept]), out.column(4), out.column(5), above(4, 6), above(5, 7), pa.array(size[kept])]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=_NAMES)


def _threads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PART:
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(rows))[-1])  # the last thread may go on
            if last:
                yield _walked(rows.slice(0, last))
            held, n = rows.slice(last).combine_chunks().to_batches(), 0
    if held and sum(b.num_rows for b in held):
        yield _walked(pa.Table.from_batches(held))


def _ranked(rows: DataFrame) -> DataFrame:
    """The same for large threads, by list ranking: each comment is visited on the way down and on the way up, every visit
    points to the next, and pointers are followed twice as far each round."""
    thread = ["month", "submission_id"]
    parent = F.when(F.col("parent_id").startswith("t1_"), F.expr("substring(parent_id, 4)"))
    c = rows.withColumn("p", parent)
    known = c.select(*thread, F.col("id").alias("p"), F.lit(True).alias("met"))
    c = c.join(known, [*thread, "p"], "left").withColumn("p", F.when(F.col("met"), F.col("p"))).drop("met")
    c = materialize(c, "large-threads")
    order = Window.partitionBy(*thread, "p").orderBy("created_utc", "line_no")
    c = c.withColumns({"after": F.lead("id").over(order), "rank": F.row_number().over(order)})
    child = c.filter("rank = 1 AND p IS NOT NULL").select(*thread, F.col("p").alias("id"), F.col("id").alias("child"))
    c = materialize(c.join(child, [*thread, "id"], "left"), "large-siblings")
    visit = lambda way, name: F.concat(F.lit(way), F.col(name))
    down = c.select(*thread, visit("d", "id").alias("v"), F.coalesce(visit("d", "child"), visit("u", "id")).alias("next"), F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("net"))
    up = c.select(*thread, visit("u", "id").alias("v"), F.coalesce(visit("d", "after"), visit("u", "p")).alias("next"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("net"))
    jumps = materialize(down.unionByName(up), "large-visits")
    total, rounds = jumps.count(), 0
    while rounds <= total.bit_length() and jumps.filter("next IS NOT NULL").head(1):  # a cycle never ends
        far = jumps.select(*thread, F.col("v").alias("next"), F.col("next").alias("beyond"), F.col("n").alias("n2"), F.col("net").alias("net2"))
        jumps = jumps.join(far, [*thread, "next"], "left")
        jumps = materialize(jumps.select(*thread, "v", F.col("beyond").alias("next"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("net") + F.coalesce("net2", F.lit(0))).alias("net")), "large-visits")
        rounds += 1
    # sums from a visit to the end: n comments are still to come, and depth + 1 visits down are missing
    ends = jumps.filter("next IS NULL AND v LIKE 'd%'").select(*thread, F.expr("substring(v, 2)").alias("id"), "n", "net")
    sizes = ends.groupBy(*thread).agg(F.max("n").alias("thread_size"))
    done = c.join(ends, [*thread, "id"]).join(sizes, thread)
    above = c.select(*thread, F.col("id").alias("p"), F.col("author").alias("pa"), F.col("created_utc").alias("pt"))
    done = done.join(above, [*thread, "p"], "left")
    isroot = F.col("p").isNull()
    return done.select(*thread, "id", F.col("p").alias("parent"), F.col("net").alias("_net"), (F.col("thread_size") - F.col("n")).alias("walk_order"), "author", "created_utc", F.when(isroot, F.col("s_author")).otherwise(F.col("pa")).alias("parent_author"), F.when(isroot, F.col("s_created")).otherwise(F.col("pt")).alias("parent_created_utc"), "thread_size").withColumn("depth", (-F.col("_net")).cast("int")).select(*_NAMES)


def _scope(link_scope: str):
    """The column by which records link: their month, or one text for all."""
    if link_scope not in ("month", "all"):
        raise ValueError(f"link_scope is month or all, not {link_scope!r}")
    return F.col("month") if link_scope == "month" else F.lit("")


def last_of_scope(records: DataFrame, link_scope: str = "month") -> DataFrame:
    """Of records with one id in a month, or in all months, the last."""
    keyed = records.withColumn("_k", F.concat_ws("\n", _scope(link_scope), "id"))
    return last_wins(keyed, "_k", ("month", "line_no")).drop("_k")


def build(comments: DataFrame, submissions: DataFrame, link_scope: str = "month") -> DataFrame:
    """One row for each comment that a thread reaches: its place in the tree, its parent's author and time, and how many
    comments the thread has.

    comments: id, link_id, parent_id, author, created_utc, line_no, month; submissions: id, author, created_utc, line_no,
    month. Of records with one id the last counts. link_scope month links only within a month, all links all months.
    """
    scope, thread = _scope(link_scope), ["month", "submission_id"]
    linked = F.expr("regexp_replace(link_id, '^t3_', '')").alias("submission_id")
    c = last_of_scope(comments.select("month", linked, "id", "parent_id", "author", F.col("created_utc").cast("bigint").alias("created_utc"), "line_no"), link_scope).withColumn("month", scope)
    s = last_of_scope(submissions.select("month", "id", F.col("author").alias("s_author"), F.col("created_utc").cast("bigint").alias("s_created"), "line_no"), link_scope)
    s = s.select(scope.alias("month"), F.col("id").alias("submission_id"), "s_author", "s_created")
    counts = comments.groupBy(scope.alias("month"), linked).agg(F.count(F.lit(1)).alias("n"))
    large = [(r["month"], r["submission_id"]) for r in counts.filter(F.col("n") > LARGE).collect()]  # at most rows / LARGE
    some = comments.sparkSession.createDataFrame(large, "month string, submission_id string") if large else None
    # whole threads: a partitioning that is asked for isn't split for skew
    few = c.join(F.broadcast(some), thread, "left_anti") if large else c
    rows = few.repartition(*thread).join(s.hint("shuffle_hash"), thread).sortWithinPartitions(*thread, "created_utc", "line_no")
    out = rows.select(*thread, "id", "parent_id", "author", "created_utc", "s_author", "s_created").mapInArrow(_threads, _OUT)
    if large:
        out = out.unionByName(_ranked(c.join(F.broadcast(some), thread, "left_semi").join(s.join(F.broadcast(some), thread, "left_semi"), thread)))
    return out


def thread_sizes(tree: DataFrame, submissions: DataFrame) -> DataFrame:
    """Per submission how many comments its thread has, 0 included."""
    sizes = tree.groupBy("submission_id").agg(F.count(F.lit(1)).alias("thread_size"))
    out = submissions.select(F.col("id").alias("submission_id")).distinct().join(sizes, "submission_id", "left")
    return out.withColumn("thread_size", F.coalesce("thread_size", F.lit(0)).cast("bigint"))


def nested(tree: DataFrame, comments: DataFrame, submissions: DataFrame, link_scope: str = "month") -> DataFrame:
    """Per submission, each once in its scope, one line of nested JSON: {"submission": ..., "comments": [{"comment": ...,
    "replies": [...]}]}; the records are their raw lines. link_scope is that of the tree. Columns month, submission_id, value."""
    scope = _scope(link_scope)
    raw = last_of_scope(comments.select("month", "id", "raw", "line_no"), link_scope).select(scope.alias("month"), "id", "raw")
    per = tree.join(raw, ["month", "id"]).groupBy(F.col("month").alias("_scope"), "submission_id").agg(F.array_sort(F.collect_list(F.struct("walk_order", "depth", "raw"))).alias("walk"))
    rows = last_of_scope(submissions.select("month", "id", "raw", "line_no"), link_scope).select("month", scope.alias("_scope"), F.col("id").alias("submission_id"), F.col("raw").alias("s_raw"))
    rows = rows.join(per, ["_scope", "submission_id"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, visits in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                parts, last = [f'{{"submission": {s}, "comments": ['], -1
                for x in visits or ():
                    d = x["depth"]
                    parts.append("]}" * (last - d + 1) + (", " if d <= last else "") if last >= 0 else "")
                    parts.append(f'{{"comment": {x["raw"]}, "replies": [')
                    last = d
                parts.append("]}" * (last + 1) + "]}")
                out.append("".join(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["month", "submission_id", "value"])

    return rows.select("month", "submission_id", "s_raw", "walk").mapInArrow(run, "month string, submission_id string, value string")


def flat(threads: DataFrame) -> DataFrame:
    """Nested threads (column value) as rows in walk order: submission_id, id, parent, depth, walk_order, author, created_utc,
    score, text and raw; each submission first, at depth -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for line in b.column(0).to_pylist():
                thread = json.loads(line)
                s = thread["submission"]
                out.append((s["id"], s["id"], None, -1, -1, s.get("author"), s.get("created_utc"), s.get("score"), s.get("selftext"), json.dumps(s, ensure_ascii=False)))
                todo, k = [(x, None, 0) for x in reversed(thread["comments"])], 0
                while todo:
                    node, up, depth = todo.pop()
                    c = node["comment"]
                    out.append((s["id"], c["id"], up, depth, k, c.get("author"), c.get("created_utc"), c.get("score"), c.get("body"), json.dumps(c, ensure_ascii=False)))
                    k += 1
                    todo += [(x, c["id"], depth + 1) for x in reversed(node["replies"])]
            cols = list(zip(*out)) or [()] * 10
            number = lambda v: None if v is None else int(float(v))
            text = lambda v: None if v is None else str(v)
            made = [pa.array(list(map(f, c)), t) for f, c, t in zip((text, text, text, number, number, text, number, number, text, text), cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(made, names=["submission_id", "id", "parent", "depth", "walk_order", "author", "created_utc", "score", "text", "raw"])

    return threads.select("value").mapInArrow(run, "submission_id string, id string, parent string, depth int, walk_order bigint, author string, created_utc bigint, score bigint, text string, raw string")
