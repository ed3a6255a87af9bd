"""The registered queries of the archive operators over the driver's tables, and their SQL.

events make a forum: of every 20 ids the first is a submission, the others comments in a binary tree; comments whose parent's
id leaves 5 modulo 37 name a parent that isn't there. orders and lineitem make archives of many months;
conversations make chains; documents are submissions' texts, labels signals over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import authors, catalogue, filters, frames, graph, signals, tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- adapters


def forum(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(comments, submissions) from events."""
    e = _table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id % 20 AS k", "event_id div 20 AS block", "concat('u', user_id) AS author", "event_type AS subreddit", "coalesce(cast(floor(value) AS BIGINT), 0) AS score",
        "cast(floor(unix_micros(cast(ts AS TIMESTAMP)) / 1000000) AS BIGINT) AS created_utc", "props AS body",
    )
    month = F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM").alias("month")
    subs = e.filter("k = 0").select(F.col("event_id").cast("string").alias("id"), "author", "subreddit", "score", "created_utc", month, F.col("event_id").alias("line_no"), F.concat(F.lit("post "), "event_id").alias("title"), F.col("body").alias("selftext"))
    parent = F.expr("CASE WHEN (k - 1) div 2 = 0 THEN concat('t3_', block * 20) WHEN (block * 20 + (k - 1) div 2) % 37 = 5 THEN concat('t1_gone', event_id) ELSE concat('t1_', block * 20 + (k - 1) div 2) END")
    coms = e.filter("k > 0").select(F.col("event_id").cast("string").alias("id"), F.expr("concat('t3_', block * 20)").alias("link_id"), parent.alias("parent_id"), "author", "subreddit", "score", "created_utc", month, F.col("event_id").alias("line_no"), "body")
    return coms, subs


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(comments, submissions) from conversations: the first turn is the submission, each turn answers the one before."""
    c = _table(spark, sf_dir, "conversations").withColumn("name", F.concat_ws("_", "conv_id", "turn"))
    same = [F.col("role").alias("author"), F.col("turn").alias("created_utc"), F.lit("2024-01").alias("month"), F.col("turn").alias("line_no")]
    subs = c.filter("turn = 0").select(F.col("name").alias("id"), *same)
    parent = F.when(F.col("turn") == 1, F.concat(F.lit("t3_"), "conv_id", F.lit("_0"))).otherwise(F.concat(F.lit("t1_"), "conv_id", F.lit("_"), F.col("turn") - 1))
    coms = c.filter("turn > 0").select(F.col("name").alias("id"), F.concat(F.lit("t3_"), "conv_id", F.lit("_0")).alias("link_id"), parent.alias("parent_id"), *same, F.col("text").alias("body"))
    return coms, subs


def archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(comments, submissions) of many months from lineitem and orders."""
    o = _table(spark, sf_dir, "orders")
    about = [F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("subreddit")]
    time = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_utc")
    subs = o.select(*about, F.concat(F.lit("c"), "o_custkey").alias("author"), F.floor("o_totalprice").cast("bigint").alias("score"), time, F.concat(F.lit("t5_"), "o_orderkey").alias("subreddit_id"), F.col("o_orderkey").alias("line_no"), (F.col("o_orderstatus") == "F").alias("over_18"), F.floor("o_totalprice").cast("bigint").alias("subreddit_subscribers"))
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_quantity", "l_linenumber")
    coms = items.join(o, "o_orderkey").select(*about, F.concat(F.lit("c"), F.col("l_suppkey")).alias("author"), F.col("l_quantity").cast("bigint").alias("score"), time, F.concat(F.lit("t5_"), "o_orderkey").alias("subreddit_id"), F.col("o_orderkey").alias("line_no"))
    return coms, subs


_FORUM = """
    f AS (SELECT event_id, event_id % 20 AS k, event_id // 20 AS block, 'u' || user_id AS author, event_type AS subreddit, coalesce(floor(value)::BIGINT, 0) AS score, floor(epoch(ts))::BIGINT AS created_utc, strftime(ts, '%Y-%m') AS month, props AS body FROM events),
    subs AS (SELECT *, event_id::VARCHAR AS id FROM f WHERE k = 0),
    coms AS (SELECT *, event_id::VARCHAR AS id, CASE WHEN (k - 1) // 2 > 0 AND (block * 20 + (k - 1) // 2) % 37 = 5 THEN -1 ELSE block * 20 + (k - 1) // 2 END AS up, (k - 1) // 2 = 0 AS topmost FROM f WHERE k > 0),
    tree AS (
        SELECT c.event_id, c.block, c.id, NULL::VARCHAR AS parent, 0 AS depth, [c.created_utc, c.event_id] AS path, c.author, c.score, c.created_utc, c.month, c.body, c.topmost, s.author AS p_author, s.created_utc AS p_created
        FROM coms c JOIN subs s ON s.block = c.block WHERE c.topmost OR NOT EXISTS (SELECT 1 FROM coms p WHERE p.event_id = c.up)
        UNION ALL
        SELECT c.event_id, c.block, c.id, t.id, t.depth + 1, list_concat(t.path, [c.created_utc, c.event_id]), c.author, c.score, c.created_utc, c.month, c.body, c.topmost, t.author, t.created_utc
        FROM coms c JOIN tree t ON c.up = t.event_id AND NOT c.topmost
    )
"""
_F = f"WITH RECURSIVE {_FORUM}"
_ARCHIVE = """
    ords AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS subreddit, 'c' || o_custkey AS author, floor(o_totalprice)::BIGINT AS score, epoch(o_orderdate)::BIGINT AS created_utc, o_orderstatus = 'F' AS over_18 FROM orders),
    rws AS (
        SELECT subreddit, month, author, score, created_utc, false AS is_comment, o_orderkey, over_18, score AS subscribers FROM ords
        UNION ALL SELECT subreddit, month, 'c' || l_suppkey, l_quantity::BIGINT, created_utc, true, o_orderkey, false, 0 FROM lineitem JOIN ords ON l_orderkey = o_orderkey
    )
"""
_A = f"WITH {_ARCHIVE}"
_STATS = """count(*) FILTER (is_comment) AS comment_count, count(*) FILTER (NOT is_comment) AS submission_count,
    coalesce(sum(score) FILTER (is_comment), 0)::BIGINT AS comment_score_total, coalesce(sum(score) FILTER (NOT is_comment), 0)::BIGINT AS submission_score_total,
    min(created_utc) AS first_seen_utc, max(created_utc) AS last_seen_utc"""
_AVERAGES = "CASE WHEN comment_count > 0 THEN comment_score_total / comment_count END AS avg_comment_score, CASE WHEN submission_count > 0 THEN submission_score_total / submission_count END AS avg_submission_score"
_COMMUNITY = f"""monthly AS (SELECT subreddit, month, author, {_STATS} FROM rws GROUP BY ALL),
    community AS (SELECT subreddit, author, sum(comment_count)::BIGINT AS comment_count, sum(submission_count)::BIGINT AS submission_count, sum(comment_score_total)::BIGINT AS comment_score_total, sum(submission_score_total)::BIGINT AS submission_score_total,
        nullif(min(first_seen_utc), 0) AS first_seen_utc, nullif(max(last_seen_utc), 0) AS last_seen_utc, count(DISTINCT month) AS months_active FROM monthly GROUP BY ALL)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coms, subs = forum(spark, sf_dir)
    return tree.build(coms, subs, "all")


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    coms, subs = forum(spark, sf_dir)
    return frames.comments_frame(tree.build(coms, subs, "all").drop("month").withColumn("month", F.lit("")), coms, subs)


# ---- filters and search


@query("SELECT doc_id, source, lang FROM documents WHERE lower(source) IN ('src1', 'src3', 'src5') AND (regexp_matches(' ' || text, '\\b(the|der)\\b', 'i') OR regexp_matches(' ' || text, 'que', 'i')) AND NOT regexp_matches(' ' || text, 'idiot', 'i')")
def extract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("source").alias("subreddit"), F.lit("").alias("title"), F.col("text").alias("selftext"))
    d = filters.communities(d, ["r/SRC1", "src3", "Src5"])
    return filters.keywords(d, "submission", [r"\b(the|der)\b", "que"], ["idiot"]).select("doc_id", "source", "lang")


@query("SELECT doc_id FROM documents WHERE regexp_matches(' ' || text, 'stupid|wh[a-z]+ing|éa.?ç', 'i')")
def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("selftext"))
    return filters.search(d, "submission", "stupid|wh[a-z]+ing|éa.?ç").select("doc_id")


@query("""SELECT kind, month, count(*) AS n FROM (
    SELECT 'submission' AS kind, source AS month FROM documents WHERE regexp_matches(text, 'th', 'i')
    UNION ALL SELECT 'comment', role FROM conversations WHERE regexp_matches(text, 'th', 'i')) GROUP BY ALL""")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("month"), F.lit("").alias("title"), F.col("text").alias("selftext"))
    c = _table(spark, sf_dir, "conversations").select(F.col("role").alias("month"), F.col("text").alias("body"))
    s = filters.search(d, "submission", "th").select(F.lit("submission").alias("kind"), "month")
    return s.unionByName(filters.search(c, "comment", "th").select(F.lit("comment").alias("kind"), "month")).groupBy("kind", "month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, arg_max(l_partkey, r) AS l_partkey, max(r)::BIGINT AS line_no FROM (SELECT *, l_linenumber::BIGINT * 1000000000 + l_suppkey * 100000 + l_partkey AS r FROM lineitem) GROUP BY l_orderkey")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_linenumber * 1000000000L + l_suppkey * 100000 + l_partkey AS line_no")
    return filters.last_wins(rows, "l_orderkey")


@query(f"{_A} SELECT month, count(*) AS n FROM rws WHERE month BETWEEN '1996-01' AND '1996-06' GROUP BY ALL")
def month_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.months(authors.activity(*archive(spark, sf_dir)), "1996-01", "1996-06").groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS matched FROM events")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "click").alias("matched"))


# ---- aggregates


@query(f"{_A}, {_COMMUNITY} SELECT *, {_AVERAGES} FROM monthly")
def author_stats_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.by_month(authors.activity(*archive(spark, sf_dir)), digits=None)


@query(f"{_A}, {_COMMUNITY} SELECT *, {_AVERAGES} FROM community")
def author_stats_subreddit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.by_community(author_stats_month(spark, sf_dir), digits=None)


_CATALOGUE = f"{_A} SELECT subreddit, month, count(*) FILTER (NOT is_comment) AS n_submissions, count(*) FILTER (is_comment) AS n_comments, count(DISTINCT author) AS n_unique_authors FROM rws GROUP BY ALL"


@query(_CATALOGUE)
def catalogue_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.catalogue(authors.activity(*archive(spark, sf_dir)))


@query(f"{_CATALOGUE} HAVING count(*) >= 200")
def catalogue_min_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.catalogue(authors.activity(*archive(spark, sf_dir)), min_activity=200)


_INDEX = """SELECT subreddit, month, arg_min('t5_' || o_orderkey, is_comment::INT * 1000000000000 + o_orderkey) AS subreddit_id, count(*) FILTER (NOT is_comment) AS n_submissions, count(*) FILTER (is_comment) AS n_comments,
    bool_or(over_18) AS over_18, max(subscribers) AS subreddit_subscribers FROM rws GROUP BY ALL"""


@query(f"{_A} {_INDEX}")
def subreddit_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    coms, subs = archive(spark, sf_dir)
    return catalogue.month_index(subs, coms)


@query(f"""{_A}, m AS ({_INDEX}) SELECT subreddit, arg_min(subreddit_id, month) AS subreddit_id, sum(n_submissions)::BIGINT AS n_submissions, sum(n_comments)::BIGINT AS n_comments, min(month) AS first_month, max(month) AS last_month,
    count(*) AS months_active, bool_or(over_18) AS over_18, max(subreddit_subscribers) AS subreddit_subscribers FROM m GROUP BY subreddit HAVING sum(n_submissions + n_comments) >= 10""")
def subreddit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.community_index(subreddit_months(spark, sf_dir), min_records=10)


@query(f"{_A}, {_COMMUNITY} SELECT *, {_AVERAGES} FROM community WHERE author IN (SELECT author FROM community GROUP BY author HAVING count(*) >= 3)")
def crosssub_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.across_communities(author_stats_subreddit(spark, sf_dir), 3)


@query(f"""{_A}, {_COMMUNITY} SELECT author, count(*) AS n_subreddits, string_agg(subreddit, '|' ORDER BY subreddit) AS subreddits, sum(comment_count)::BIGINT AS total_comments, sum(submission_count)::BIGINT AS total_submissions,
    sum(months_active)::BIGINT AS total_months_active, min(first_seen_utc) AS first_seen_utc, max(last_seen_utc) AS last_seen_utc FROM community GROUP BY author HAVING count(*) >= 2""")
def crosssub_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.across_summary(author_stats_subreddit(spark, sf_dir), 2)


# ---- trees and graphs


@query(f"{_F} SELECT id, (block * 20)::VARCHAR AS submission_id, parent, depth, row_number() OVER (PARTITION BY block ORDER BY path) - 1 AS walk_order FROM tree")
def thread_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("id", "submission_id", "parent", "depth", "walk_order")


@query("""WITH c AS (SELECT *, conv_id || '_' || turn AS id FROM conversations), r AS (SELECT conv_id, turn, id,
    turn - max(CASE WHEN NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.turn > 0) THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS depth FROM c
    WHERE turn > 0 AND EXISTS (SELECT 1 FROM c s WHERE s.conv_id = c.conv_id AND s.turn = 0)) SELECT id, depth::INT AS depth FROM r""")
def thread_depth_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.build(*chains(spark, sf_dir), "all").select("id", "depth")


@query(f"{_F} SELECT s.id AS submission_id, count(t.id) AS thread_size FROM subs s LEFT JOIN tree t ON t.block = s.block GROUP BY ALL")
def thread_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    coms, subs = forum(spark, sf_dir)
    return tree.thread_sizes(tree.build(coms, subs, "all"), subs)


@query(f"{_F} SELECT id, depth FROM tree WHERE depth = 0 AND NOT topmost")
def thread_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    coms, _ = forum(spark, sf_dir)
    return _tree(spark, sf_dir).filter("depth = 0").join(coms.filter("parent_id LIKE 't1%'").select("id"), "id").select("id", "depth")


@query(f"{_F} SELECT 't3_' || id AS node_id, 'submission' AS type, author, score, created_utc, 0 AS depth FROM subs WHERE true UNION ALL SELECT 't1_' || id, 'comment', author, score, created_utc, depth + 1 FROM tree")
def comment_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coms, subs = forum(spark, sf_dir)
    return graph.comment_nodes(tree.build(coms, subs, "all"), subs, coms)


@query(f"{_F} SELECT CASE WHEN parent IS NULL THEN 't3_' || (block * 20) ELSE 't1_' || parent END AS source, 't1_' || id AS target, created_utc - p_created AS time_delta FROM tree")
def comment_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.comment_edges(_tree(spark, sf_dir))


@query(f"{_F} SELECT author, sum(n)::BIGINT AS comment_count, sum(score)::BIGINT AS total_score, min(created_utc) AS first_seen_utc, max(created_utc) AS last_seen_utc FROM (SELECT author, score, created_utc, 1 AS n FROM tree UNION ALL SELECT author, score, created_utc, 0 FROM subs) GROUP BY author")
def author_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coms, subs = forum(spark, sf_dir)
    return graph.author_nodes(tree.build(coms, subs, "all"), subs, coms)


_EDGES = "SELECT author AS source, p_author AS target, count(*) AS weight, min(created_utc) AS first_interaction_utc FROM tree GROUP BY ALL"


@query(f"{_F} {_EDGES}")
def author_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.author_edges(_tree(spark, sf_dir))


# ---- signals


def _detect(spark: SparkSession, sf_dir: str, detectors: list[signals.Detector]) -> DataFrame:
    coms, subs = forum(spark, sf_dir)
    coms = coms.withColumns({"body": F.when(F.col("line_no") % 11 == 0, "[removed]").when(F.col("line_no") % 13 == 0, "[deleted]").when(F.col("line_no") % 17 == 0, "well !Delta").when(F.col("line_no") % 19 == 0, "so nta, I say").otherwise(F.col("body")), "stickied": F.col("line_no") % 23 == 0, "distinguished": F.when(F.col("line_no") % 29 == 0, "moderator")})
    return signals.detect(frames.signal_rows(tree.build(coms, subs, "all"), coms, subs), detectors)


_SIGNALS = f"""{_F}, b AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN '[removed]' WHEN event_id % 13 = 0 THEN '[deleted]' WHEN event_id % 17 = 0 THEN 'well !Delta' WHEN event_id % 19 = 0 THEN 'so nta, I say' ELSE body END AS said FROM tree),
    s AS (SELECT b.id AS record_id, 'comment' AS record_type, b.event_id % 23 = 0 AS stickied_comment, b.event_id % 29 = 0 AS mod_distinguished, coalesce(said = '[removed]', false) AS content_removed, coalesce(said = '[deleted]', false) AS author_deleted, topmost AS top_level_comment, b.author = subs.author AS op_comment,
        coalesce(said ILIKE '%!delta%' OR said LIKE '%Δ%', false) AS delta_awarded, coalesce(regexp_matches(said, '\\b(NTA|YTA|ESH|NAH|INFO)\\b', 'i'), false) AS aita_verdict, coalesce(b.score >= 100 AND b.score <= 200, false) AS scored, b.depth >= 2 AS deep, coalesce(regexp_matches(said, 'k.*1', 'i'), false) AS found
        FROM b JOIN subs ON b.block = subs.block
      UNION ALL SELECT id, 'submission', false, false, false, false, false, false, false, false, coalesce(score >= 100 AND score <= 200, false), false, false FROM subs)"""
_G = "stickied_comment, mod_distinguished, content_removed, author_deleted, top_level_comment, op_comment"
_ANY = _G.replace(",", " OR")


@query(f"{_SIGNALS} SELECT record_id, record_type, {_G} FROM s WHERE {_ANY}")
def signals_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, signals.get_detectors("general"))


@query(f"{_SIGNALS} SELECT record_id, record_type, {_G}, delta_awarded FROM s WHERE {_ANY} OR delta_awarded")
def signals_cmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, signals.get_detectors("ChangeMyView"))


@query(f"{_SIGNALS} SELECT record_id, record_type, {_G}, aita_verdict FROM s WHERE {_ANY} OR aita_verdict")
def signals_aita(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, signals.get_detectors("aita"))


@query(f"{_SIGNALS} SELECT record_id, record_type, scored, deep, found FROM s WHERE scored OR deep OR found")
def signals_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [signals.ScoreDetector("scored", 100, 200), signals.DepthDetector("deep", 2), signals.RegexDetector("found", "k.*1")]
    return _detect(spark, sf_dir, own)


# ---- frames and analyses

_FRAME = f"""{_F}, fr AS (SELECT t.id, t.author, t.score, t.created_utc, t.depth, t.body, (t.block * 20)::VARCHAR AS submission_id, count(*) OVER (PARTITION BY t.block) AS thread_size, t.created_utc - s.created_utc AS time_since_submission,
    s.author AS submission_author, s.score AS submission_score, 'post ' || s.event_id AS submission_title, t.month FROM tree t JOIN subs s ON s.block = t.block)"""


@query(f"{_FRAME} SELECT id, author, score, created_utc, depth, submission_id, thread_size, time_since_submission, submission_author, submission_score, submission_title FROM fr")
def comments_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir).select("id", "author", "score", "created_utc", "depth", "submission_id", "thread_size", "time_since_submission", "submission_author", "submission_score", "submission_title")


@query("SELECT doc_id::VARCHAR AS id, source AS subreddit, quality = 1 AS good, toxic = 1 AS rude FROM documents LEFT JOIN labels USING (doc_id)")
def submissions_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("subreddit"))
    s = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("record_id"), F.lit("submission").alias("record_type"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("rude"))
    return frames.submissions_frame(d, s)


@query(f"{_FRAME} SELECT depth, count(*) AS n FROM fr GROUP BY depth")
def depth_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.depth_histogram(_tree(spark, sf_dir))


@query(f"{_FRAME} SELECT depth, avg(score) AS mean_score, median(score) AS median_score, count(score) AS n FROM fr GROUP BY depth")
def score_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.score_by_depth(_frame(spark, sf_dir))


@query(f"{_FRAME}, h AS (SELECT time_since_submission / 3600 AS h FROM fr WHERE depth = 0) SELECT count(h) AS n, avg(h) AS mean, stddev_samp(h) AS std, min(h) AS least, quantile_cont(h, 0.25) AS p25, quantile_cont(h, 0.5) AS p50, quantile_cont(h, 0.75) AS p75, max(h) AS most FROM h")
def response_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.response_hours(_frame(spark, sf_dir))


@query(f"{_F} SELECT id, score, 'live' AS status FROM subs ORDER BY score DESC, id LIMIT 10")
def top_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.top(forum(spark, sf_dir)[1], 10, "score").select("id", "score", frames.status().alias("status"))


@query(f"{_FRAME} SELECT id, author, score, depth FROM fr ORDER BY score DESC, id LIMIT 5")
def top_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.top(_frame(spark, sf_dir), 5, "score").select("id", "author", "score", "depth")


@query(f"{_F} SELECT max(score) AS score, arg_min(id, -score * 10000000 + event_id) AS id FROM subs")
def best_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forum(spark, sf_dir)[1].agg(F.max("score").alias("score"), F.min_by("id", F.struct(-F.col("score"), F.col("line_no"))).alias("id"))


_DELTA = "coalesce(body LIKE '%7%', false)"


@query(f"{_FRAME} SELECT count(*) AS n, avg(depth) AS mean_depth, avg(score) AS mean_score FROM fr WHERE {_DELTA}")
def delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.signal_summary(_frame(spark, sf_dir).withColumn("delta", F.expr(_DELTA)), "delta")


@query("SELECT CASE source WHEN 'src1' THEN 'removed' WHEN 'src2' THEN 'deleted' ELSE 'live' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.expr("CASE source WHEN 'src1' THEN '[removed]' WHEN 'src2' THEN '[deleted]' ELSE source END AS selftext"))
    return frames.status_counts(d)


@query(f"{_F}, a AS (SELECT author, sum(n)::BIGINT AS comment_count FROM (SELECT author, 1 AS n FROM tree UNION ALL SELECT author, 0 FROM subs) GROUP BY author) SELECT * FROM a ORDER BY comment_count DESC, author LIMIT 10")
def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.top(author_graph_nodes(spark, sf_dir), 10, "comment_count", "author").select("author", "comment_count")


@query(f"{_F}, e AS ({_EDGES}) SELECT source, target, weight FROM e ORDER BY weight DESC, source || '>' || target LIMIT 10")
def top_reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = author_graph_edges(spark, sf_dir).withColumn("pair", F.concat("source", F.lit(">"), "target"))
    return frames.top(edges, 10, "weight", "pair").select("source", "target", "weight")


@query(f"{_F}, e AS ({_EDGES}) SELECT target, count(*) AS repliers FROM e GROUP BY target ORDER BY repliers DESC, target LIMIT 5")
def indegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.top(frames.in_degree(author_graph_edges(spark, sf_dir)), 5, "repliers", "target")


@query(f"{_A} SELECT month, count(*) AS n FROM rws GROUP BY month")
def monthly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.monthly_volume(authors.activity(*archive(spark, sf_dir)))


@query("SELECT source AS month, count(*) FILTER (toxic = 1) AS fired, count(toxic) AS n, CASE WHEN count(toxic) > 0 THEN round(100 * count(*) FILTER (toxic = 1) / count(toxic), 2) END AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def signal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("source").alias("month"), (F.col("toxic") == 1).alias("toxic"))
    return frames.signal_rate(d, "toxic")


@query(f"{_FRAME} SELECT author, count(*) AS n FROM fr GROUP BY author ORDER BY n DESC, author LIMIT 10")
def prolific_commenters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.prolific(_tree(spark, sf_dir))


@query(f"{_FRAME} SELECT id, score FROM fr WHERE score > 100")
def high_score_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir).filter("score > 100").select("id", "score")


@query(f"{_F} SELECT id AS record_id, 'comment' AS record_type, true AS long_argument FROM tree WHERE depth = 0 AND length(body) > 8")
def long_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    class LongArgument(signals.Detector):
        def comment(self):
            return (F.col("depth") == 0) & (F.length("body") > 8)

    coms, subs = forum(spark, sf_dir)
    return signals.detect(frames.signal_rows(tree.build(coms, subs, "all"), coms, subs), [LongArgument("long_argument")])
