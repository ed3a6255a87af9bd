"""Queries that go through files: the driver's tables are written as archives, and sources, sinks and plans run over these.

events become a forum of six months, a thread's block of 20 ids in one month, with lines that are no JSON, blank lines, null,
missing, empty and deleted authors, extra keys, comments and submissions that stand again, changed, in the month after, and
submissions that stand twice in a month. The archives of
a data folder are written once a session, to the folder that executors share.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import signals
from .plans import archive_wide, community, extract
from .queries import _table, query
from .sources import archives, files, zst
from .sources.tables import shared_folder
from .streaming import ingest

_made: dict[tuple[str, str, str], Path] = {}


def _work(spark: SparkSession, name: str) -> Path:
    out = Path(shared_folder(spark).removeprefix("file://"), "archives", f"{name}-{uuid.uuid4().hex}")
    out.mkdir(parents=True, exist_ok=True)
    return out


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> Path:
    """What make(folder) has written, once for a session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made or not _made[key].exists():
        folder = _work(spark, name)
        make(folder)
        _made[key] = folder
    return _made[key]


_FIELDS = """
    e AS (SELECT event_id, event_id % 20 AS k, event_id // 20 AS block, user_id % 10 AS u, 'u' || user_id AS who, event_type, coalesce(floor(value)::BIGINT, 0) AS score, floor(epoch(ts))::BIGINT AS sec, coalesce(props, '') AS props FROM events),
    f AS (SELECT *, CASE u WHEN 3 THEN NULL WHEN 4 THEN '[deleted]' WHEN 5 THEN '[deleted]' WHEN 6 THEN '' ELSE who END AS author, 1 + block % 6 AS m FROM e),
    asked AS (SELECT event_id, event_id::VARCHAR AS id, block, m, author, event_type AS subreddit, score, sec AS created_utc, 'post ' || event_id AS title, CASE WHEN event_id % 7 = 0 THEN '[removed]' ELSE props END AS body, event_id AS line FROM f WHERE k = 0),
    asked_all AS (SELECT * FROM asked UNION ALL SELECT * REPLACE ('moved' AS title, m + 1 AS m, line + 500000000 AS line) FROM asked WHERE block % 5 = 0 AND m < 6 UNION ALL SELECT * REPLACE ('twice' AS title, line + 700000000 AS line) FROM asked WHERE block % 9 = 0),
    subs_all AS (SELECT *, '2020-0' || m AS month FROM asked_all),
    subs AS (SELECT * FROM subs_all QUALIFY row_number() OVER (PARTITION BY month, id ORDER BY line DESC) = 1),
    said AS (SELECT event_id, event_id::VARCHAR AS id, block, m, author, event_type AS subreddit, score, sec AS created_utc, block * 20 + (k - 1) // 2 AS up, (k - 1) // 2 = 0 AS topmost, props AS body, event_id AS line FROM f WHERE k > 0),
    said_all AS (SELECT * FROM said UNION ALL SELECT * REPLACE ('again ' || body AS body, score + 1000 AS score, m + 1 AS m, line + 500000000 AS line) FROM said WHERE event_id % 11 = 1 AND m < 6),
    coms AS (SELECT *, '2020-0' || m AS month FROM said_all)
"""
_W = f"WITH RECURSIVE {_FIELDS}"
_TREE = """tree AS (
        SELECT c.event_id, c.month, c.block, c.id, NULL::VARCHAR AS parent, 0 AS depth, [c.created_utc, c.line] AS path, c.author, c.score, c.created_utc, c.body, c.subreddit, c.topmost, s.author AS p_author, s.created_utc AS p_created, s.line AS s_line
            FROM coms c JOIN subs s ON s.block = c.block AND s.month = c.month WHERE c.topmost OR NOT EXISTS (SELECT 1 FROM coms p WHERE p.event_id = c.up AND p.month = c.month)
        UNION ALL
        SELECT c.event_id, c.month, c.block, c.id, t.id, t.depth + 1, list_concat(t.path, [c.created_utc, c.line]), c.author, c.score, c.created_utc, c.body, c.subreddit, c.topmost, t.author, t.created_utc, t.s_line FROM coms c JOIN tree t ON c.up = t.event_id AND c.month = t.month AND NOT c.topmost)
"""
_OURS = "('click', 'view', 'purchase')"
#: The forum of one community, as it is extracted.
_OWN = _FIELDS.replace("FROM asked_all)", "FROM asked_all WHERE subreddit = 'click')").replace("FROM said_all)", "FROM said_all WHERE subreddit = 'click')")
_T = f"WITH RECURSIVE {_OWN}, {_TREE.replace('s.month = c.month', 's.month = c.month AND s.subreddit = c.subreddit').replace('p.month = c.month', 'p.month = c.month AND p.subreddit = c.subreddit').replace('c.month = t.month', 'c.month = t.month AND c.subreddit = t.subreddit')}"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives' lines: value, kind, month, line_no."""
    e = _table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id % 20 AS k", "event_id div 20 AS block", "user_id % 10 AS u", "concat('u', user_id) AS who", "event_type AS subreddit", "coalesce(cast(floor(value) AS BIGINT), 0) AS score",
        "cast(floor(unix_micros(cast(ts AS TIMESTAMP)) / 1000000) AS BIGINT) AS created_utc", "props AS body", "1 + event_id div 20 % 6 AS m", "event_id AS line_no",
    )
    author = F.expr("CASE u WHEN 3 THEN ', \"author\": null' WHEN 4 THEN ', \"author\": \"[deleted]\"' WHEN 5 THEN '' WHEN 6 THEN ', \"author\": \"\"' ELSE concat(', \"author\": \"', who, '\"') END")
    common = [F.col("event_id").cast("string").alias("id"), "subreddit", "score", "created_utc", F.array(F.lit(1)).alias("extra_key")]

    def made(df: DataFrame, kind: str, *fields) -> DataFrame:
        record = F.to_json(F.struct(*common, *fields))
        value = F.concat(record.substr(F.lit(1), F.length(record) - 1), author, F.lit("}"))
        return df.select(value.alias("value"), F.lit(kind).alias("kind"), F.concat(F.lit("2020-0"), "m").alias("month"), "line_no")

    subs = e.filter("k = 0").withColumns({"title": F.concat(F.lit("post "), "event_id"), "selftext": F.expr("CASE WHEN event_id % 7 = 0 THEN '[removed]' ELSE body END")})
    moved = subs.filter("block % 5 = 0 AND m < 6").withColumns({"title": F.lit("moved"), "m": F.col("m") + 1, "line_no": F.col("line_no") + 500_000_000})
    twice = subs.filter("block % 9 = 0").withColumns({"title": F.lit("twice"), "line_no": F.col("line_no") + 700_000_000})
    coms = e.filter("k > 0")
    again = coms.filter("event_id % 11 = 1 AND m < 6").withColumns({"body": F.concat(F.lit("again "), F.coalesce("body", F.lit(""))), "score": F.col("score") + 1000, "m": F.col("m") + 1, "line_no": F.col("line_no") + 500_000_000})
    parent = F.expr("CASE WHEN (k - 1) div 2 = 0 THEN concat('t3_', block * 20) ELSE concat('t1_', block * 20 + (k - 1) div 2) END")
    good = made(subs.unionByName(moved).unionByName(twice), "submissions", "title", "selftext", F.lit(False).alias("edited"))
    good = good.unionByName(made(coms.unionByName(again), "comments", F.expr("concat('t3_', block * 20)").alias("link_id"), parent.alias("parent_id"), "body"))
    bad = good.filter("line_no % 50 = 20").select(F.explode(F.array(F.lit("{bad"), F.lit(""), F.lit("[1]"), F.lit('{"no": "id"}'))).alias("value"), "kind", "month", "line_no")
    return good.unionByName(bad)


def root_of(spark: SparkSession, sf_dir: str) -> Path:
    return _once(spark, sf_dir, "zst", lambda folder: zst.write_archives(lines(spark, sf_dir), folder))


def _found(spark: SparkSession, sf_dir: str) -> list[archives.ArchiveFile]:
    return archives.discover_archives(root_of(spark, sf_dir))


def _extracted(spark: SparkSession, sf_dir: str, fmt: str = "jsonl") -> Path:
    return _once(spark, sf_dir, f"extracted-{fmt}", lambda folder: extract.SubredditExtractor(root_of(spark, sf_dir), folder, ["r/Click", "view", "purchase"], fmt, spark=spark).run())


def _each(spark: SparkSession, folder: Path, get) -> DataFrame:
    """get(data) of the extracted communities, one after the other."""
    out = None
    for p in sorted(x for x in folder.iterdir() if (x / "metadata.json").exists()):
        part = get(community.SubredditData(p, spark)).withColumn("community", F.lit(p.name))
        out = part if out is None else out.unionByName(part)
    return out


# ---- sources

_BAD = "(SELECT 'comments' AS kind, month, line FROM coms UNION ALL SELECT 'submissions', month, line FROM subs_all)"


@query(f"{_W} SELECT kind, month, (count(*) + 3 * count(*) FILTER (line % 50 = 20))::BIGINT AS n FROM {_BAD} GROUP BY ALL")
def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zst.read_archives(spark, _found(spark, sf_dir)).groupBy("kind", "month").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_W} SELECT kind, month, (count(*) + 2 * count(*) FILTER (line % 50 = 20))::BIGINT AS records, (count(*) FILTER (line % 50 = 20))::BIGINT AS errors, (count(*))::BIGINT AS with_id FROM {_BAD} GROUP BY ALL")
def archive_reader_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = zst.count_archives(spark, _found(spark, sf_dir), lambda r: isinstance(r, dict) and "id" in r)
    return spark.createDataFrame(out, "kind string, month string, records long, errors long, with_id long")


@query(f"{_W} SELECT month, bool_or(kind = 'comments') AS comments, bool_or(kind = 'submissions') AS submissions, month BETWEEN '2020-02' AND '2020-04' AS inside FROM {_BAD} GROUP BY month")
def archive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    inside = archives.get_months_in_range(found, "2020-02", "2020-04")
    rows = [(m, c is not None, s is not None, m in inside) for m, c, s in archives.iter_archive_pairs(found)]
    return spark.createDataFrame(rows, "month string, comments boolean, submissions boolean, inside boolean")


@query(f"{_W} SELECT 'comment' AS kind, month, id, author, subreddit, score, created_utc, body AS said, false AS is_edited FROM coms UNION ALL SELECT 'submission', month, id, author, subreddit, score, created_utc, title || ' ' || body, false FROM subs_all")
def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = extract.records_of(spark, _found(spark, sf_dir))
    same = ["month", "id", "author", "subreddit", "score", "created_utc"]
    c = c.select(F.lit("comment").alias("kind"), *same, F.col("body").alias("said"), "is_edited")
    return c.unionByName(s.select(F.lit("submission").alias("kind"), *same, F.concat_ws(" ", "title", "selftext").alias("said"), "is_edited"))


@query(f"{_W} SELECT 'comment' AS kind, count(*) AS n FROM coms UNION ALL SELECT 'submission', count(*) FROM subs_all")
def archive_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, df in zip(("comment", "submission"), extract.records_of(spark, _found(spark, sf_dir))):
        kept = schema.extras(df, kind).filter(F.col("extra")["extra_key"] == "[1]")
        part = kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# ---- extraction


@query(f"{_W} SELECT subreddit AS community, month, id, author, score, created_utc, body, 't3_' || (block * 20) AS link_id FROM coms WHERE subreddit IN {_OURS}")
def extract_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, _extracted(spark, sf_dir), lambda d: d.comments()).select("community", "month", "id", "author", "score", "created_utc", "body", "link_id")


@query(f"{_W} SELECT subreddit AS community, month, id, coalesce(nullif(author, ''), '[deleted]') AS author, score, created_utc, title, nullif(body, '') AS selftext FROM subs_all WHERE subreddit IN {_OURS}")
def extract_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An author that a CSV file leaves empty is read as missing, so as deleted."""
    rows = _each(spark, _extracted(spark, sf_dir, "csv"), lambda d: d.submissions())
    return rows.select("community", "month", "id", "author", "score", "created_utc", "title", F.nullif("selftext", F.lit("")).alias("selftext"))


@query(f"{_W} SELECT month, id, title FROM subs_all WHERE subreddit = 'click' AND regexp_matches(title || ' ' || body, 'moved|post \\d*4\\b', 'i') AND NOT regexp_matches(title || ' ' || body, 'removed', 'i')")
def extract_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _once(spark, sf_dir, "keywords", lambda f: extract.SubredditExtractor(root_of(spark, sf_dir), f, ["click"], "jsonl", include_patterns=["moved", r"post \d*4\b"], exclude_patterns=["removed"], spark=spark).run())
    return community.SubredditData(folder / "click", spark).submissions().select("month", "id", "title")


_ROWS = f"""rws AS (SELECT subreddit, month, coalesce(nullif(author, ''), '[deleted]') AS author, author AS raw_author, score, created_utc, true AS c, line, id FROM coms UNION ALL SELECT subreddit, month, coalesce(nullif(author, ''), '[deleted]'), author, score, created_utc, false, line, id FROM subs_all)"""
_SUMS = """count(*) FILTER (c) AS comment_count, count(*) FILTER (NOT c) AS submission_count, coalesce(sum(score) FILTER (c), 0)::BIGINT AS comment_score_total, coalesce(sum(score) FILTER (NOT c), 0)::BIGINT AS submission_score_total,
    min(created_utc) AS first_seen_utc, max(created_utc) AS last_seen_utc"""
_ROUNDED = "CASE WHEN comment_count > 0 THEN round(comment_score_total / comment_count, 2) END AS avg_comment_score, CASE WHEN submission_count > 0 THEN round(submission_score_total / submission_count, 2) END AS avg_submission_score"
_NUMBERS = ("comment_count", "submission_count", "comment_score_total", "submission_score_total", "first_seen_utc", "last_seen_utc")


def _authors(df: DataFrame, *more: str) -> DataFrame:
    typed = {c: F.col(c).cast("bigint") for c in (*_NUMBERS, *(m for m in more if m == "months_active"))}
    return df.withColumns(typed | {c: F.col(c).cast("double") for c in ("avg_comment_score", "avg_submission_score")})


@query(f"{_W}, {_ROWS}, g AS (SELECT subreddit AS community, month, author, {_SUMS} FROM rws WHERE subreddit IN {_OURS} GROUP BY ALL) SELECT *, {_ROUNDED} FROM g")
def author_files_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    def get(d: community.SubredditData) -> DataFrame:
        out = None
        for m in d.months:
            part = files.read_csv(spark, d.path / m / "authors.csv").withColumn("month", F.lit(m))
            out = part if out is None else out.unionByName(part)
        return out

    return _authors(_each(spark, _extracted(spark, sf_dir), get))


@query(f"{_W}, {_ROWS}, g AS (SELECT subreddit AS community, author, {_SUMS}, count(DISTINCT month) AS months_active FROM rws WHERE subreddit IN {_OURS} GROUP BY ALL) SELECT *, {_ROUNDED} FROM g")
def author_files_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _authors(_each(spark, _extracted(spark, sf_dir), lambda d: files.read_csv(spark, d.path / "authors.csv")), "months_active")


@query(f"{_W}, {_ROWS} SELECT subreddit AS community, month, count(*) FILTER (NOT c) AS submissions_count, count(*) FILTER (c) AS comments_count FROM rws WHERE subreddit IN {_OURS} GROUP BY ALL")
def extract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = _extracted(spark, sf_dir), []
    for p in sorted(x for x in folder.iterdir() if (x / "metadata.json").exists()):
        d = community.SubredditData(p, spark)
        for m in d.months:
            about = d.month_stats(m)
            rows.append((p.name, m, about["submissions_count"], about["comments_count"]))
        if d.metadata.total_comments != sum(r[3] for r in rows if r[0] == p.name):
            raise ValueError(f"the totals of {p} differ from its months")
    return spark.createDataFrame(rows, "community string, month string, submissions_count long, comments_count long")


@query(f"{_W}, {_ROWS} SELECT * FROM (SELECT 'first' AS run, 3::BIGINT AS months, count(*) AS records FROM rws WHERE month <= '2020-03' AND subreddit = 'view' UNION ALL SELECT 'second', 3, count(*) FROM rws WHERE month > '2020-03' AND subreddit = 'view' UNION ALL SELECT 'third', 0, 0)")
def extract_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over one folder: months that are done are skipped."""
    folder, rows = _work(spark, "resumed"), []
    for name, end in (("first", "2020-03"), ("second", None), ("third", None)):
        r = extract.SubredditExtractor(root_of(spark, sf_dir), folder, ["view"], "jsonl", spark=spark).run(None, end)
        rows.append((name, r.months_processed, r.total_comments + r.total_submissions))
    return spark.createDataFrame(rows, "run string, months long, records long")


# ---- over whole archives

_HITS = "SELECT 'comment' AS kind, month, id FROM coms WHERE {c} UNION ALL SELECT 'submission', month, id FROM subs_all WHERE {s}"


def _searched(spark: SparkSession, sf_dir: str, pattern: str, **how) -> DataFrame:
    folder = _work(spark, "search")
    searcher = archive_wide.WordSearcher(root_of(spark, sf_dir), folder, pattern, spark=spark, **how)
    searcher.run()
    searcher.assemble_results()
    out = None
    for kind in ("comment", "submission"):
        part = files.read_csv(spark, folder / f"{kind}s.csv").select(F.lit(kind).alias("kind"), "month", "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_W} " + _HITS.format(c="regexp_matches(body, '\\bagain\\b|k\\W+1', 'i')", s="regexp_matches(title || ' ' || body, '\\bagain\\b|k\\W+1', 'i')"))
def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, r"\bagain\b|k\W+1")


@query(f"{_W} " + _HITS.format(c="regexp_matches(body, '^again|Moved')", s="regexp_matches(title || ' ' || body, 'Moved')").replace("'^again|Moved'", "'Moved'"))
def search_raw_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the raw line asked first, ^ stands at its start only, so it finds nothing in a text."""
    return _searched(spark, sf_dir, "^again|Moved", case_sensitive=True, compat_prefilter=True)


_KNOWN = "count(DISTINCT raw_author) FILTER (raw_author <> '' AND raw_author <> '[deleted]')"


@query(f"{_W}, {_ROWS} SELECT subreddit, month, count(*) FILTER (NOT c) AS n_submissions, count(*) FILTER (c) AS n_comments, {_KNOWN} AS n_unique_authors FROM rws GROUP BY ALL")
def catalogue_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _work(spark, "catalogue") / "catalogue.csv"
    for end in ("2020-02", None):  # the second run does what is left
        archive_wide.ArchiveCatalogue(root_of(spark, sf_dir), path, spark=spark).run(None, end)
    rows = files.read_csv(spark, path)
    return rows.select("subreddit", "month", *[F.col(c).cast("bigint").alias(c) for c in ("n_submissions", "n_comments", "n_unique_authors")])


@query(f"{_W}, {_ROWS} SELECT subreddit, count(*) FILTER (NOT c) AS n_submissions, count(*) FILTER (c) AS n_comments, min(month) AS first_month, max(month) AS last_month, count(DISTINCT month) AS months_active FROM rws GROUP BY subreddit")
def index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _work(spark, "index") / "subreddits.csv"
    archive_wide.SubredditIndex(root_of(spark, sf_dir), path, spark=spark).run()
    rows = files.read_csv(spark, path)
    return rows.select("subreddit", "first_month", "last_month", *[F.col(c).cast("bigint").alias(c) for c in ("n_submissions", "n_comments", "months_active")])


@query(f"""{_W}, {_ROWS}, g AS (SELECT subreddit, author, {_SUMS}, count(DISTINCT month) AS months_active FROM rws WHERE subreddit IN {_OURS} AND author <> '[deleted]' GROUP BY ALL)
    SELECT author, count(*) AS n_subreddits, string_agg(subreddit, '|' ORDER BY subreddit) AS subreddits, sum(comment_count)::BIGINT AS total_comments, sum(submission_count)::BIGINT AS total_submissions, sum(months_active)::BIGINT AS total_months_active, min(first_seen_utc) AS first_seen_utc, max(last_seen_utc) AS last_seen_utc FROM g GROUP BY author HAVING count(*) >= 2""")
def crosssub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _work(spark, "across")
    archive_wide.CrossSubIndex.from_directory(_extracted(spark, sf_dir), spark=spark).build().save(out)
    rows = files.read_csv(spark, out / "author_summary.csv")
    numbers = ("n_subreddits", "total_comments", "total_submissions", "total_months_active", "first_seen_utc", "last_seen_utc")
    return rows.select("author", "subreddits", *[F.col(c).cast("bigint").alias(c) for c in numbers])


# ---- threads


def _threads(spark: SparkSession, sf_dir: str) -> Path:
    def make(folder: Path) -> None:
        extract.SubredditExtractor(root_of(spark, sf_dir), folder, ["click"], "jsonl", spark=spark).run()
        if (folder / "click").exists():
            community.TreeBuilder(folder / "click", spark=spark).build_all_months()
            community.SignalDetector(folder / "click", signals.get_detectors("cmv"), spark).run_all_months()

    return _once(spark, sf_dir, "threads", make)


@query(f"{_T} SELECT subreddit AS community, month, (block * 20)::VARCHAR AS submission_id, id, parent, depth, row_number() OVER (PARTITION BY subreddit, month, block ORDER BY path) - 1 AS walk_order, author, score, created_utc, body AS said FROM tree UNION ALL SELECT subreddit, month, id, id, NULL, -1, -1, author, score, created_utc, body FROM subs")
def threads_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    def get(d: community.SubredditData) -> DataFrame:
        out = None
        for m in d.months:
            if (path := d.path / m / "threads.jsonl.gz").exists():
                part = community.scan_threads(path, spark).withColumn("month", F.lit(m))
                out = part if out is None else out.unionByName(part)
        return out

    raw = F.from_json("raw", "author string")["author"]
    deleted = F.when(~F.array_contains(F.json_object_keys("raw"), "author"), "[deleted]").otherwise(raw)
    rows = _each(spark, _threads(spark, sf_dir), get)
    return rows.select("community", "month", "submission_id", "id", "parent", "depth", "walk_order", deleted.alias("author"), "score", "created_utc", F.coalesce("text", F.lit("")).alias("said"))


_FIRED = """fired AS (
    SELECT t.subreddit, t.month, t.id AS record_id, 'comment' AS record_type, t.s_line, t.path, coalesce(t.topmost, false) AS top_level_comment, coalesce(t.author = s.author AND s.author <> '' AND s.author <> '[deleted]', false) AS op_comment, coalesce(t.author = '[deleted]', false) OR t.body = '[deleted]' AS author_deleted, false AS content_removed
        FROM tree t JOIN subs s ON s.block = t.block AND s.month = t.month AND s.subreddit = t.subreddit
    UNION ALL SELECT subreddit, month, id, 'submission', line, [], false, false, coalesce(author = '[deleted]', false), body = '[removed]' FROM subs)"""


@query(f"{_T}, {_FIRED} SELECT subreddit AS community, month, row_number() OVER (PARTITION BY subreddit, month ORDER BY s_line, path) AS place, record_id, record_type, top_level_comment, op_comment, author_deleted, content_removed FROM fired WHERE top_level_comment OR op_comment OR author_deleted OR content_removed")
def signals_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signals.csv with the place of each row in its file."""
    names = ["top_level_comment", "op_comment", "author_deleted", "content_removed"]
    folder, out = _threads(spark, sf_dir), None
    for p in sorted(x for x in folder.iterdir() if (x / "metadata.json").exists()):
        for path in sorted(p.glob("*/signals.csv")):
            part = files.read_csv(spark, path).coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)
            part = part.select(F.lit(p.name).alias("community"), F.lit(path.parent.name).alias("month"), "place", "record_id", "record_type", *[F.col(c).cast("boolean").alias(c) for c in names])
            out = part if out is None else out.unionByName(part)
    return out


#: Over all months an id counts once, with the last month's record; threads are linked within a month.
_ONCE = """
    lc AS (SELECT * FROM coms QUALIFY row_number() OVER (PARTITION BY subreddit, id ORDER BY month DESC, line DESC) = 1), ls AS (SELECT * FROM subs QUALIFY row_number() OVER (PARTITION BY subreddit, id ORDER BY month DESC, line DESC) = 1)
"""
_LAST = f"WITH RECURSIVE {_OWN}, {_ONCE}, " + _T.split(f"WITH RECURSIVE {_OWN}, ", 1)[1].replace("FROM coms", "FROM lc").replace("JOIN subs", "JOIN ls")


@query(f"{_LAST} SELECT subreddit AS community, month, id, depth, count(*) OVER (PARTITION BY subreddit, month, block) AS thread_size, score, topmost AS top_level_comment FROM tree")
def comments_with_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def get(d: community.SubredditData) -> DataFrame:
        found = d.signals().select("record_id", "record_type", "top_level_comment").distinct()
        c, s, t = d._once(None, community.COMMENT_CORE, community.SUBMISSION_CORE)
        from .operators.frames import comments_frame

        return comments_frame(t, c, s, found, fill_signals=True)

    return _each(spark, _threads(spark, sf_dir), get).select("community", "month", "id", "depth", "thread_size", "score", "top_level_comment")


@query(f"{_LAST} SELECT subreddit AS community, CASE WHEN parent IS NULL THEN 't3_' || (block * 20) ELSE 't1_' || parent END AS source, 't1_' || id AS target, created_utc - p_created AS time_delta FROM tree")
def comment_graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def get(d: community.SubredditData) -> DataFrame:
        out = _work(spark, "graph")
        d.export_comment_graph(out)
        return files.read_csv(spark, out / "comment_graph_edges.csv")

    return _each(spark, _threads(spark, sf_dir), get).select("community", "source", "target", F.col("time_delta").cast("bigint").alias("time_delta"))


@query(f"{_LAST} SELECT subreddit AS community, author AS source, p_author AS target, count(*) AS weight, min(created_utc) AS first_interaction_utc FROM tree WHERE author <> '' AND author <> '[deleted]' AND p_author <> '' AND p_author <> '[deleted]' GROUP BY ALL")
def author_graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def get(d: community.SubredditData) -> DataFrame:
        out = _work(spark, "graph")
        d.export_author_graph(out)
        return files.read_csv(spark, out / "author_graph_edges.csv")

    return _each(spark, _threads(spark, sf_dir), get).select("community", "source", "target", *[F.col(c).cast("bigint").alias(c) for c in ("weight", "first_interaction_utc")])


@query(f"{_W} SELECT id, title, score FROM subs_all WHERE subreddit = 'click' ORDER BY month, line LIMIT 1")
def submission_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first submission of the first month, by its id."""
    d = community.SubredditData(_extracted(spark, sf_dir) / "click", spark)
    first = d.submissions().orderBy("month", "line_no").select("id").head()
    found = d.get_submission(first["id"])
    if d.get_submission("no such id") is not None:
        raise ValueError("an unknown id was found")
    return spark.createDataFrame([(found["id"], found["title"], found["score"])], "id string, title string, score long")


# ---- streams and writers


@query(f"{_W} SELECT subreddit, count(*) AS n, sum(score)::BIGINT AS score FROM coms GROUP BY ALL")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments' lines in two lots of files; each is ingested once, by three runs of the stream."""
    folder = _work(spark, "stream")
    rows = lines(spark, sf_dir).filter("kind = 'comments'")
    for k in (0, 1, 1):
        if not (folder / f"source/{k}").exists():
            rows.filter(F.pmod("line_no", F.lit(2)) == k).select("value").write.text(str(folder / "source" / str(k)))
        ingest.ingest(spark, f"{folder}/source/*", str(folder / "target"), str(folder / "checkpoint"), "comment").awaitTermination()
    return spark.read.parquet(str(folder / "target")).groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS title, n_regionkey::BIGINT AS score FROM nation")
def record_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines and CSV, a record at a time."""
    folder = _work(spark, "writers")
    rows = _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    with files.JsonlWriter(folder / "a.jsonl.gz") as j, files.CsvWriter(folder / "a.csv", ["id", "title", "score"]) as c:
        for r in rows:
            record = {"id": r["n_nationkey"], "title": r["n_name"], "score": r["n_regionkey"]}
            j.write(record)
            c.write(record)
    one = spark.read.json(str(folder / "a.jsonl.gz"), "id long, title string, score long")
    two = files.read_csv(spark, folder / "a.csv").selectExpr("cast(id AS BIGINT) AS id", "title", "cast(score AS BIGINT) AS score")
    return one.join(two, ["id", "title", "score"])
