"""Hand-written archives: one line for each quirk."""

import csv
import gzip
import io
import json

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from threadlake import cli, schema
from threadlake.functions import regex, text
from threadlake.operators import frames, graph, signals, tree
from threadlake.plans import archive_wide, community, extract
from threadlake.sources import archives, files, parts, zst


def _c(i, parent="t3_s1", at=10, **more):
    return {"id": i, "link_id": "t3_s1", "parent_id": parent, "author": f"a_{i}", "subreddit": "Tea", "subreddit_id": "t5_t", "body": f"body {i}", "created_utc": at, "score": 1} | more


COMMENTS = [
    _c("c1", at=10), _c("c2", "t1_c1", at=20), _c("c3", "t1_c2", at=30), _c("late", at=50), _c("early", at=5), _c("tie1", at=60), _c("tie2", at=60),
    _c("orphan", "t1_nowhere", at=70), _c("x", "t1_y", at=80), _c("y", "t1_x", at=81), _c("self", "t1_self", at=82), _c("dup", at=90, body="first"), _c("dup", "t1_c1", at=90, body="second"),
    _c("null", at=100, author=None), _c("empty", at=101, author=""), _c("gone", at=102, author="[deleted]", body="[deleted]"), _c("text", at="103"), _c("float", at=104.0),
    _c("delta", at=105, body="yes !DELTA"), _c("removed", at=106, body="[removed]"), _c("nta", at=107, body="you are nta, mañana"), _c("line", at=108, body="foo\nnudge \r   😀"), _c("op", at=109, author="asker", stickied=True, distinguished="moderator", edited=1500000000.0, media={"a": 1}, extra_key=[1]),
]
NO_AUTHOR = {k: v for k, v in _c("missing", at=110).items() if k != "author"}
SUBMISSIONS = [
    {"id": "s1", "author": "asker", "subreddit": "tea", "title": "Green", "selftext": "or black?", "created_utc": 1, "score": 7, "over_18": True, "subreddit_subscribers": 12, "edited": False, "num_comments": 3},
    {"id": "s2", "author": "[deleted]", "subreddit": "Tea", "title": "t", "selftext": "[removed]", "created_utc": 2, "score": 1, "subreddit_subscribers": "9"},
    {"id": "o1", "author": "asker", "subreddit": "Other", "title": "nudge", "selftext": "", "created_utc": 3, "score": 1},
]
NEXT = [_c("m2", at=200), _c("m3", at=201, subreddit="Other", author="a_c1")]


def _zst(path, lines, **how):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = "".join(x if isinstance(x, str) else json.dumps(x) + "\n" for x in lines).encode()
    path.write_bytes(zstandard.ZstdCompressor(**how).compress(data))


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    _zst(root / "comments/RC_2020-01.zst", [*COMMENTS, NO_AUTHOR, "{bad\n", "\n", "   \n", "[1]\n", '{"no":"id"}\n', json.dumps(_c("end", at=111))])
    _zst(root / "submissions/RS_2020-01.zst", SUBMISSIONS)
    _zst(root / "comments/RC_2020-02.zst", NEXT)
    (root / "comments/RC_2020-1.zst").write_bytes(b"")
    (root / "comments/RS_2020-03.zst").write_bytes(b"")
    return root


@pytest.fixture(scope="module")
def records(spark, archive):
    c, s = extract.records_of(spark, archives.discover_archives(archive))
    return c.cache(), s.cache()


def test_discovery(archive):
    found = archives.discover_archives(archive)
    assert [(a.month_str, a.file_type) for a in found] == [("2020-01", "comments"), ("2020-01", "submissions"), ("2020-02", "comments")]
    assert [(m, bool(c), bool(s)) for m, c, s in archives.iter_archive_pairs(found)] == [("2020-01", True, True), ("2020-02", True, False)]
    assert archives.get_months_in_range(found, "2020-02") == ["2020-02"] and archives.get_months_in_range(found, None, "2020-01") == ["2020-01"]
    assert archives.parse_archive_filename("RC_2020-13.zst") == ("comments", 2020, 13) and archives.parse_archive_filename("x.zst") is None
    assert archives.discover_archives(archive / "nothing") == [] and found[0].size_mb > 0


def test_zst_frames_and_window(spark, tmp_path):
    one, two = (zstandard.ZstdCompressor().compress(x) for x in (b'{"id":"a"}\n{"id":"b\xc3', b'\xa9"}\n\n{"id":"c"}'))
    (tmp_path / "two.zst").write_bytes(one + two)
    assert [line for line, _ in zst.read_zst_lines(tmp_path / "two.zst")] == ['{"id":"a"}', '{"id":"bé"}', '{"id":"c"}']
    params = zstandard.ZstdCompressionParameters.from_level(1, window_log=28, enable_ldm=True)
    buf = io.BytesIO()
    with zstandard.ZstdCompressor(compression_params=params).stream_writer(buf, closefd=False) as w:
        w.write(b'{"id":"w"}\n' * 1000)
    (tmp_path / "wide.zst").write_bytes(buf.getvalue())
    f = archives.ArchiveFile(tmp_path / "wide.zst", 2020, 1, "comments")
    assert zst.read_archives(spark, [f]).agg(F.count("*"), F.max("line_no")).head()[:] == (1000, 999)
    assert zst.read_archives(spark, []).count() == 0


def test_reader_counts(archive):
    path = archive / "comments/RC_2020-01.zst"
    with zst.ZstReader(path, lambda r: isinstance(r, dict) and r.get("id") == "c1") as r:
        assert len(list(r)) == 1
    assert r.errors == 1 and r.records_yielded == 1 and r.progress.percent == 100.0
    assert zst.count_records(path, lambda r: isinstance(r, dict) and "body" in r) == (len(COMMENTS) + 4, len(COMMENTS) + 2)
    assert zst.ReadProgress().percent == 0.0


def test_types_and_defaults(records):
    c = {r["id"]: r for r in records[0].filter("month = '2020-01'").collect()}
    assert c["missing"]["author"] == "[deleted]" and c["null"]["author"] is None and c["empty"]["author"] == ""
    assert (c["text"]["created_utc"], c["float"]["created_utc"]) == (103, 104)
    assert c["op"]["is_edited"] and c["op"]["edited_utc"] == 1500000000 and c["op"]["stickied"] and not c["c1"]["is_edited"] and c["c1"]["controversiality"] == 0
    s = {r["id"]: r for r in records[1].collect()}
    assert s["s1"]["over_18"] and s["s2"]["subreddit_subscribers"] == 9 and s["s1"]["is_self"] and not s["s1"]["is_edited"]
    more = {r["id"]: r["extra"] for r in schema.extras(records[0], "comment").collect()}
    assert more["op"] == {"extra_key": "[1]", "media": '{"a":1}'} and more["c1"] == {}


def test_tree(records):
    c, s = records
    t = {r["id"]: r for r in tree.build(c, s).collect()}
    assert not {"x", "y", "self", "m2"} & set(t)
    assert (t["c3"]["depth"], t["orphan"]["depth"], t["dup"]["parent"], t["orphan"]["parent"]) == (2, 0, "c1", None)
    order = [r["id"] for r in sorted(t.values(), key=lambda r: r["walk_order"])]
    assert order[:5] == ["early", "c1", "c2", "c3", "dup"] and order.index("tie1") < order.index("tie2")
    assert "m2" in {r["id"] for r in tree.build(c, s, "all").collect()}
    with pytest.raises(ValueError):
        tree.build(c, s, "week")
    sizes = {r[0]: r[1] for r in tree.thread_sizes(tree.build(c, s), s).collect()}
    assert sizes == {"s1": len(t), "s2": 0, "o1": 0}


def test_nested_round_trip(records):
    c, s = records
    rows = {r["submission_id"]: json.loads(r["value"]) for r in tree.nested(tree.build(c, s), c, s).collect()}

    def walk(nodes, depth=0):
        for n in nodes:
            yield n["comment"]["id"], depth
            yield from walk(n["replies"], depth + 1)

    want = [(r["id"], r["depth"]) for r in tree.build(c, s).orderBy("walk_order").collect()]
    assert list(walk(rows["s1"]["comments"])) == want and rows["s2"]["comments"] == [] and rows["s1"]["submission"]["title"] == "Green"


def test_deep_thread(spark):
    n = 3000
    rows = [(str(i), "t3_s", "t3_s" if i == 0 else f"t1_{i - 1}", "a", i, i, "m") for i in range(n)]
    c = spark.createDataFrame(rows, "id string, link_id string, parent_id string, author string, created_utc long, line_no long, month string")
    s = spark.createDataFrame([("s", "b", 0, 0, "m")], "id string, author string, created_utc long, line_no long, month string")
    assert tree.build(c, s).agg(F.max("depth"), F.count("*")).head()[:] == (n - 1, n)
    assert tree.build(c.limit(0), s).count() == 0


def _forest(rows):
    """(id, parent, depth, place, size) by recursion; rows: thread, id, parent id, siblings in order."""
    out = {}
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        ids = {r[1] for r in own}
        place = 0
        todo = [(r, None, 0) for r in reversed(own) if r[2] not in ids]
        found = []
        while todo:
            r, up, depth = todo.pop()
            found.append((r[1], up, depth, place))
            place += 1
            todo += [(c, r[1], depth + 1) for c in reversed(own) if c[2] == r[1]]
        out |= {(t, f[0]): (*f[1:], len(found)) for f in found}
    return out


@pytest.mark.parametrize("large", [False, True])
def test_tree_against_recursion(spark, monkeypatch, large):
    import random

    rng = random.Random(5)
    rows, n = [], 0
    for t in range(30):
        size = rng.choice([0, 1, 2, 5, 40])
        ids = [f"{t}x{k}" for k in range(size)]
        for k, i in enumerate(ids):
            up = rng.choice([*ids[: k + 1], *ids, "gone", "top"]) if rng.random() < 0.2 else rng.choice([*ids[max(0, k - 3) : k], "top"])
            rows.append((f"t{t}", i, up, n))
            n += 1
    monkeypatch.setattr(tree, "LARGE", 4 if large else 10**9)
    monkeypatch.setattr(tree, "PART", 7)
    c = spark.createDataFrame([(i, f"t3_{t}", f"t1_{p}", "a", k // 3, k, "m") for t, i, p, k in rows], "id string, link_id string, parent_id string, author string, created_utc long, line_no long, month string")
    s = spark.createDataFrame([(f"t{t}", "b", 0, t, "m") for t in range(30)], "id string, author string, created_utc long, line_no long, month string")
    got = {(r["submission_id"], r["id"]): (r["parent"], r["depth"], r["walk_order"], r["thread_size"]) for r in tree.build(c, s).collect()}
    assert got == _forest([r[:3] for r in rows])


def test_nested_with_repeated_ids(spark):
    """A submission listed twice and an id in two months: one line for each submission and month, each with its month's records."""
    raw = lambda **x: json.dumps(x)
    c = spark.createDataFrame([("c", "t3_s", "t3_s", "a", 1, 1, "m1", raw(id="c", body="one")), ("c", "t3_s", "t3_s", "a", 1, 1, "m2", raw(id="c", body="two"))], "id string, link_id string, parent_id string, author string, created_utc long, line_no long, month string, raw string")
    s = spark.createDataFrame([("s", "b", 0, k, m, raw(id="s", title=t)) for k, m, t in ((0, "m1", "old"), (1, "m1", "new"), (0, "m2", "next"))], "id string, author string, created_utc long, line_no long, month string, raw string")
    for scope, want in (("month", [("m1", "new", ["one"]), ("m2", "next", ["two"])]), ("all", [("m2", "next", ["two"])])):
        lines = tree.nested(tree.build(c, s, scope), c, s, scope)
        got = sorted((r["month"], json.loads(r["value"])["submission"]["title"], [x["comment"]["body"] for x in json.loads(r["value"])["comments"]]) for r in lines.collect())
        assert got == want
        assert sorted((r["id"], r["depth"]) for r in tree.flat(lines).collect()) == sorted([("s", -1), ("c", 0)] * len(want))


def test_zst_blocks_and_writer(spark, tmp_path):
    rows = [(f"line {k} " + "x" * (k % 50), ("comments", "submissions")[k % 2], f"2020-0{1 + k % 3}", k) for k in range(500)]
    df = spark.createDataFrame(rows, "value string, kind string, month string, line_no long").repartition(5)
    paths = zst.write_archives(df, tmp_path)
    assert len(paths) == 6 == len(archives.discover_archives(tmp_path))
    for a in archives.discover_archives(tmp_path):
        want = [v for v, kind, m, _ in rows if (kind, m) == (a.file_type, a.month_str)]
        assert [line for line, _ in zst.read_zst_lines(a.path)] == want
        assert b"\n".join(zst.read_zst_blocks(a.path, size=17)).decode().split("\n") == want


def test_graphs(records):
    c, s = records
    t = tree.build(c, s)
    edges = {(r[0], r[1]): r[2] for r in graph.comment_edges(t).collect()}
    assert edges["t1_c1", "t1_c2"] == 10 and edges["t3_s1", "t1_orphan"] == 69 and len(edges) == t.count()
    nodes = {r["node_id"]: r for r in graph.comment_nodes(t, s, tree.last_wins(c, "id")).collect()}
    assert nodes["t1_c3"]["depth"] == 3 and nodes["t3_s2"]["depth"] == 0 and len(nodes) == t.count() + 3
    who = {r["author"]: r for r in graph.author_nodes(t, s, tree.last_wins(c, "id")).collect()}
    assert who["asker"]["comment_count"] == 1 and who["asker"]["total_score"] == 9 and not {"", "[deleted]", None} & set(who)
    pairs = {(r[0], r[1]): r[2] for r in graph.author_edges(t).collect()}
    assert pairs["asker", "asker"] == 1 and pairs["a_c2", "a_c1"] == 1


def test_signals(records):
    c, s = records
    rows = frames.signal_rows(tree.build(c, s), tree.last_wins(c, "id"), s)
    found = {r["record_id"]: r for r in signals.detect(rows, [*signals.get_detectors(" AITA "), signals.DeltaAwardedDetector("delta_awarded"), signals.RowDetector("long", lambda r: len(r.body or "") > 15)]).collect()}
    assert found["delta"]["delta_awarded"] and found["removed"]["content_removed"] and found["gone"]["author_deleted"] and found["nta"]["aita_verdict"] and found["nta"]["long"]
    assert found["op"]["op_comment"] and found["op"]["stickied_comment"] and found["op"]["mod_distinguished"]
    assert "orphan" not in found and found["s2"]["content_removed"] and found["s2"]["record_type"] == "submission" and "s1" not in found
    for bad in ([], [signals.Detector("a"), signals.Detector("a")], [signals.Detector("body")]):
        with pytest.raises(ValueError):
            signals.check(bad)
    for make in (lambda: signals.ScoreDetector("x"), lambda: signals.DepthDetector("x"), lambda: signals.get_detectors("none")):
        with pytest.raises(ValueError):
            make()
    frame = frames.comments_frame(tree.build(c, s), tree.last_wins(c, "id"), s, signals.detect(rows, signals.get_detectors("cmv")))
    got = {r["id"]: r for r in frame.collect()}
    assert got["delta"]["delta_awarded"] and got["orphan"]["delta_awarded"] is None and got["c1"]["time_since_submission"] == 9


PATTERNS = [(r"(?P<w>\bnudge\b).*", "x nudge"), (r"[[a-c]+", "[b"), (r"[&&a]", "&"), (r"^a.$", "a\r"), (r"ñ\w", "Ñé"), (r"a\Z", "a\n"), (r"(a)?b(?(1)c|d)", "abc"), (r"[]x]", "]"), (r"\d", "٣"), (r"ß", "SS")]


@pytest.mark.parametrize("pattern,value", PATTERNS)
def test_regex_as_python(spark, pattern, value):
    import re

    df = spark.createDataFrame([(value,), ("",)], "t string")
    got = [r[0] for r in df.select(regex.matches(F.col("t"), pattern)).collect()]
    assert got == [bool(re.search(pattern, v, re.I)) for v in (value, "")]


def test_public_names():
    import threadlake

    assert all(hasattr(threadlake, n) for n in threadlake.__all__) and threadlake.TreeBuilder is community.TreeBuilder
    with pytest.raises(AttributeError):
        threadlake.nothing  # noqa: B018


def test_regex_errors():
    import re

    with pytest.raises(re.error):
        regex.to_java("(")
    assert regex.to_java(r"(a)?b(?(1)c|d)") is None


def _csv(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def test_extract_end_to_end(spark, archive, tmp_path, capsys):
    out = tmp_path / "out"
    ex = extract.SubredditExtractor(archive, out, ["r/TEA", "none"], spark=spark)
    r = ex.run()
    assert (r.months_processed, r.total_submissions, r.total_comments) == (2, 2, len(COMMENTS) + 3)
    lines = gzip.open(out / "tea/2020-01/comments.jsonl.gz", "rt", encoding="utf-8", newline="\n").read().split("\n")[:-1]
    assert [json.loads(x)["id"] for x in lines][:3] == ["c1", "c2", "c3"] and json.loads(lines[-1])["id"] == "end"
    rows = _csv(out / "tea/2020-01/comments.csv")
    assert list(rows[0]) == schema.COMMENT_CSV and {r["id"]: r for r in rows}["line"]["body"] == "foo\nnudge \r   😀"
    assert {r["id"]: r for r in rows}["op"]["stickied"] == "true"
    people = {r["author"]: r for r in _csv(out / "tea/authors.csv")}
    assert people["asker"]["submission_count"] == "1" and people["[deleted]"]["comment_count"] == "4" and people["a_c1"]["months_active"] == "1"
    about = json.loads((out / "tea/metadata.json").read_text())
    assert about["months"] == ["2020-01", "2020-02"] and about["total_comments"] == len(COMMENTS) + 3
    assert extract.SubredditExtractor(archive, out, ["tea", "none"], spark=spark).run().months_processed == 0
    assert extract.SubredditExtractor(archive, out, ["tea"], include_patterns=["nudge"], spark=spark).run("2020-01", "2020-01").total_comments == 1
    assert extract.SubredditExtractor(archive, out, ["tea", "none"], force=True, spark=spark).run().total_comments == len(COMMENTS) + 3

    assert community.TreeBuilder(out / "tea", spark=spark).build_month("2020-01") == 2
    assert community.load_threads(out / "tea/2020-01/threads.jsonl.gz", spark).count() == 2
    assert community.SignalDetector(out / "tea", signals.get_detectors("cmv"), spark).run_month("2020-01") > 3
    d = community.load_subreddit(out / "tea", spark)
    assert d.get_submission("s1")["title"] == "Green" and d.get_submission("zz") is None and len(d.get_thread("s1")["comments"]) > 5 and d.get_thread("zz") is None
    frame = {r["id"]: r for r in d.comments_dataframe("2020-01").collect()}
    assert frame["delta"]["delta_awarded"] and frame["orphan"]["thread_size"] == len(frame)
    assert d.submissions_dataframe(fill_signals=True).filter("content_removed").count() == 1
    assert d.month_stats("2020-01")["submissions_count"] == 2
    n = d.export_comment_graph(tmp_path / "g")
    assert n == {"nodes": len(frame) + 2, "edges": len(frame)} and d.export_author_graph(tmp_path / "g")["edges"] > 5

    extract.SubredditExtractor(archive, out, ["other"], spark=spark).run()
    both = archive_wide.CrossSubIndex.from_directory(out, spark=spark).build().save(tmp_path / "x")
    assert both["authors"] == 2 and _csv(tmp_path / "x/author_summary.csv")[0]["subreddits"] == "other|tea"
    for argv in (["info", str(out / "tea"), "-v"], ["list-archives", str(archive)], ["-q", "build-trees", str(out / "tea"), "-m", "2020-01"], ["signals", str(out / "tea"), "--month", "2020-01"]):
        assert cli.main(argv) == 0
    said = capsys.readouterr().out
    assert "community: tea" in said and "comments: 2" in said and "threads: 2" in said
    assert cli.main([]) == 1


def test_csv_only_is_read(spark, archive, tmp_path):
    extract.SubredditExtractor(archive, tmp_path, ["tea"], "csv", spark=spark).run("2020-01", "2020-01")
    d = community.load_subreddit(tmp_path / "tea", spark)
    assert d.comments().agg(F.sum("score")).head()[0] == d.comment_count() == len(COMMENTS) + 2
    assert community.TreeBuilder(tmp_path / "tea", spark=spark).build_all_months() == {"2020-01": 0}


def test_search(spark, archive, tmp_path):
    s = archive_wide.WordSearcher(archive, tmp_path, r"\bnudge", spark=spark, output_format="both")
    r = s.run()
    assert (r.total_comments, r.total_submissions, r.months_processed) == (1, 1, 2)
    assert s.assemble_results() == {"comments": 1, "submissions": 1} and _csv(tmp_path / "comments.csv")[0]["month"] == "2020-01"
    assert archive_wide.WordSearcher(archive, tmp_path, r"\bnudge", spark=spark, output_format="both").run().months_processed == 0
    strict = archive_wide.WordSearcher(archive, tmp_path / "raw", r"\bnudge", spark=spark, compat_prefilter=True).run()
    assert (strict.total_comments, strict.total_submissions) == (0, 1)
    assert archive_wide.assemble_search_results(tmp_path / "raw", spark) == {"comments": 0, "submissions": 1}


def test_catalogue_and_index(spark, archive, tmp_path):
    cat = archive_wide.ArchiveCatalogue(archive, tmp_path / "cat.csv", spark=spark)
    assert cat.run()["months_processed"] == 2 and cat.run()["months_processed"] == 0
    rows = {(r["subreddit"], r["month"]): r for r in _csv(tmp_path / "cat.csv")}
    assert rows["Tea", "2020-01"]["n_comments"] == str(len(COMMENTS) + 2) and rows["tea", "2020-01"]["n_unique_authors"] == "1"
    index = archive_wide.SubredditIndex(archive, tmp_path / "subs.csv", spark=spark)
    assert index.run()["subreddits_written"] == 3
    tea = {r["subreddit"]: r for r in _csv(tmp_path / "subs.csv")}
    assert tea["Tea"]["subreddit_id"] == "t5_t" and tea["Tea"]["months_active"] == "2" and tea["tea"]["over_18"] == "true" and tea["tea"]["subreddit_subscribers"] == "12"


def test_writers(tmp_path):
    with files.CsvWriter(tmp_path / "a.csv") as w:
        w.write({"a": None, "b": True, "c": {"x": 1}})
    assert (tmp_path / "a.csv").read_text().splitlines() == ["a,b,c", ',true,"{""x"": 1}"']
    with files.JsonlWriter(tmp_path / "a.jsonl.gz") as w:
        w.write({"é": 1})
    assert gzip.open(tmp_path / "a.jsonl.gz", "rt", encoding="utf-8").read() == '{"é": 1}\n' and w.count == 1
    t = files.ThreadWriter(tmp_path / "t.json")
    t.add({"a": 1})
    t.save()
    assert json.loads((tmp_path / "t.json").read_text()) == [{"a": 1}]
    assert files.write_records_csv([{"id": "a"}], tmp_path / "c.csv", "comment") == 1
    assert text.readable_size(2048) == "2.0 KB" and text.readable_duration(90) == "1.5m" and text.community_folder("r/a/b") == "a_b"


def test_missing_folders(spark, tmp_path):
    for make in (lambda: community.SubredditData(tmp_path / "no", spark), lambda: extract.SubredditExtractor(tmp_path, tmp_path, ["a"], spark=spark), lambda: extract.SubredditExtractor(tmp_path / "no", tmp_path, ["a"], spark=spark)):
        with pytest.raises(ValueError):
            make()


def test_ingest(spark, tmp_path):
    from threadlake.streaming.ingest import activity_by_window, ingest

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in COMMENTS[k::2]))
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), "comment").awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out"))
        assert rows.count() == sum(len(COMMENTS[j::2]) for j in range(k + 1))
    assert activity_by_window(rows).agg(F.sum("n")).head()[0] == len(COMMENTS)


def test_zst_split_by_frames(tmp_path):
    data = "".join(f'{{"id":"é{k}"}}\n' + "\n" * (k % 7 == 0) for k in range(500)).encode()
    cuts = [0, 1, 40, 41, 42, 3000, 3001, len(data) - 1, len(data)]
    small = [zstandard.ZstdCompressor(write_checksum=k % 2 == 0).compress(data[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    skipped = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
    path = tmp_path / "many.zst"
    path.write_bytes(small[0] + skipped + b"".join(small[1:]))
    assert len(zst.frames(path)) == len(small)
    want = [line for line, _ in zst.read_zst_lines(path)]
    for least in (1, 100, 1 << 20):
        parts = zst.splits(path, least)
        got = [x.decode() for a, b in parts for block in zst.read_zst_blocks(path, size=23, start=a, end=b) for x in block.split(b"\n") if x.strip()]
        assert got == want and (len(parts) == len(small) if least == 1 else len(parts) < len(small))
    path.write_bytes(b"".join(small)[:-1])
    assert zst.frames(path) == [0]


def test_archives_are_written_in_parts_and_counted_in_tasks(spark, tmp_path):
    rows = [(f'{{"id":"{k}"}}' if k % 5 else "{bad", kind, "2020-01", k) for k in range(400) for kind in ("comments", "submissions")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paths = zst.write_archives(spark.createDataFrame(rows, "value string, kind string, month string, line_no long").repartition(3), tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["comments", "submissions"] and sum(len(zst.frames(p)) for p in paths) > 2
    for p in paths:
        assert [line for line, _ in zst.read_zst_lines(p)] == [v for v, kind, _, _ in rows if kind == p.parent.name]
    found = archives.discover_archives(tmp_path)
    assert sorted(zst.count_archives(spark, found, lambda r: r["id"] == "7")) == [(k, "2020-01", 320, 80, 1) for k in ("comments", "submissions")]


def test_files_in_parts(spark, tmp_path):
    texts = ["plain", 'a "quote"', "two\nlines", '"', '""\n"', "comma, here", None, "é", "in  side", "x\\", "\\\"y"]
    rows = [(k, f"g{k % 2}", texts[k % len(texts)], json.dumps({"id": k}), k) for k in range(600)]
    df = spark.createDataFrame(rows, "line_no long, g string, t string, raw string, n long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert files.write_single(df.select("line_no", "t"), tmp_path / "one.csv", order=["line_no"]) == 600
        assert files.write_single(df.orderBy("line_no").select("raw"), tmp_path / "one.gz", "text") == 600
        made = [files.write_grouped(df, tmp_path, name, {"g": "g"}, kind, ["line_no"]) for name, kind in (("a.jsonl.gz", "jsonl"), ("a.csv", "csv"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [[str(p.relative_to(tmp_path)) for p in m] for m in made] == [[f"g{k}/{n}" for k in (0, 1)] for n in ("a.jsonl.gz", "a.csv")]
    for path, own in ((tmp_path / "one.gz", rows), (made[0][0], rows[::2]), (made[0][1], rows[1::2])):
        assert gzip.open(path, "rt").read() == "".join(r[3] + "\n" for r in own)
        assert len(parts.members(path)) > 1
        got = parts.read_lines(spark, path, 1)
        assert got.rdd.getNumPartitions() > 1 and [r["value"] for r in got.collect()] == [r[3] for r in own]
        assert [r["value"] for r in spark.read.text(str(path)).collect()] == [r[3] for r in own]  # others read all members, too
    for path, own in ((tmp_path / "one.csv", rows), (made[1][0], rows[::2]), (made[1][1], rows[1::2])):
        got = parts.read_csv(spark, path, 200)
        assert got.rdd.getNumPartitions() > 2 and [r["t"] for r in got.collect()] == [r[2] for r in own]
        assert got.collect() == parts.read_csv(spark, path).collect() and parts.read_csv(spark, path).rdd.getNumPartitions() == 1
    (tmp_path / "one.gz").write_bytes((tmp_path / "one.gz").read_bytes() + gzip.compress(b"more\n"))
    assert parts.members(tmp_path / "one.gz") == [0] and parts.read_lines(spark, tmp_path / "one.gz", 1).count() == 601
    (tmp_path / "cr.csv").write_bytes(b"a,b\r\n" + b"1,2\r\n" * 500)
    assert parts.read_csv(spark, tmp_path / "cr.csv", 200).count() == 500
    (tmp_path / "gaps.csv").write_bytes(b'a,b\n' + b'1,""\n\n2\n,\n3,4,5\n' * 100)
    assert parts.read_csv(spark, tmp_path / "gaps.csv", 200).collect() == parts.read_csv(spark, tmp_path / "gaps.csv").collect()


def test_threads_are_walked_in_small_lots():
    n, names = 230_000, ["month", "submission_id", "id", "parent_id", "author", "created_utc", "s_author", "s_created"]
    threads = [f"t{k // 7:06}" for k in range(n)]
    cols = [["m"] * n, threads, [f"c{k}" for k in range(n)], [f"t3_{t}" if k % 7 == 0 else f"t1_c{k - 1}" for k, t in enumerate(threads)], ["a"] * n, [0] * n, ["b"] * n, [0] * n]
    rows = pa.table(dict(zip(names, cols)))
    out = list(tree._threads(iter(rows.to_batches(max_chunksize=10_000))))
    assert max(b.num_rows for b in out) <= 60_000 and sum(b.num_rows for b in out) == n
    assert [d for b in out for d in b.column(4).to_pylist()] == [k % 7 for k in range(n)]


def test_trees_need_few_columns(spark, archive, tmp_path):
    extract.SubredditExtractor(archive, tmp_path, ["tea"], "jsonl", spark=spark).run("2020-01", "2020-01")
    d = community.load_subreddit(tmp_path / "tea", spark)
    c, s, t = d._once(None, community.COMMENT_CORE, community.SUBMISSION_CORE)
    assert c.columns == list(community.COMMENT_CORE) and s.columns == list(community.SUBMISSION_CORE)
    assert all("steps/" in f for df in (c, s) for f in df.inputFiles())  # parsed once
    every = d._once(None)
    assert sorted(t.collect()) == sorted(every[2].collect()) and sorted(c.collect()) == sorted(every[0].select(*c.columns).collect())
    assert d.export_comment_graph(tmp_path / "g")["edges"] == t.count()
