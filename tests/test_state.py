"""The queue, landed pages, refreshes, the inbox, commits and outlines over restarts, rivals and writers that die."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.html import sanitize
from tidemark.operators.outlines import documents, imported, outline_nodes, tree_lines
from tidemark.plans.commits import Refused, Store
from tidemark.plans.dialect import SPARK
from tidemark.sources import feeds
from tidemark.sources.landed_source import LandedSource, bits, land
from tidemark.streaming.queue import COMMAND, RESULT, rocks, run_queue, step, wait
from tidemark.streaming.refresh import PAGE_ROW, STALE, cursors, give_back, refresh, shared_records

# ---- the queue

#: The tests' times begin here, as a watermark begins at the epoch.
START = 1_000_000


def replay(spark, path, batches, lease=10, late=0):
    """Result rows of batches of commands, each a run of its own that resumes the one before."""
    for batch in batches:
        later = [(job, START + at, *rest) for job, at, *rest in batch]
        spark.createDataFrame(later, COMMAND).coalesce(1).write.mode("append").parquet(f"{path}/in")
        with rocks(spark):
            out = run_queue(spark.readStream.schema(COMMAND).parquet(f"{path}/in"), lease, late)
            out.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    back = lambda t: None if t is None else t - START
    rows = [(r[0], back(r[1]), *r[2:8], back(r[8]), back(r[9])) for r in spark.read.schema(RESULT).parquet(f"{path}/out").collect()]
    return sorted(rows, key=lambda r: (r[0], r[1], r[2] if r[2] is not None else -1))


def test_a_lease_is_taken_over_when_it_has_ended(spark, tmp_path):
    commands = [
        (1, 0, 1, "enqueue", None), (1, 1, 2, "enqueue", None), (1, 2, 3, "lease", None), (1, 5, 4, "lease", None), (1, 13, 5, "lease", None),
        (1, 14, 6, "complete", 3), (1, 20, 7, "renew", 5), (1, 28, 8, "complete", 5), (1, 40, 9, "lease", None),
    ]
    found = replay(spark, str(tmp_path), [[*commands[:4], (2, 3, 10, "renew", 1)], commands[4:]])
    assert [(r[1], r[3], r[4], r[5]) for r in found if r[0] == 1] == [
        (0, "enqueue", "enqueued", "pending"), (1, "enqueue", "ignored", "pending"), (2, "lease", "leased", "leased"), (5, "lease", "refused", "leased"), (12, "expire", "returned", "pending"),
        (13, "lease", "leased", "leased"), (14, "complete", "refused", "leased"), (20, "renew", "renewed", "leased"), (28, "complete", "completed", "completed"), (40, "lease", "refused", "completed"),
    ]
    assert [r[4:6] for r in found if r[0] == 2] == [("unknown", None)]
    assert [r[6] for r in found if r[0] == 1] == [0, 0, 1, 1, 1, 2, 2, 2, 2, 2]


def test_a_failed_job_waits_and_a_timer_returns_a_lease_without_commands(spark, tmp_path):
    commands = [(1, 0, 1, "enqueue", None), (1, 0, 2, "lease", None), (1, 4, 3, "fail", 2), (1, 20, 4, "lease", None), (1, 34, 5, "lease", None), (9, 100, 6, "enqueue", None)]
    found = [r for r in replay(spark, str(tmp_path), [commands]) if r[0] == 1]
    assert [(r[1], r[3], r[4]) for r in found] == [(0, "enqueue", "enqueued"), (0, "lease", "leased"), (4, "fail", "failed"), (20, "lease", "refused"), (34, "lease", "leased"), (44, "expire", "returned")]
    assert found[2][9] == 4 + wait(1) == 34 and [wait(n) for n in (0, 3, 20)] == [15, 120, 15360]


def test_batches_and_restarts_change_nothing(spark, tmp_path):
    r = random.Random(4)
    ops = ["enqueue", "lease", "lease", "renew", "complete", "fail"]
    commands, last = [], {}
    for i in range(160):
        job, op = r.randrange(6), r.choice(ops)
        commands.append((job, i * 3, i, op, r.choice([last.get(job), last.get(job), 7]) if op in ("renew", "complete", "fail") else None))
        last[job] = i if op == "lease" else last.get(job)
    commands.append((99, 10_000, 999, "enqueue", None))
    one = replay(spark, f"{tmp_path}/a", [commands])
    assert one == replay(spark, f"{tmp_path}/b", [commands[:50], commands[50:51], commands[51:140], commands[140:]])
    jobs, want = {}, 0
    for job, at, i, op, token in commands:
        state = jobs.get(job)
        if state and state[3] is not None and state[3] <= at:
            state, want = ("pending", state[1], None, None, state[4]), want + 1
        outcome, jobs[job] = step(state, at, i, op, token, 10)
        assert [x[4] for x in one if x[2] == i] == [outcome]
    assert sum(x[3] == "expire" for x in one) == want + sum(s is not None and s[3] is not None for s in jobs.values()) > 3


# ---- landed pages


def test_landed_pages_are_read_once_and_only_when_whole(spark, tmp_path):
    spark.dataSource.register(LandedSource)
    root, out = f"{tmp_path}/landed", f"{tmp_path}/out"
    page = lambda rows: spark.createDataFrame(rows, "kind string, endpoint_id string, page long, body string")

    def read():
        rows = spark.readStream.format("landed").load(root)
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
        return sorted((r["kind"], r["endpoint_id"], r["landing"], r["page"], r["body"]) for r in spark.read.parquet(f"{out}/rows").collect())

    land(page([("rss", "a:1/x", 1, "é\n1"), ("rss", "b", 1, None)]), root, 1)
    first = read()
    assert first == [("rss", "a:1/x", 1, 1, "é\n1"), ("rss", "b", 1, 1, None)]
    page([("rss", "b", 9, "half")]).selectExpr("page", "body").write.json(f"{root}/kind=rss/endpoint_id=b/landing=2")
    assert read() == first and spark.read.format("landed").load(root).count() == 2
    land(page([("rss", "b", 2, "x"), ("reddit", "c", 1, "y")]), root, 2)
    assert [x[:4] for x in read()] == [("reddit", "c", 2, 1), ("rss", "a:1/x", 1, 1), ("rss", "b", 1, 1), ("rss", "b", 2, 2)]
    assert len(read()) == 4
    assert {(r["kind"], r["capabilities"]) for r in spark.read.format("landed").load(root).collect()} == {("rss", bits("rss")), ("reddit", bits("reddit"))}
    assert bits("rss") == 1 + 4 + 16 + 256 and bits("unheard") == 0


def test_an_empty_root_has_no_pages(spark, tmp_path):
    spark.dataSource.register(LandedSource)
    assert spark.read.format("landed").load(f"{tmp_path}/none").count() == 0


# ---- refreshes and the inbox


def test_a_refresh_resumes_behind_its_cursor(spark, tmp_path):
    root, store = f"{tmp_path}/pages", f"{tmp_path}/store"
    row = lambda e, page, place, i, following: (e, page, place, i, None if i is None else f"t{i}", following, None)

    def run(rows):
        spark.createDataFrame(rows, PAGE_ROW).withColumn("landed_at", F.timestamp_seconds(F.col("page") + START)).write.mode("append").parquet(root)
        refresh(spark.readStream.schema(PAGE_ROW).option("maxFilesPerTrigger", 1).parquet(root), store)

    run([row("a", 0, 0, "1", "p1"), row("a", 0, 1, "2", "p1"), row("a", 0, -1, None, "p1"), row("b", 0, 0, "1", None), row("b", 0, -1, None, None), (None, 0, 0, "9", None, None, None)])
    assert sorted(map(tuple, cursors(spark, store).collect())) == [("a", 0, "p1", False, 2), ("b", 0, None, True, 1)]
    run([row("a", 1, 2, "2", None), row("a", 1, 3, "3", None), row("a", 1, -1, None, None)])
    assert sorted(map(tuple, cursors(spark, store).collect())) == [("a", 1, None, True, 3), ("b", 0, None, True, 1)]
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(f"{store}/candidates").select("endpoint_id", "external_id").collect()) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]


def test_the_inbox_reads_each_file_once_and_gives_stale_claims_back(spark, tmp_path):
    box, out = tmp_path / "box", f"{tmp_path}/out"
    box.mkdir()
    record = lambda i: json.dumps({"id": str(i), "url": f"https://e.org/{i}", "title": "t", "createdAt": i})
    (box / "a.json").write_text(record(1) + "\nno record\n")
    (box / "b.json.lease-x").write_text(record(2))
    (box / "c.json.lease-y").write_text(record(3))
    os.utime(box / "b.json.lease-x", (time.time() - STALE - 60,) * 2)

    def run():
        rows = shared_records(spark, str(box), f"{tmp_path}/done")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
        return sorted((r["id"] or "", r["_corrupt_record"] or "") for r in spark.read.parquet(f"{out}/rows").collect())

    assert run() == [("", "no record"), ("1", "")]
    assert give_back(spark, str(box), time.time()) == ["b.json"] and give_back(spark, f"{tmp_path}/none", 0) == []
    assert run() == [("", "no record"), ("1", ""), ("2", "")] == run()
    assert (box / "c.json.lease-y").exists()


# ---- commits


def test_two_writers_and_one_that_dies(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x long")
    one, two = Store(spark, str(tmp_path), "one"), Store(spark, str(tmp_path), "two")
    ids = lambda t, v=None: sorted(r[0] for r in one.table(t, v).collect())
    assert one.manifest()["version"] == 0
    assert one.commit({"a": ("append", rows(1)), "b": ("append", rows(1))}, {"d"}, key="k") == 1
    seen = two.manifest()["domains"]
    # staged by both at once: one gets the next version, the other is refused whole
    mine, theirs = one.stage("a", rows(2)), two.stage("a", rows(3))
    assert one.publish({"a": ("append", mine)}, {"d"}, seen) == 2
    with pytest.raises(Refused):
        two.publish({"a": ("append", theirs), "b": ("replace", two.stage("b", rows(9)))}, {"d"}, seen)
    assert ids("a") == [1, 2] and ids("b") == [1] and ids("a", 1) == [1]
    # other domains do not stand in the way, and a key is committed once
    assert two.publish({"c": ("replace", theirs)}, {"other"}, {"other": 0}) == 3 and one.manifest()["domains"] == {"d": 2, "other": 1}
    assert two.commit({"a": ("append", rows(7))}, {"d"}, key="k") is None and ids("a") == [1, 2]
    # a writer that dies after its key and half of its tables leaves nothing that anyone sees
    lost = two.stage("b", rows(5))
    two._put(f"keys/{'0' * 2}/{'0' * 64}-4", "")
    two._put("manifests/.half", "{")
    assert ids("b") == [1] and one.commit({"b": ("append", rows(6))}, {"d"}, key="k2") == 4 and ids("b") == [1, 6]
    assert one.sweep(older_than=0, keep=1) and ids("a") == [1, 2] and ids("b") == [1, 6] and not os.path.exists(f"{tmp_path}/{lost}")
    with pytest.raises(KeyError):
        one.table("nothing")


# ---- outlines


def test_a_tree_comes_back_as_it_was_written(spark):
    spark.createDataFrame([("d", "A&B", "A&B", 1, "1000000A&B\x01", ' x="1"'), ("d", "A&B/C", "C", 2, "1000000A&B\x011000001C\x01", ""), ("d", "A&B/B", "B", 2, "1000000A&B\x011000002B\x01", "")], "doc_id string, path_key string, name string, depth int, order_key string, attributes string").createOrReplaceTempView("t_folders")
    kinds = "doc_id string, order_key string, place long, name string, xml_url string, html_url string, connector string"
    rows = [("d", "", 1, "loose <1>", "http://e/1", None, "rss"), ("d", "1000000A&B\x01", 2, "in", 'http://e/2?a="b"&c', "http://e", "rss"), ("d", "1000000A&B\x011000001C\x01", 3, "deep", "http://e/3", None, "rss"), ("d", "", 4, "none", None, None, "rss")]
    spark.createDataFrame(rows, kinds).createOrReplaceTempView("t_feeds")
    body = documents(spark.sql(tree_lines(SPARK, "SELECT * FROM t_folders", "SELECT * FROM t_feeds")))
    read = feeds.opml(body.withColumnRenamed("doc_id", "source_id"))
    assert sorted((r["path"], r["title"], r["xml_url"]) for r in read.collect()) == [("", "loose <1>", "http://e/1"), ("/A&B", "in", 'http://e/2?a="b"&c'), ("/A&B/C", "deep", "http://e/3")]
    nodes = {r["title"]: r for r in outline_nodes(body).collect()}
    assert [nodes[t]["sort_order"] for t in ("A&B", "loose <1>", "in", "C", "B", "deep")] == [0, 1, 0, 1, 2, 0]
    assert nodes["deep"]["parent"] == nodes["C"]["node"] and nodes["A&B"]["attributes"] == {"x": "1"} and nodes["in"]["html_url"] == "http://e"


def test_an_import_keeps_no_secrets_and_creates_nothing_twice(spark):
    body = """<opml><body><!-- <outline text="gone"/> --><outline text="a/b" apiToken="s" color="red"><outline text="x" xmlUrl="HTTP://E.org:80/f/?utm_source=1#p"/>
        <outline title="y" text="n" xmlUrl="http://e.org/f"/><outline text="z" xmlUrl="file:///etc"/></outline><outline text="a/b"/></body></opml>"""
    raw = spark.createDataFrame([("d", body), ("e", None), ("f", "<opml/>")], "doc_id string, body string")
    had = spark.createDataFrame([], "url string")
    found = {(r["kind"], r["title"], r["sort_order"]): r for r in imported(raw, had).collect()}
    assert len(found) == 5 and found["folder", "a/b", 0]["attributes"] == {"color": "red"} and found["folder", "a/b", 0]["path_key"] == "a∕b"
    assert [(found["feed", t, i]["message"], found["feed", t, i]["created"]) for i, t in enumerate("xyz")] == [("Imported", True), ("Already subscribed", False), ("Unsupported", False)]
    assert [found["folder", "a/b", i]["created"] for i in (0, 1)] == [True, False] and found["feed", "x", 0]["path_key"] == "a∕b/x"
    again = imported(raw, spark.createDataFrame([("http://e.org/f",)], "url string")).where("kind = 'feed' AND created")
    assert again.count() == 0


# ---- end tags that close nothing


@pytest.mark.parametrize(("source", "kept"), [
    ("<!-- </form> --><p>a</p><form><p>b</p><p>c</p>", "a b c"), ("<script>x='</form>'</script><p>a</p><form><p>b</p>", "a b"),
    ("<p>a</p><form><p>b</p></form><p>c</p>", "a c"), ("<form/><p>a</p><form><p>b</p>", "a b"), ("<p title='</form>'>a</p><form><p>b</p>", "a b"),
])
def test_only_real_end_tags_close(source, kept):
    assert sanitize(source)[2] == kept


@pytest.mark.parametrize("name", ["job_queue", "stream_ingest_revisions", "x_session", "stream_metric_rollup", "endpoint_refresh", "share_inbox", "landed_pages", "landed_stream", "ranked_listing", "outline_import", "outline_export", "math_rows", "snippet_window", "entity_spans", "entity_mentions"])
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    from tidemark.catalog import QUERIES
    from tidemark.plans.views import TABLES

    for t in TABLES:
        spark.createDataFrame([], spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
