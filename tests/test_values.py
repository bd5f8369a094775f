"""Queries that SQL does not express, against plain Python; published generations and the ledger, step by step."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.catalog import QUERIES
from tidemark.functions import folding, html
from tidemark.operators.pages import align, segments
from tidemark.plans import published
from tidemark.sources import feeds, registry
from tidemark.streaming.ingest import ledgered

DATA = "/root/testdata/sf0.001"


def test_pages_are_sanitized_each_by_itself(spark):
    pages = {r["page_id"]: (r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = {r["page_id"]: r for r in QUERIES["html_sanitize"](spark, DATA).collect()}
    bodies = {r["page_id"]: r for r in QUERIES["readable_extract"](spark, DATA).collect()}
    assert set(found) == set(bodies) == set(pages)
    for i, (url, source) in pages.items():
        title, clean, text = html.sanitize(source, url)
        assert (found[i]["title"], found[i]["html_hash"], found[i]["plain_n"]) == (title, hashlib.sha256(clean.encode()).hexdigest(), len(text))
        body = html.readable(source, url)
        assert (bodies[i]["accepted"], bodies[i]["body"]) == (len(body) >= 200, body if len(body) >= 200 else None)


def test_names_are_folded_row_by_row(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {r["doc_id"]: r["key"] for r in QUERIES["folded_names"](spark, DATA).collect()}
    assert found == {i: None if t is None else folding.fold(t.split("\n")[0]) for i, t in texts.items()}


def test_revisions_align_turn_by_turn(spark):
    by_conv, want = defaultdict(list), []
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").where("text is not null").collect():
        by_conv[r["conv_id"]].append((r["turn"], r["text"]))
    for conv, turns in by_conv.items():
        turns.sort()
        for (_, old), (turn, new) in zip(turns, turns[1:], strict=False):
            want += [(conv, turn, i, -1 if j is None else j, round(s, 6)) for i, j, s in align(segments(new), segments(old))]
    found = QUERIES["revision_alignment_fuzzy"](spark, DATA).select("conv_id", "turn", "place", F.coalesce("prior", F.lit(-1)), "similarity")
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_generations_are_seen_whole_and_written_once(spark, tmp_path):
    root, rows = f"file://{tmp_path}", lambda n: spark.range(n).select("id", F.lit(n).alias("mark"))
    assert published.current(spark, root, "a") is None
    assert published.publish(rows(3), root, "a", 1) and not published.publish(rows(9), root, "a", 1)
    broken = tmp_path / "a" / "generation=5"
    broken.mkdir()  # a writer that broke off leaves no success mark
    assert published.current(spark, root, "a")[0] == 1 and published.current(spark, root, "a")[1].count() == 3
    assert published.publish(rows(4), root, "a", 5) and published.publish(rows(5), root, "a", 6)
    assert published.prune(spark, root, "a") == [1] and published.generations(spark, root, "a") == [5, 6]
    changes = published.synchronised(rows(4).where("id > 0"), rows(5).withColumn("mark", F.when(F.col("id") == 2, 4).otherwise(F.col("mark"))), "id", "mark")
    assert sorted(map(tuple, changes.collect())) == [(0, "added"), (1, "changed"), (2, "kept"), (3, "changed"), (4, "added")]


def test_ledger_keeps_the_first_arrival_over_batches(spark, tmp_path):
    schema = "item_id long, content_hash string, ordinal long"
    path = f"{tmp_path}/in"
    stream = lambda: spark.readStream.schema(schema).parquet(path)
    spark.createDataFrame([(1, "a", 5), (1, "b", 7), (1, "a", 6), (2, "a", 1)], schema).write.parquet(path)
    first = ledgered(stream(), f"{tmp_path}/out")
    assert sorted(map(tuple, first.collect())) == [(1, "a", 5, 1), (1, "b", 7, 2), (2, "a", 1, 1)]
    spark.createDataFrame([(1, "a", 1), (1, "c", 2), (3, "z", 1)], schema).write.mode("append").parquet(path)
    again = ledgered(stream(), f"{tmp_path}/out")
    assert sorted(map(tuple, again.collect())) == [(1, "a", 5, 1), (1, "b", 7, 2), (1, "c", 2, 3), (2, "a", 1, 1), (3, "z", 1, 1)]


def test_outlines_of_any_depth_are_read(spark):
    deep = "<outline text='f'>" * 7 + "<outline text='x' xmlUrl='http://e/x'/>" + "</outline>" * 7
    raw = spark.createDataFrame([("s", f"<opml><body><outline text='t' xmlUrl='http://e/t'/>{deep}</body></opml>")], "source_id string, body string")
    assert sorted((r["path"], r["title"]) for r in feeds.opml(raw).collect()) == [("", "t"), ("/f" * 7, "x")]


def test_refreshes_move_their_cursors(spark):
    items = "".join(f"<item><guid>{i}</guid><title>t{i}</title></item>" for i in range(40))
    raw = spark.createDataFrame([("s", f"<rss><channel>{items}</channel></rss>")], "source_id string, body string")
    found, cursor = registry.refresh("rss", raw)
    assert sorted(int(r["external_id"]) for r in found.collect()) == list(range(30)) and cursor.count() == 30
    assert registry.refresh("rss", raw, cursor)[0].count() == 0
    shorter = "".join(f"<item><guid>{i}</guid><title>t{i}</title></item>" for i in range(20, 40))
    later = spark.createDataFrame([("s", f"<rss><channel>{shorter}</channel></rss>")], "source_id string, body string")
    assert sorted(int(r["external_id"]) for r in registry.refresh("rss", later, cursor)[0].collect()) == list(range(30, 40))
    page = lambda after: '{"data":{"after":%s,"children":[{"data":{"name":"n","title":"t","permalink":"/p"}}]}}' % after
    pages = spark.createDataFrame([("a", page('"t3_x"')), ("b", page("null"))], "endpoint_id string, body string")
    assert sorted(map(tuple, registry.refresh("reddit", pages)[1].collect())) == [("a", "t3_x", False), ("b", None, True)]


def test_words_are_found_whatever_their_case_marks_width_or_composition(spark, tmp_path):
    long_ = "x" * 300
    texts = ["ein CAFÉHAUS hier", "ｃａｆｅｈａｕｓ", f"{long_} caféhaus {long_}", "cafehausen", None, "cafeh aus"]
    spark.createDataFrame([(i, t, "de", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "das Caféhaus an der"), (8, None), (9, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["item_id"]: r["snippet"] for r in QUERIES["snippet_window"](spark, str(tmp_path)).collect()}
    assert sorted(found) == [0, 1, 2] and found[1] == texts[1] and found[2] == "…" + texts[2][191:411] + "…"


def test_rows_of_formulas_are_the_pieces_of_each_text(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").collect()}
    found = defaultdict(list)
    for r in QUERIES["math_rows"](spark, DATA).collect():
        found[r["item_id"]].append((r["place"], r["kind"], r["content_hash"]))
    for i, text in texts.items():
        title = text.split("\n")[0]
        body = text if i % 5 else f"{text} so \\(x_{i}\\) and $a+{i}$, not \\$5 but $${title}$$"
        marked = any(m in body for m in ("$", "\\(", "\\["))
        want = [(n, kind, hashlib.sha256(content.encode()).hexdigest()) for n, (kind, content) in enumerate(folding.math_pieces(body))] if marked else []
        assert sorted(found.get(i, [])) == want
    assert sum(k == "inline" for own in found.values() for _, k, _ in own) >= 2 * len([i for i in texts if i % 5 == 0])
