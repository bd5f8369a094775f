from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import folding, html
from tidemark.functions.urls import canonical_url, canonical_url_spark_sql
from tidemark.operators.components import connected
from tidemark.operators.pages import Segment, align, segments, similarity
from tidemark.sources import blobs, feeds

URLS = {
    "HTTP://User@Example.ORG:80/a/?b=2&a=1&utm_x=3&fbclid=9#f": "http://User@example.org/a?a=1&b=2",
    "https://example.org:443/": "https://example.org/", "https://example.org:8443/x//": "https://example.org:8443/x/",
    "https://example.org?UTM_source=1": "https://example.org", "https://e.org/p?z&y=&z=1": "https://e.org/p?y=&z&z=1",
    "no url": "no url", "": "",
}


def test_canonical_url(spark):
    table = spark.createDataFrame([(u,) for u in [*URLS, None]], "u string")
    rows = table.select("u", canonical_url(F.col("u")).alias("c"), F.expr(canonical_url_spark_sql("u")).alias("s")).collect()
    assert {r["u"]: r["c"] for r in rows if r["u"] is not None} == URLS
    assert all(r["c"] == r["s"] for r in rows)
    again = spark.createDataFrame([(u,) for u in URLS.values() if not u.endswith("x/")], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert all(r["u"] == r["c"] for r in again)


def test_alias_spans_are_utf8_places_of_the_original():
    assert folding.alias_spans("今日在CAFÉ见面", "Cafe") == [(9, 5, "CAFÉ")]
    assert folding.alias_spans("cafeteria Cafe, decaf", "cafe") == [(10, 4, "Cafe")]
    assert folding.alias_spans("人工智能", "智能") == [(6, 6, "智能")] and folding.alias_spans("x", "") == []


@given(st.text(max_size=30), st.text(min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_alias_spans_cut_the_text(text, alias):
    raw = text.encode("utf-8", "surrogatepass")
    for start, n, own in folding.alias_spans(text, alias):
        assert raw[start : start + n].decode("utf-8", "surrogatepass") == own


@pytest.mark.parametrize(("text", "pieces"), [
    (r"a $x$ b \(y\) $$z$$ \$5", [("text", "a "), ("inline", "x"), ("text", " b "), ("inline", "y"), ("text", " "), ("display", "z"), ("text", r" \$5")]),
    (r"\\(a\\)", [("text", r"\\(a\\)")]), (r"\\\(b\)", [("text", r"\\"), ("inline", "b")]), ("$ x$", [("text", "$ x$")]), ("$y $", [("text", "$y $")]), ("$$ $$", [("text", "$$ $$")]),
    (r"$p\$q$", [("text", r"$p\$q$")]), ("5$ and 6$ $r$", [("text", "5$ and 6$ "), ("inline", "r")]), (r"\[ u \] \( \)", [("display", " u "), ("text", r" \( \)")]), ("", []), ("$", [("text", "$")]),
    ("$a$$b$", [("inline", "a"), ("inline", "b")]), ("$$$c$$", [("display", "$c")]), (r"\(open $q$", [("text", r"\(open "), ("inline", "q")]),
])
def test_math_pieces(text, pieces):
    assert folding.math_pieces(text) == pieces
    assert len(folding.math_pieces(text.replace("$", "$ ") * 20_000)) >= 0


def test_sanitizer_keeps_nothing_active():
    source = "<meta http-equiv=refresh content=0><p onclick=x()>Hi <script>bad()</script><a href='javascript:x'>l</a><a href='#top'>t</a></p><iframe src=x>y</iframe>"
    title, clean, text = html.sanitize("<title>T</title>" + source, "https://e.org/d/")
    assert title == "T" and clean == '<p>Hi <a>l</a><a href="https://e.org/d/#top">t</a></p>' and text == "Hi l t"


def test_sanitizer_math_svg_and_images():
    _, clean, _ = html.sanitize("<script type='math/tex'>x^2</script><script type='math/tex; mode=display'>\\frac{a}{b}</script>")
    assert clean == r"\(x^2\)\[\frac{a}{b}\]"
    _, clean, _ = html.sanitize("<svg onload=x()><path d='M0' fill='url(#x)'/><foreignObject><p>no</p></foreignObject><use href='#x'/></svg><math display=block><mfrac><mi>a</mi></mfrac></math>")
    assert clean == '<svg><path d="M0"></path></svg><math display="block"><mfrac><mi>a</mi></mfrac></math>'
    _, clean, _ = html.sanitize("<img data-src='b.png' src='a.gif' style='width: 30px; height: 60%'><img srcset='s.png 1x, l.png 2x'><img data-actualsrc=c.png src=d.gif>", "https://e.org/d/p")
    assert clean == '<img src="https://e.org/d/b.png" width="30" height="60%"><img src="https://e.org/d/l.png"><img src="https://e.org/d/c.png">'


@pytest.mark.parametrize("address", ["http://e.org/x.png", "https://127.0.0.1/x", "https://172.20.1.1/x", "https://192.168.0.9/x", "https://me:pw@e.org/x", "https://a.localhost/x", "//e.org/x", "javascript:x"])
def test_sanitizer_keeps_images_of_public_https_hosts_alone(address):
    assert html.sanitize(f"<img src='{address}' alt=a>")[1] == '<img alt="a">'
    assert html.sanitize("<img src='https://172.32.1.1/x'>")[1] == '<img src="https://172.32.1.1/x">'


def test_sanitizer_reads_on_after_a_tag_that_is_never_closed():
    assert html.sanitize("<p>a</p><form><p>b</p>")[1] == "<p>a</p><p>b</p>"
    assert html.sanitize("<p>a</p><form><p>b</p></form><p>c</p>")[1] == "<p>a</p><p>c</p>"
    assert html.sanitize("<nav><p>a</p><p>b")[1] == "<p>a</p><p>b"
    assert html.sanitize("<rect fill='javascript:x' width=1 stroke=url(x) onclick=y()>")[1] == '<rect width="1">'


@given(st.text("<>/abp scrit='\"=&; \n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_sanitizer_never_fails_and_never_scripts(text):
    assert "<script" not in html.sanitize(text)[1]


def test_alignment():
    whole = lambda *xs: [Segment(x) for x in xs]
    assert [x[:2] for x in align(whole("a b c d", "new words here"), whole("a b c d", "other"))] == [(0, 0), (1, None)]
    old = "the page says that the bridge will be closed for repairs until spring"
    assert align(whole(old.replace("page", "web page")), whole(old))[0][1] == 0
    assert 0 <= similarity(*whole("abc", "xyz")) <= similarity(*whole("abc", "abc")) <= 1.0 + 1e-9
    # each equal text takes the first that is left; then edits take what is left
    assert [x[1] for x in align(whole("x y z", "x y z", "x y z"), whole("x y z", "q", "x y z"))] == [0, 2, None]


def test_kinds_and_headings_of_segments():
    own = segments("# One\nThe first, long enough.\nTwo\nThe second.")
    assert [(s.kind, s.heading) for s in own] == [("heading", "# One"), ("paragraph", "# One"), ("heading", "Two"), ("paragraph", "Two")] and segments("Two") == [Segment("Two")]
    head, below = own[2], own[3]
    assert similarity(head, Segment("Two", "paragraph", "Two")) == 0 and similarity(head, Segment("Two")) == pytest.approx(0.9)
    assert similarity(below, below._replace(heading="# One")) == pytest.approx(0.9) and similarity(below, below) == pytest.approx(1)
    assert similarity(Segment(""), Segment("")) == pytest.approx(1) and similarity(Segment("a"), Segment("a")) == pytest.approx(1)


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=5, deadline=None)
def test_components_equal_union_find(edges):
    from pyspark.sql import SparkSession

    parent = list(range(13))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(set)
    for x in {x for e in edges if e[0] != e[1] for x in e}:
        groups[root(x)].add(x)
    spark = SparkSession.getActiveSession()
    found = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["item_id"], r["group_id"]) for r in found.collect()} == {(x, min(g)) for g in groups.values() for x in g}


def test_feeds(spark):
    rss = "<rss><channel><title>C</title><item><guid>g1</guid><link>http://e/1</link><title>One</title><pubDate>d</pubDate></item><item><link>http://e/2</link><title>Two</title></item><item><title>Three</title><pubDate>p</pubDate></item></channel></rss>"
    atom = "<feed><title>F</title><entry><id>a1</id><title>A</title><link href='http://e/self' rel='self'/><link href='http://e/a'/></entry><entry><id>a2</id><title>B</title><link href='http://e/b' rel='alternate'/></entry></feed>"
    js = '{"items": [{"id": "j1", "url": "http://e/j", "title": "J", "author": {"name": "N"}}]}'
    raw = lambda x: spark.createDataFrame([("s", x)], "source_id string, body string")
    assert [r["external_id"] for r in feeds.rss(raw(rss)).collect()] == ["g1", "http://e/2", "Three|p"]
    assert feeds.rss(raw(rss), most=1).count() == 1
    assert [(r["external_id"], r["canonical_url"]) for r in feeds.atom(raw(atom)).collect()] == [("a1", "http://e/a"), ("a2", "http://e/b")]
    assert [(r["external_id"], r["author"]) for r in feeds.json_feed(raw(js)).collect()] == [("j1", "N")]
    seen = spark.createDataFrame([("s", "g1")], "source_id string, external_id string")
    assert feeds.unseen(feeds.rss(raw(rss)), seen).count() == 2


def test_opml(spark):
    text = "<opml><body><outline text='Tech'><outline text='A &amp; B' xmlUrl='http://e/a?token=1&amp;x=2'/></outline><outline text='Top' xmlUrl='http://e/t'/></body></opml>"
    found = feeds.opml(spark.createDataFrame([("s", text)], "source_id string, body string"))
    assert {(r["path"], r["title"]) for r in found.collect()} == {("", "Top"), ("/Tech", "A & B")}
    lines = [r["line"] for r in feeds.to_opml(found).collect()]
    assert lines[1] == '<outline type="rss" text="A &amp; B" xmlUrl="http://e/a?token=&amp;x=2"/>'


def test_blobs(spark, tmp_path):
    rows = blobs.blob_rows(spark.createDataFrame([("x",), ("x",), (None,)], "t string"), "t").collect()
    assert len(rows) == 1 and rows[0]["relative_path"].endswith(rows[0]["sha256"])
    (tmp_path / rows[0]["sha256"]).write_bytes(b"x")
    (tmp_path / "wrong").write_bytes(b"y")
    assert sorted(r["is_valid"] for r in blobs.read_files(spark, str(tmp_path)).collect()) == [False, True]


@pytest.mark.parametrize("text", ["é", "ﬁ Ａ", "Straße  X"])
def test_folding(spark, text):
    row = spark.createDataFrame([(text,), (None,)], "t string").select(folding.fold_key("t").alias("k"), folding.nfkc_lower("t").alias("n")).first()
    assert row["k"] == folding.fold(text)
