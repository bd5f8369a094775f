"""Outlines of sources: trees written from paths, and read back into folders and subscriptions.

A tree is written without recursion: every opening tag, feed and closing tag is a row with a key under which rows stand in the tree's order.
Reading goes the other way: tags get their depth by a running sum, their parent from the last tag one level up, and folders their path by a
recursive query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions.folding import nfc
from tidemark.functions.urls import canonical_url
from tidemark.plans.dialect import DUCK, SPARK, Dialect
from tidemark.plans.run import duck_sql, spark_query
from tidemark.plans.scratch import written

#: Fragments of attribute names that hint at a secret, and attributes that say what an outline is.
SECRET = ("token", "secret", "password", "credential", "cookie", "authorization")
STRUCTURAL = ("text", "title", "type", "xmlurl", "htmlurl")
#: Kinds of rows in a tree: a folder's feeds come before its folders; at the top, feeds without a folder come last.
FEED, FOLDER, LOOSE, CLOSE = "0", "1", "2", "9"


def _xml(x: str) -> str:
    """SQL, for both engines, of an attribute's value."""
    for c, by in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        x = f"replace({x}, '{c}', '{by}')"
    return x


def tree_lines(d: Dialect, folders: str, feeds: str) -> str:
    """doc_id, key, line: the body's lines of each document, in order of key.

    folders: SQL of (doc_id, path_key, name, depth from 1, order_key, attributes): order_key is the concatenation, from the top, of each folder's
    `1`, six digits of its place, name and chr(1). feeds: SQL of (doc_id, order_key of the folder or '', place, name, xml_url, html_url, connector).
    """
    pad = lambda depth: f"repeat('  ', CAST({depth} + 1 AS INT))"
    tag = lambda *xs: "concat(" + ", ".join(xs) + ")"
    depth = f"(length(order_key) - length(replace(order_key, chr(1), '')))"
    feed = tag(pad(f"{depth} + 1"), "'<outline text=\"'", _xml("name"), "'\" title=\"'", _xml("name"), "'\" type=\"rss\" xmlUrl=\"'", _xml("xml_url"), "'\"'", f"CASE WHEN html_url IS NULL THEN '' ELSE concat(' htmlUrl=\"', {_xml('html_url')}, '\"') END", "' connector=\"'", _xml("connector"), "'\" />'")
    return f"""SELECT doc_id, order_key AS key, {tag(pad("depth"), "'<outline text=\"'", _xml("name"), "'\" title=\"'", _xml("name"), "'\"'", "attributes", "'>'")} AS line FROM ({folders}) f
        UNION ALL SELECT doc_id, concat(order_key, '{CLOSE}') AS key, {tag(pad("depth"), "'</outline>'")} AS line FROM ({folders}) g
        UNION ALL SELECT doc_id, concat(order_key, CASE WHEN order_key = '' THEN '{LOOSE}' ELSE '{FEED}' END, lpad(CAST(place AS {'STRING' if d.spark else 'VARCHAR'}), 10, '0'), name) AS key, {feed} AS line FROM ({feeds}) h WHERE xml_url IS NOT NULL"""


def _made_tree(d: Dialect) -> tuple[str, str]:
    """Folders and feeds of the sources: a document for each ecosystem, folders by independence group and by whether a source is followed."""
    group, inner = "concat(independence_group, ' & co')", "CASE WHEN is_followed THEN 'Followed' ELSE 'Others' END"
    first = f"concat('{FOLDER}', '000000', {group}, chr(1))"
    second = f"concat({first}, '{FOLDER}', CASE WHEN is_followed THEN '000000' ELSE '000001' END, {inner}, chr(1))"
    sources = "(SELECT * FROM v_sources WHERE source_id IS NOT NULL) s"
    folders = f"""SELECT DISTINCT ecosystem AS doc_id, {group} AS path_key, {group} AS name, 1 AS depth, {first} AS order_key, concat(' color="', substr(independence_group, 1, 3), '"') AS attributes FROM {sources} WHERE source_id % 10 <> 9
        UNION ALL SELECT DISTINCT ecosystem, concat({group}, '/', {inner}), {inner}, 2, {second}, '' FROM {sources} WHERE source_id % 10 <> 9"""
    string = "STRING" if d.spark else "VARCHAR"
    feeds = f"""SELECT ecosystem AS doc_id, CASE WHEN source_id % 10 = 9 THEN '' WHEN source_id % 10 = 8 THEN {first} ELSE {second} END AS order_key, source_id AS place, display_name AS name,
        CASE WHEN source_id % 12 = 11 THEN concat('ftp://e.org/', CAST(source_id AS {string})) ELSE concat('https://E.org/', CAST(source_id % 40 AS {string}), '?utm_source=x&b=1') END AS xml_url, CASE WHEN source_id % 4 = 0 THEN 'https://e.org/' END AS html_url, 'rss' AS connector FROM {sources}"""
    return folders, feeds


def outline_export(d: Dialect) -> str:
    """The lines of each ecosystem's outline with their places."""
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY key) - 1 AS place, line FROM ({tree_lines(d, *_made_tree(d))}) x"


def documents(lines: DataFrame) -> DataFrame:
    """doc_id, body: whole outline documents from (doc_id, key, line)."""
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key", "line"))).alias("rows"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head><title>Sources</title></head>\n  <body>\n'
    return rows.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n  </body>\n</opml>")).alias("body"))


def _plain(x: Column) -> Column:
    """An attribute's value without escapes."""
    for by, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(by), F.lit(c))
    return x


def outline_nodes(raw: DataFrame) -> DataFrame:
    """doc_id, node, parent (null at the top), sort_order, depth, title, feed_url, html_url, attributes of each outline of (doc_id, body).

    attributes leaves out what is structural and what may be a secret. A tag is read by its attributes in double quotes; comments are skipped.
    """
    tags = F.regexp_extract_all(F.regexp_replace("body", "(?s)<!--.*?-->", ""), F.lit(r"""(?is)<outline\b(?:[^>"]|"[^"]*")*>|</outline\s*>"""), F.lit(0))
    rows = raw.select("doc_id", F.posexplode(tags).alias("node", "tag"))
    closes, alone = F.col("tag").startswith("</"), F.col("tag").endswith("/>")
    rows = rows.withColumn("step", F.when(closes, -1).when(alone, 0).otherwise(1))
    ahead = Window.partitionBy("doc_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("depth", F.coalesce(F.sum("step").over(ahead), F.lit(0))).where(~closes)
    # an opening tag is a parent for the level below it: both stand in that level in the order of the text
    levels = rows.select("doc_id", "node", "tag", "depth", F.col("depth").alias("level"), F.lit(None).cast("int").alias("opens"))
    opened = rows.where("step = 1").select("doc_id", "node", "tag", "depth", (F.col("depth") + 1).alias("level"), F.col("node").alias("opens"))
    before = Window.partitionBy("doc_id", "level").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = levels.unionByName(opened).withColumn("parent", F.last("opens", ignorenulls=True).over(before)).where("opens IS NULL")
    pattern = r"""([A-Za-z_:][\w:.-]*)\s*=\s*"([^"]*)\""""
    names = F.transform(F.regexp_extract_all("tag", F.lit(pattern), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all("tag", F.lit(pattern), F.lit(2)), _plain)
    told = F.map_from_entries(F.array_distinct(F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: F.struct(x["k"], x["v"]))))
    found = found.withColumn("a", told).withColumn("parent", F.when(F.col("depth") > 0, F.col("parent")))
    safe = F.map_filter("a", lambda k, v: ~k.isin(*STRUCTURAL) & ~F.exists(F.array(*map(F.lit, SECRET)), lambda s: F.contains(k, s)))
    place = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("node")) - 1
    return found.select("doc_id", "node", "parent", place.alias("sort_order"), "depth", F.coalesce(F.element_at("a", "title"), F.element_at("a", "text"), F.lit("")).alias("title"), F.element_at("a", "xmlurl").alias("feed_url"), F.element_at("a", "htmlurl").alias("html_url"), safe.alias("attributes"))


def imported(raw: DataFrame, subscribed: DataFrame) -> DataFrame:
    """doc_id, kind, path_key, parent_key, title, sort_order, attributes, message, created: what an import makes of each outline.

    Folders are keyed by their path; a feed is imported, subscribed already (by canonical URL among subscribed, column url, or earlier in the
    import), or fails for its address. created says whether the import adds anything: folders once for each path, feeds once for each address.
    """
    spark = raw.sparkSession
    part = F.trim(F.replace(nfc("title"), F.lit("/"), F.lit("∕")))
    nodes = written(outline_nodes(raw).withColumn("part", part), "outline")
    paths = spark.sql(
        """WITH RECURSIVE p AS (SELECT doc_id, node, part AS path_key, CAST(NULL AS STRING) AS parent_key FROM {n} WHERE parent IS NULL
        UNION ALL SELECT n.doc_id, n.node, concat(p.path_key, '/', n.part), p.path_key FROM p JOIN {n} n ON n.doc_id = p.doc_id AND n.parent = p.node) SELECT * FROM p""",
        n=nodes,
    )
    found = nodes.join(paths, ["doc_id", "node"]).withColumn("url", canonical_url(F.col("feed_url")))
    known = subscribed.select(canonical_url(F.col("url")).alias("url")).distinct().withColumn("known", F.lit(True))
    found = found.join(known, "url", "left")
    fails = ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))
    # outlines without address stand alone
    again = F.row_number().over(Window.partitionBy("url", F.when(F.col("url").isNull(), F.struct("doc_id", "node"))).orderBy("doc_id", "node")) > 1
    message = F.when(F.col("feed_url").isNull(), "Folder").when(fails, "Unsupported").when(F.col("known") | again, "Already subscribed").otherwise("Imported")
    first = F.row_number().over(Window.partitionBy("doc_id", "feed_url", "path_key").orderBy("node")) == 1
    found = found.withColumn("message", message).withColumn("created", F.when(F.col("feed_url").isNull(), first).otherwise(F.col("message") == "Imported"))
    return found.select("doc_id", F.when(F.col("feed_url").isNull(), "folder").otherwise("feed").alias("kind"), "path_key", "parent_key", "title", "sort_order", "attributes", "message", "created", "url")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark_query(lambda d: tree_lines(d, *_made_tree(d)))(spark, sf_dir))


def outline_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ecosystems' outlines imported twice: each folder and feed with its outcome, and what the second import creates: nothing."""
    raw = written(_bodies(spark, sf_dir), "outlines")
    had = spark_query(lambda d: "SELECT concat('https://e.org/', CAST(source_id AS STRING), '?b=1') AS url FROM v_sources WHERE source_id % 3 = 0")(spark, sf_dir)
    first = written(imported(raw, had), "first")
    second = imported(raw, had.union(first.where("message = 'Imported'").select("url")))
    paths = first.where("kind = 'folder'").select("doc_id", "path_key").distinct()
    news = second.where("kind = 'feed' AND created").select("doc_id", "path_key").union(second.where("kind = 'folder'").join(paths, ["doc_id", "path_key"], "left_anti").select("doc_id", "path_key")).count()
    named = F.expr(t.name_uuid(SPARK, "concat(doc_id, ':', path_key)"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return first.select("doc_id", "kind", "path_key", "parent_key", "title", F.col("sort_order").cast("long").alias("sort_order"), shown.alias("attributes"), "message", "created", F.when(F.col("kind") == "folder", named).alias("folder_id"), F.lit(news).alias("second"))


def _import_sql(d: Dialect) -> str:
    """The same from the tables, without any document."""
    folders, feeds = _made_tree(d)
    above = "list_filter(string_split(order_key, chr(1)), lambda x: x <> '')"
    path = f"array_to_string(list_transform({above}, lambda x: substr(x, 8)), '/')"
    at = "row_number() OVER (PARTITION BY doc_id, parent_key ORDER BY key) - 1"
    url = "regexp_replace(replace(xml_url, 'E.org', 'e.org'), '[?]utm_source=x&b=1$', '?b=1')"
    return f"""WITH n AS (SELECT doc_id, 'folder' AS kind, path_key, CASE WHEN depth > 1 THEN split_part(path_key, '/', 1) END AS parent_key, name AS title, order_key AS key, CASE WHEN depth = 1 THEN concat('color=', substr(name, 1, 3)) ELSE '' END AS attributes, NULL AS xml_url FROM ({folders}) f
        UNION ALL SELECT doc_id, 'feed', CASE WHEN order_key = '' THEN name ELSE concat({path}, '/', name) END, CASE WHEN order_key <> '' THEN {path} END, name, concat(order_key, CASE WHEN order_key = '' THEN '{LOOSE}' ELSE '{FEED}' END, lpad(CAST(place AS VARCHAR), 10, '0'), name), 'connector=rss', xml_url FROM ({feeds}) h),
        u AS (SELECT *, {at} AS sort_order, CASE WHEN starts_with(xml_url, 'http') THEN {url} END AS url FROM n),
        k AS (SELECT DISTINCT concat('https://e.org/', CAST(source_id AS VARCHAR), '?b=1') AS url FROM v_sources WHERE source_id % 3 = 0),
        m AS (SELECT u.*, CASE WHEN kind = 'folder' THEN 'Folder' WHEN u.url IS NULL THEN 'Unsupported' WHEN k.url IS NOT NULL OR row_number() OVER (PARTITION BY u.url ORDER BY doc_id, key) > 1 THEN 'Already subscribed' ELSE 'Imported' END AS message FROM u LEFT JOIN k ON k.url = u.url)
        SELECT doc_id, kind, path_key, parent_key, title, sort_order, attributes, message, kind = 'folder' OR message = 'Imported' AS created, CASE WHEN kind = 'folder' THEN {t.name_uuid(DUCK, "concat(doc_id, ':', path_key)")} END AS folder_id, 0 AS second FROM m"""


QUERIES = {"outline_export": outline_export}
SPARK_QUERIES = {"outline_import": outline_import}
ORACLES = {"outline_import": duck_sql(_import_sql)}
