"""Readers of landed documents over documents that are made from the tables at hand, and the state of derived tables and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.dialect import SPARK, Dialect
from tidemark.plans.published import current, publish, synchronised
from tidemark.plans.run import Query, duck_sql, spark_query
from tidemark.plans.scratch import scratch_path
from tidemark.sources import api_pages, blobs, feeds

#: Entries that a made feed lists, of which a refresh reads the first thirty; and posts of a page of a made listing, which goes on to the last post.
LISTED, READ, PAGE = 40, 30, 100


def _recent(d: Dialect, where: str = f"place < {LISTED}") -> str:
    return f"SELECT source_id, item_id, title, place, CAST(floor(place / {PAGE}.0) AS BIGINT) AS page FROM (SELECT source_id, item_id, substr({d.replace_all('title', '[^A-Za-z0-9 ]', chr(39) * 2)}, 1, 60) AS title, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, item_id) - 1 AS place FROM v_items) x WHERE {where}"


def _entries(entry, head: str, foot: str, between: str = "", items: str | None = None) -> str:
    """SQL of a document for each page of each source from its items in order."""
    return f"SELECT source_id, concat('{head}', array_join(transform(array_sort(collect_list(struct(place, {entry} AS e))), x -> x.e), '{between}'), '{foot}') AS body FROM ({items or _recent(SPARK)}) GROUP BY source_id, page"


def feed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS, Atom and JSON feeds of each source's recent items, read back: the first thirty entries that no cursor has seen."""
    link = "'https://e.org/', item_id"
    rss = _entries(f"concat('<item><guid>g', item_id, '</guid><link>', {link}, '</link><title>', title, '</title></item>')", "<rss><channel>", "</channel></rss>")
    atom = _entries(f"concat('<entry><id>g', item_id, '</id><link rel=\"alternate\" href=\"', {link}, '\"/><title>', title, '</title></entry>')", "<feed>", "</feed>")
    json = _entries(f"concat('{{\"id\":\"g', item_id, '\",\"url\":\"', {link}, '\",\"title\":\"', title, '\"}}')", '{"items":[', "]}", ",")
    seen = spark_query(lambda d: "SELECT source_id, concat('g', item_id) AS external_id FROM v_items WHERE item_id % 10 = 0")(spark, sf_dir)
    read = [reader(spark_query(lambda d, q=q: q)(spark, sf_dir), READ).select(F.lit(kind).alias("kind"), "source_id", "external_id", "canonical_url", F.trim("title").alias("title")) for kind, q, reader in (("rss", rss, feeds.rss), ("atom", atom, feeds.atom), ("json", json, feeds.json_feed))]
    return feeds.unseen(read[0].unionByName(read[1]).unionByName(read[2]), seen)


def forum_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of each source's items, page by page to the last, read back with the cursor that follows; removed posts are deleted, not dropped."""
    child = "concat('{\"data\":{\"name\":\"t3_', item_id, '\",\"title\":\"', title, '\",\"permalink\":\"/r/', source_id, '/', item_id, '\",\"score\":', item_id, if(item_id % 9 = 0, ',\"removed_by_category\":\"moderator\"', ''), '}}')"
    raw = spark_query(lambda d: _entries(child, '{"data":{"after":"t3_next","children":[', "]}}", ",", _recent(SPARK, "TRUE")))(spark, sf_dir).withColumnRenamed("source_id", "endpoint_id")
    found = api_pages.forum_posts(raw)
    return found.select("endpoint_id", "external_id", "canonical_url", F.trim("title").alias("title"), "deletion_state", "next_cursor", F.element_at("metrics", "score").alias("score"))


#: Releases of a page.
RELEASES = 20


def _releases(d: Dialect) -> str:
    """Each source's items as releases, some without a name or a date of publication."""
    string = "STRING" if d.spark else "VARCHAR"
    item = f"CAST(item_id AS {string})"
    return f"""SELECT source_id, item_id, place, page, CAST(NULL AS {string}) AS nothing, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE title END AS name, concat('v', {item}) AS tag, concat('https://e.org/r/', {item}) AS url,
        CASE WHEN item_id % 3 <> 0 THEN concat('p', {item}) END AS published_at, concat('c', {item}) AS created_at FROM (SELECT source_id, item_id, title, place, CAST(floor(place / {RELEASES}.0) AS BIGINT) AS page FROM ({_recent(d, 'TRUE')}) r) x"""


def release_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of releases of each source, read back with the cursor that follows: none after a page that is not full."""
    rows = spark_query(_releases)(spark, sf_dir)
    made = F.struct(F.col("item_id").alias("id"), F.col("url").alias("html_url"), "name", F.col("tag").alias("tag_name"), F.col("tag").alias("body"), "created_at", "published_at", F.struct(F.concat(F.lit("by "), "source_id").alias("login")).alias("author"))
    pages = rows.groupBy(F.col("source_id").alias("endpoint_id"), "page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", made.alias("r")))), lambda x: x["r"])).alias("body"))
    found = api_pages.code_releases(pages)
    return found.select("endpoint_id", "external_id", "canonical_url", F.trim("title").alias("title"), "author", "published", "next_cursor", F.array_join("topics", ",").alias("topics"))


def _releases_sql(d: Dialect) -> str:
    return f"""SELECT source_id AS endpoint_id, concat('release:', item_id) AS external_id, url AS canonical_url, trim(coalesce(nullif(name, ''), tag)) AS title, concat('by ', source_id) AS author, coalesce(published_at, created_at) AS published,
        CASE WHEN count(*) OVER (PARTITION BY source_id, page) >= {RELEASES} THEN CAST(page + 1 AS VARCHAR) END AS next_cursor, concat('release,', tag) AS topics FROM ({_releases(d)}) x"""


def outline_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as an outline nested by ecosystem, group and standing, read back with their folders, however deep."""
    feed = "concat('<outline type=\"rss\" text=\"', display_name, '\" xmlUrl=\"https://e.org/', source_id, '\"/>')"
    folder = lambda name, inside: f"concat('<outline text=\"', {name}, '\">', {inside}, '</outline>')"
    deep = folder("ecosystem", folder("independence_group", folder("if(is_followed, 'followed', 'other')", folder("'a'", folder("'b'", feed)))))
    raw = spark_query(lambda d: f"SELECT source_id, concat('<opml><body>', {deep}, '</body></opml>') AS body FROM v_sources")(spark, sf_dir)
    return feeds.opml(raw).select("source_id", "path", "title", "xml_url")


def blob_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed blobs of pages: one for each different content, with path and size."""
    raw = spark_query(lambda d: "SELECT html FROM v_pages")(spark, sf_dir)
    return blobs.blob_rows(raw, "html").select("sha256", "relative_path", "byte_count")


def index_synchronise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What brings an index of a generation ago up to date; the new generation is published once, then it is current."""
    documents = spark_query(lambda d: "SELECT item_id, content_hash FROM v_items WHERE item_id % 11 <> 0")(spark, sf_dir)
    before = spark_query(lambda d: "SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM v_items WHERE item_id % 5 <> 0")(spark, sf_dir)
    root = scratch_path(spark, "published")
    publish(before, root, "lexical", 1)
    _, index = current(spark, root, "lexical")
    changes = synchronised(index, documents, "item_id", "content_hash")
    if publish(documents, root, "lexical", 2) and publish(documents, root, "lexical", 2):
        raise AssertionError("a generation was written twice")
    generation, now = current(spark, root, "lexical")
    left = synchronised(now, documents, "item_id", "content_hash").where("action <> 'kept'").count()
    return changes.withColumns({"generation": F.lit(generation), "left": F.lit(left)})


def job_states(d: Dialect) -> str:
    """Jobs by the last thing that happened to them: enqueued once, leased with a token, renewed, completed, or failed and due again."""
    last = lambda x: f"{'max_by' if d.spark else 'arg_max'}({x}, captured_at * 10000000 + event_id)"
    string = "STRING" if d.spark else "VARCHAR"
    count = lambda m: f"sum(CASE WHEN metric = '{m}' THEN 1 ELSE 0 END)"
    token = d.sha256(f"concat(CAST(job_id AS {string}), ':', CAST(attempts AS {string}))")
    return f"""SELECT job_id, CASE last_metric WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'pending' WHEN 'signup' THEN 'pending' ELSE 'leased' END AS state, attempts,
        CASE WHEN last_metric IN ('click', 'view') THEN substr({token}, 1, 16) END AS lease_token, CASE WHEN last_metric IN ('click', 'view') THEN last_at + 300 END AS lease_expires_at,
        CASE WHEN last_metric = 'error' THEN last_at + CAST(least(21600, power(2, least(failures, 10)) * 15) AS BIGINT) END AS next_attempt_at FROM (
        SELECT item_id AS job_id, {last('metric')} AS last_metric, max(captured_at) AS last_at, CAST({count('click')} AS BIGINT) AS attempts, CAST({count('error')} AS BIGINT) AS failures FROM v_metrics GROUP BY item_id) x"""


def _feeds_sql(d: Dialect) -> str:
    one = "SELECT '{}' AS kind, source_id, concat('g', item_id) AS external_id, concat('https://e.org/', item_id) AS canonical_url, trim(title) AS title FROM r WHERE place < {} AND item_id % 10 <> 0"
    return f"WITH r AS ({_recent(d)}) " + " UNION ALL ".join(one.format(k, READ) for k in ("rss", "atom", "json"))


def _forum_sql(d: Dialect) -> str:
    return f"SELECT source_id AS endpoint_id, concat('t3_', item_id) AS external_id, concat('https://www.reddit.com/r/', source_id, '/', item_id) AS canonical_url, trim(title) AS title, CASE WHEN item_id % 9 = 0 THEN 'deleted' ELSE 'available' END AS deletion_state, 't3_next' AS next_cursor, CAST(item_id AS DOUBLE) AS score FROM ({_recent(d, 'TRUE')}) r"


def _outline_sql(d: Dialect) -> str:
    return "SELECT source_id, concat('/', ecosystem, '/', independence_group, '/', CASE WHEN is_followed THEN 'followed' ELSE 'other' END, '/a/b') AS path, display_name AS title, concat('https://e.org/', source_id) AS xml_url FROM v_sources"


def _blobs_sql(d: Dialect) -> str:
    return "SELECT DISTINCT h AS sha256, concat(substr(h, 1, 2), '/', substr(h, 3, 2), '/', h) AS relative_path, CAST(strlen(html) AS BIGINT) AS byte_count FROM (SELECT html, sha256(html) AS h FROM v_pages WHERE html IS NOT NULL) x"


def _sync_sql(d: Dialect) -> str:
    return """SELECT coalesce(o.item_id, n.item_id) AS item_id, CASE WHEN o.item_id IS NULL THEN 'added' WHEN n.item_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'kept' ELSE 'changed' END AS action, 2 AS generation, 0 AS "left"
        FROM (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'old' ELSE content_hash END AS h FROM v_items WHERE item_id % 5 <> 0) o FULL OUTER JOIN (SELECT item_id, content_hash AS h FROM v_items WHERE item_id % 11 <> 0) n ON n.item_id = o.item_id"""


QUERIES: dict[str, Query] = {"job_states": job_states}
SPARK_QUERIES = {f.__name__: f for f in (feed_candidates, forum_candidates, release_candidates, outline_feeds, blob_addresses, index_synchronise)}
ORACLES = {"feed_candidates": duck_sql(_feeds_sql), "forum_candidates": duck_sql(_forum_sql), "release_candidates": duck_sql(_releases_sql), "outline_feeds": duck_sql(_outline_sql), "blob_addresses": duck_sql(_blobs_sql), "index_synchronise": duck_sql(_sync_sql)}
