"""Refreshes with stored cursors, and an inbox, as streams over landed files.

A refresh run takes what has landed since the run before, a bounded number of files a batch. A batch writes its candidates and the endpoints' cursors
in folders of its own number, so a batch that is run again after a failure replaces what it had written, and a cursor never runs ahead of its
candidates. Ids seen within the watermark are dropped. The inbox reads files of shared records once each and then moves them away.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions.urls import canonical_url, canonical_url_sql
from tidemark.plans.dialect import DUCK, SPARK, Dialect
from tidemark.plans.run import duck_sql, spark_query
from tidemark.plans.scratch import folder, scratch_path, table_at

#: A landed page's rows: its candidates by place, and a row of place -1 that says what follows.
PAGE_ROW = "endpoint_id string, page long, place long, external_id string, title string, next_cursor string, landed_at timestamp"
#: Files that a batch takes at most, and how long ids are remembered.
FILES, SEEN = 4, "1 day"


def refresh(landed: DataFrame, store: str) -> None:
    """Runs a stream of PAGE_ROWs to its end into store: candidates (each id of an endpoint once) and cursors, a folder for each batch.

    Rows without endpoint or external id are dropped, but for the pages' own rows.
    """
    key = F.when(F.col("place") < 0, F.concat(F.lit("page-"), F.col("page").cast("string"))).otherwise(F.concat(F.lit("item-"), "external_id"))
    fresh = landed.withColumn("key", key).where("endpoint_id IS NOT NULL AND key IS NOT NULL").withWatermark("landed_at", SEEN).dropDuplicatesWithinWatermark(["endpoint_id", "key"])

    def commit(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        rows.where("place >= 0").select("endpoint_id", "external_id", "title").write.mode("overwrite").parquet(f"{store}/candidates/batch={batch}")
        last = F.max_by(F.struct("page", "next_cursor"), "page")
        moved = rows.groupBy("endpoint_id").agg(last.alias("l"), F.count_if(F.col("place") >= 0).alias("items"))
        moved.select("endpoint_id", F.col("l.page").alias("page"), F.col("l.next_cursor").alias("next_cursor"), "items").write.mode("overwrite").parquet(f"{store}/cursors/batch={batch}")
        rows.unpersist()

    fresh.writeStream.option("checkpointLocation", f"{store}/log").trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()


def cursors(spark: SparkSession, store: str) -> DataFrame:
    """endpoint_id, page, next_cursor, reached_end, items: where each endpoint's next run begins, and how many items it has given."""
    rows = table_at(spark, f"{store}/cursors", "endpoint_id string, page long, next_cursor string, items long").groupBy("endpoint_id").agg(F.max_by(F.struct("page", "next_cursor"), "page").alias("l"), F.sum("items").alias("items"))
    return rows.select("endpoint_id", F.col("l.page").alias("page"), F.col("l.next_cursor").alias("next_cursor"), F.col("l.next_cursor").isNull().alias("reached_end"), "items")


#: Items of a page, and those of the page before that it shows again.
PAGE, AGAIN = 50, 5


def _pages(d: Dialect) -> str:
    """Items of each source as pages, newest first; a page begins with the last items of the page before, as lists move while they are read."""
    string = "STRING" if d.spark else "VARCHAR"
    own = f"SELECT source_id, item_id, place, CAST(floor(place / {PAGE}.0) AS BIGINT) AS page FROM (SELECT source_id, item_id, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, item_id) - 1 AS place FROM v_items WHERE source_id IS NOT NULL) x"
    return f"""SELECT source_id AS endpoint_id, page, place, CAST(item_id AS {string}) AS external_id FROM ({own}) a
        UNION ALL SELECT source_id, page + 1, place, CAST(item_id AS {string}) FROM ({own}) b WHERE place % {PAGE} >= {PAGE - AGAIN}"""


def endpoint_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item that the runs over two landings gave, once, with its endpoint's cursor after them."""
    root, store = scratch_path(spark, "landed-pages"), scratch_path(spark, "refreshed")
    items = spark_query(_pages)(spark, sf_dir)
    most = Window.partitionBy("endpoint_id")
    items = items.withColumn("last", F.max("page").over(most)).withColumn("title", F.concat(F.lit("item "), "external_id"))
    items = items.withColumn("next_cursor", F.when(F.col("page") < F.col("last"), F.concat(F.lit("page-"), (F.col("page") + 1).cast("string"))))
    ends = items.groupBy("endpoint_id", "page", "next_cursor").agg(F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("string").alias("title"))
    rows = items.drop("last").unionByName(ends).withColumn("landed_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page"))).select(*[x.split()[0] for x in PAGE_ROW.split(", ")])
    for late in (False, True):
        rows.where((F.col("page") >= 2) == late).repartition("page").write.mode("append").parquet(root)
        refresh(spark.readStream.schema(PAGE_ROW).option("maxFilesPerTrigger", FILES).parquet(root), store)
    found = table_at(spark, f"{store}/candidates", "endpoint_id string, external_id string, title string")
    return found.join(cursors(spark, store), "endpoint_id").select("endpoint_id", "external_id", "title", "page", "reached_end", "items")


def _refresh_sql(d: Dialect) -> str:
    return f"""WITH p AS ({_pages(d)}), i AS (SELECT DISTINCT endpoint_id, external_id FROM p), e AS (SELECT endpoint_id, max(page) AS page, count(DISTINCT external_id) AS items FROM p GROUP BY endpoint_id)
        SELECT i.endpoint_id, external_id, concat('item ', external_id) AS title, page, TRUE AS reached_end, items FROM i JOIN e ON e.endpoint_id = i.endpoint_id"""


RECORD = "id string, url string, title string, selectedText string, createdAt long, _corrupt_record string"
#: Seconds after which a file that a reader has claimed is given back.
STALE = 600


def give_back(spark: SparkSession, inbox: str, now: float) -> list[str]:
    """Files that a reader claimed (a name that ends in .lease-OWNER) over ten minutes ago get their names again; returns these."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(inbox)
    files, back = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for status in files.listStatus(path) if files.exists(path) else ():
        name = status.getPath().getName()
        if ".json.lease-" in name and now - status.getModificationTime() / 1000 > STALE:
            own = jvm.org.apache.hadoop.fs.Path(path, name.split(".lease-")[0])
            if not files.exists(own) and files.rename(status.getPath(), own):
                back.append(own.getName())
    return sorted(back)


def shared_records(spark: SparkSession, inbox: str, archive: str, limit: int = 20) -> DataFrame:
    """A stream of the inbox's records, `limit` files a batch; files that are done move to the archive, and lines that are no records are said to be."""
    read = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", limit).option("cleanSource", "archive").option("sourceArchiveDir", archive).option("pathGlobFilter", "*.json")
    return read.json(inbox)


def _imported(d: Dialect, record: str) -> str:
    """What a record (its URL in canonical form) becomes: identities from its URL, privacy by whether it has a selection, and a name: title, host or URL."""
    name = lambda kind, x: t.name_uuid(d, f"concat('{kind}:', {x})")
    host = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
    return f"""SELECT id, {name('shared-source', 'url')} AS source_key, {name('shared-source-revision', 'id')} AS revision_key, {name('shared-endpoint', 'url')} AS endpoint_key, url AS external_id,
        coalesce(nullif(trim(title), ''), nullif({host}, ''), url) AS display_name, nullif(trim(selected), '') AS content_text, CASE WHEN nullif(trim(selected), '') IS NULL THEN 'public' ELSE 'unknown' END AS content_privacy, created_at
        FROM {record} WHERE id IS NOT NULL AND url IS NOT NULL"""


def _records(d: Dialect) -> str:
    """Pages shared by their readers, a third of them with a selection."""
    string = "STRING" if d.spark else "VARCHAR"
    return f"SELECT CAST(page_id AS {string}) AS id, url, CASE WHEN page_id % 4 = 0 THEN '  ' ELSE concat(' Page ', CAST(page_id AS {string})) END AS title, CASE WHEN page_id % 3 = 0 THEN concat(' seen on ', url) END AS selected, 1704067200 + page_id AS created_at FROM v_pages WHERE url IS NOT NULL"


def share_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared record as the source, endpoint and item that it becomes, imported once although the run stops in between."""
    root = scratch_path(spark, "inbox")
    store = f"{folder(spark)}/tidemark/imported-{uuid.uuid4().hex}"
    records = spark_query(_records)(spark, sf_dir).select("id", "url", "title", F.col("selected").alias("selectedText"), F.col("created_at").alias("createdAt"))
    for half in (0, 1):
        records.where(F.col("createdAt") % 2 == half).write.mode("append").json(f"{root}/box")
        rows = shared_records(spark, f"{root}/box", f"{root}/done").select("id", "url", "title", F.col("selectedText").alias("selected"), F.col("createdAt").alias("created_at"))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{store}/log").trigger(availableNow=True).start(f"{store}/rows").awaitTermination()
    return spark.sql(_imported(SPARK, "{r}"), r=table_at(spark, f"{store}/rows", "id string, url string, title string, selected string, created_at long").withColumn("url", canonical_url(F.col("url"))))


#: Ids of a listing that are read, and of these in a page.
TOP, LISTED = 100, 50


def _listing(d: Dialect) -> str:
    """Each source's items by length, among them ids that nothing has landed for, and items without title."""
    return """SELECT source_id, place, item_id, title, score FROM (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY length(plain_text) DESC, item_id) - 1 AS place, item_id,
        CASE WHEN item_id % 6 <> 1 THEN concat('about ', language_code) END AS title, length(plain_text) AS score FROM v_items WHERE source_id IS NOT NULL) x"""


def ranked_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as JSON arrays of ids, read page by page in their order: the items that have landed and have a title, each with the page's next offset."""
    rows = spark_query(_listing)(spark, sf_dir)
    lists = rows.groupBy("source_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id"))), lambda x: x["item_id"])).alias("body"))
    landed = rows.where("item_id % 10 <> 3").select("item_id", F.to_json(F.struct(F.col("item_id").alias("id"), "title", "score")).alias("item"))
    ids = F.slice(F.from_json("body", "array<bigint>"), 1, TOP)
    asked = lists.select("source_id", F.size(ids).alias("n"), F.posexplode(ids).alias("place", "item_id"))
    offset = F.floor(F.col("place") / LISTED) * LISTED
    asked = asked.select("source_id", "place", "item_id", F.least(offset + LISTED, "n").cast("long").alias("next_offset"), F.col("n").cast("long").alias("n"))
    found = asked.join(landed, "item_id").withColumn("i", F.from_json("item", "id bigint, title string, score bigint")).where("i.title IS NOT NULL")
    return found.select("source_id", F.col("place").cast("long").alias("place"), F.col("item_id").cast("string").alias("external_id"), "i.title", "i.score", "next_offset", (F.col("next_offset") >= F.col("n")).alias("reached_end"))


def _listing_sql(d: Dialect) -> str:
    return f"""SELECT source_id, place, CAST(item_id AS VARCHAR) AS external_id, title, score, next_offset, next_offset >= n AS reached_end FROM (
        SELECT *, least(CAST(floor(place / {LISTED}.0) AS BIGINT) * {LISTED} + {LISTED}, n) AS next_offset FROM (SELECT *, least({TOP}, count(*) OVER (PARTITION BY source_id)) AS n FROM ({_listing(d)}) x) y
        WHERE place < {TOP}) z WHERE item_id % 10 <> 3 AND title IS NOT NULL"""


SPARK_QUERIES = {f.__name__: f for f in (endpoint_refresh, share_inbox, ranked_listing)}
ORACLES = {"endpoint_refresh": duck_sql(_refresh_sql), "share_inbox": duck_sql(lambda d: _imported(DUCK, f"(SELECT * REPLACE ({canonical_url_sql('url')} AS url) FROM ({_records(d)}) x) y")), "ranked_listing": duck_sql(_listing_sql)}
