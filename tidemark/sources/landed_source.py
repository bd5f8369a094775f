"""Landed pages as a table source that Spark reads, in batches or as a stream: spark.read.format("landed"), spark.readStream.format("landed").

What connectors fetch is landed under root/kind=K/endpoint_id=E/landing=N as lines of JSON with page and body; a landing counts once its
mark is there, so readers never see half of one. Each endpoint is a partition of the read; the offset of a stream is a cursor for each
endpoint, the last landing that was read. Paths are opened through pyarrow's file systems, in the tasks too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.plans.run import duck_sql, spark_query
from tidemark.plans.scratch import scratch_path, table_at

#: The bits of a connector's capabilities.
CAPABILITIES = ("discovery", "authentication", "deltaSync", "pagination", "fullContent", "browserRequired", "deletionSignals", "engagementMetrics", "backgroundRefresh")
#: What connectors of each kind can do.
KINDS = {
    "rss": ("discovery", "deltaSync", "fullContent", "backgroundRefresh"),
    "website": ("discovery", "deltaSync", "fullContent", "deletionSignals", "backgroundRefresh"),
    "github": ("discovery", "deltaSync", "pagination", "fullContent", "engagementMetrics", "backgroundRefresh"),
    "reddit": ("discovery", "deltaSync", "pagination", "fullContent", "deletionSignals", "engagementMetrics", "backgroundRefresh"),
    "bluesky": ("discovery", "deltaSync", "pagination", "fullContent", "engagementMetrics", "backgroundRefresh"),
    "hackerNews": ("discovery", "deltaSync", "pagination", "engagementMetrics", "backgroundRefresh"),
    "arxiv": ("discovery", "deltaSync", "pagination", "fullContent", "backgroundRefresh"),
    "imap": ("discovery", "authentication", "deltaSync", "pagination", "fullContent", "backgroundRefresh"),
}


def bits(kind: str) -> int:
    """A kind's capabilities as bits; 0 for a kind that is not known."""
    return sum(1 << CAPABILITIES.index(c) for c in KINDS.get(kind, ()))


@dataclass
class Endpoint(InputPartition):
    """The landings of an endpoint after one and up to another."""

    kind: str
    endpoint_id: str
    after: int
    upto: int

    def __post_init__(self):
        super().__init__((self.kind, self.endpoint_id, self.after, self.upto))


class _Landed:
    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.root = path if "://" in path else "file://" + path.removeprefix("file:")

    def _store(self):
        """The root's file system and the root's path there; names below it are not addresses, so they are joined to the path as they are."""
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.root)
        return store, at.rstrip("/")

    def _names(self, folder: str, head: str) -> list[str]:
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True))
        return sorted(x.base_name.removeprefix(head) for x in found if x.base_name.startswith(head))

    def cursors(self) -> dict[str, int]:
        """kind/endpoint_id: the last whole landing that has pages of it."""
        whole = {int(n) for n in self._names("_landed", "landing-")}
        out = {}
        for kind in self._names("", "kind="):
            for endpoint in self._names(f"kind={kind}", "endpoint_id="):
                own = whole & {int(n) for n in self._names(f"kind={kind}/endpoint_id={endpoint}", "landing=")}
                if own:
                    out[f"{kind}/{endpoint}"] = max(own)
        return out

    def between(self, start: dict[str, int], end: dict[str, int]) -> list[Endpoint]:
        return [Endpoint(*e.split("/", 1), start.get(e, 0), n) for e, n in sorted(end.items()) if n > start.get(e, 0)]

    def read(self, partition: Endpoint) -> Iterator[tuple]:
        from urllib.parse import unquote

        own, (store, root) = f"kind={partition.kind}/endpoint_id={partition.endpoint_id}", self._store()
        kind, endpoint = unquote(partition.kind), unquote(partition.endpoint_id)
        for n in sorted({int(n) for n in self._names("_landed", "landing-")} & {int(n) for n in self._names(own, "landing=")}):
            if partition.after < n <= partition.upto:
                for part in self._names(f"{own}/landing={n}", "part-"):
                    with store.open_input_stream(f"{root}/{own}/landing={n}/part-{part}") as f:
                        for line in f.read().decode().split("\n"):
                            if line:
                                row = json.loads(line)
                                yield kind, endpoint, n, row["page"], row.get("body"), bits(kind)


class LandedReader(_Landed, DataSourceReader):
    def partitions(self) -> list[Endpoint]:
        return self.between({}, self.cursors()) or [Endpoint("", "", 0, 0)]


class LandedStream(_Landed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.cursors()

    def partitions(self, start: dict, end: dict) -> list[Endpoint]:
        return self.between(start, end) or [Endpoint("", "", 0, 0)]

    def commit(self, end: dict) -> None:
        pass


class LandedSource(DataSource):
    """Option path: the root of the landed pages."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return "kind string, endpoint_id string, landing long, page long, body string, capabilities int"

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options)


def land(pages: DataFrame, root: str, landing: int) -> None:
    """Lands (kind, endpoint_id, page, body). Landings ascend; one that broke off has no mark and is landed anew."""
    spark = pages.sparkSession
    rows = pages.select("kind", "endpoint_id", F.lit(landing).alias("landing"), "page", "body").repartition("kind", "endpoint_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "endpoint_id", "landing").json(root)
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_landed/landing-{landing}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()


def _pages(spark: SparkSession, sf_dir: str, landing: int) -> DataFrame:
    """Pages by host as endpoints of three kinds; landing 1 has those of even ids, 2 the others."""
    pages = spark_query(lambda d: "SELECT page_id, url, html FROM v_pages WHERE html IS NOT NULL AND url IS NOT NULL")(spark, sf_dir).where(F.col("page_id") % 2 == landing - 1)
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    kind = F.element_at(F.array(*map(F.lit, ("rss", "website", "reddit"))), (F.length(host) % 3 + 1).cast("int"))
    return pages.where(host != "").select(kind.alias("kind"), host.alias("endpoint_id"), F.col("page_id").alias("page"), F.col("html").alias("body"))


def _known(rows: DataFrame) -> DataFrame:
    return rows.select("kind", "endpoint_id", "landing", "page", F.sha2("body", 256).alias("body_hash"), "capabilities")


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages landed twice, by host, read as a table with what their connectors can do."""
    spark.dataSource.register(LandedSource)
    root = scratch_path(spark, "landed")
    for n in (1, 2):
        land(_pages(spark, sf_dir, n), root, n)
    return _known(spark.read.format("landed").load(root))


def landed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a stream that stops after the first landing and resumes after the second: each page once, by the run that read it."""
    spark.dataSource.register(LandedSource)
    root, out = scratch_path(spark, "landed"), scratch_path(spark, "landed-read")

    def read() -> None:
        rows = _known(spark.readStream.format("landed").load(root))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()

    for n in (1, 2):
        land(_pages(spark, sf_dir, n), root, n)
        read()
    read()  # nothing new: nothing is read
    rows = table_at(spark, f"{out}/rows", "kind string, endpoint_id string, landing long, page long, body_hash string, capabilities int")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))


def _oracle(d, times: bool) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {bits(k)}" for k in ("rss", "website", "reddit"))
    return f"""SELECT kind, endpoint_id, CASE WHEN page % 2 = 0 THEN 1 ELSE 2 END AS landing, page, body_hash, CASE kind {cases} END AS capabilities{', 1 AS times' if times else ''} FROM (
        SELECT list_extract(['rss', 'website', 'reddit'], CAST(length(host) % 3 + 1 AS BIGINT)) AS kind, host AS endpoint_id, page_id AS page, sha256(html) AS body_hash FROM (
        SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM v_pages WHERE html IS NOT NULL AND url IS NOT NULL) x WHERE host <> '') y"""


SPARK_QUERIES = {"landed_pages": landed_pages, "landed_stream": landed_stream}
ORACLES = {"landed_pages": duck_sql(lambda d: _oracle(d, False)), "landed_stream": duck_sql(lambda d: _oracle(d, True))}
