"""Incremental forms of the batch queries, as Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.plans.scratch import folder, scratch_path, table_at
from tidemark.streaming.queue import rocks


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a file stream; the trigger reads it to its end."""
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def drained(result: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a streaming result over all that is there and returns the written rows (exactly once by checkpoint).

    In update mode each batch leaves the rows that it changed; of those with equal keys the last batch's count.
    """
    spark, path = result.sparkSession, f"{folder(result.sparkSession)}/tidemark/stream-{uuid.uuid4().hex}"
    writer = result.writeStream.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").start(f"{path}/rows").awaitTermination()
        return table_at(spark, f"{path}/rows", result.schema)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/state/batch={batch}")

    writer.foreachBatch(keep).start().awaitTermination()
    all_ = spark.read.parquet(f"{path}/state")
    if keys:
        rest = [c for c in result.columns if c not in keys]
        return all_.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    last = all_.agg(F.max("batch")).first()[0]
    return all_.where(F.col("batch") == last).drop("batch")


def stream_metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly metric roll-ups in update mode: the watermark lets hours leave the state a day after they are over."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    rolled = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drained(rolled, "update", ["window", "event_type"]).select(F.unix_seconds("window.start").alias("start_at"), "event_type", "n", F.round("total", 4).alias("total"))


class Ledger(StatefulProcessor):
    """An item's contents so far, and how many there are. A batch's rows of one item are taken in the order of their ordinals."""

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "content_hash string", "revision int")
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first: dict[str, int] = {}
        for part in rows:
            for h, ordinal in zip(part["content_hash"], part["ordinal"], strict=True):
                first[h] = min(first.get(h, ordinal), ordinal)
        n, out = (self.count.get()[0] if self.count.exists() else 0), []
        for h, ordinal in sorted(first.items(), key=lambda x: (x[1], x[0])):
            if not self.seen.containsKey((h,)):
                n += 1
                self.seen.updateValue((h,), (n,))
                out.append((key[0], h, ordinal, n))
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["item_id", "content_hash", "ordinal", "revision"])

    def close(self) -> None:
        pass


def ledgered(turns: DataFrame, path: str) -> DataFrame:
    """Runs a stream of (item_id, content_hash, ordinal) through a ledger under path and returns it: item_id, content_hash, ordinal, revision.

    The first arrival of a content opens the item's next revision; later ones write nothing. The ledger is keyed state, so a batch looks
    only at its own items; a batch that is run again writes once. Rows without item or content are dropped.
    """
    schema, spark = "item_id long, content_hash string, ordinal long, revision int", turns.sparkSession
    with rocks(spark):
        rows = turns.where("item_id IS NOT NULL AND content_hash IS NOT NULL").groupBy("item_id")
        out = rows.transformWithStateInPandas(statefulProcessor=Ledger(), outputStructType=schema, outputMode="append", timeMode="none")
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/ledger").awaitTermination()
    return table_at(spark, f"{path}/ledger", schema)


def stream_ingest_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit ledger as a stream: the first arrival of each (item, content) opens a revision, later ones write nothing."""
    turns = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.sha2("text", 256).alias("content_hash"), F.col("turn").alias("ordinal"))
    return ledgered(turns, f"{folder(spark)}/tidemark/ledger-{uuid.uuid4().hex}")


def x_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra, not in the reference: sliding windows of six hours each hour."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rolled = events.groupBy(F.window("ts", "6 hours", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return drained(rolled, "complete").select(F.unix_seconds("window.start").alias("start_at"), "event_type", "n")


def x_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra, not in the reference: sessions of a user with gaps under two hours, written once the watermark has left them behind.

    An event far ahead of all others, which itself is left out, lets the watermark pass the last session.
    """
    path = scratch_path(spark, "sessions")
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL AND user_id IS NOT NULL")
    end = own.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(F.lit(None).cast("long").alias("user_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    own.unionByName(end).write.parquet(path)
    events = spark.readStream.schema("user_id long, ts timestamp").parquet(path).withWatermark("ts", "1 hour")
    sessions = events.groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n"))
    return drained(sessions, "append").where("user_id IS NOT NULL").select("user_id", F.unix_seconds("s.start").alias("start_at"), "n")


SPARK_QUERIES = {f.__name__: f for f in (stream_metric_rollup, stream_ingest_revisions, x_sliding, x_session)}
ORACLES = {
    "stream_metric_rollup": "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_ingest_revisions": "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ordinal) AS revision FROM (SELECT conv_id AS item_id, sha256(text) AS content_hash, min(turn) AS ordinal FROM conversations GROUP BY 1, 2)",
    "x_sliding": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - k * 3600 AS start_at, event_type, count(*) AS n FROM events CROSS JOIN (SELECT unnest(range(6)) AS k) GROUP BY 1, 2",
    "x_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events),
        s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_at, count(*) AS n FROM s GROUP BY user_id, k""",
}
