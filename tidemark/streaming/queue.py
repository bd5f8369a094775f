"""A durable queue as keyed state: jobs are enqueued once, leased with a token, renewed, completed, failed, and taken back in time.

The state of a job is its row; its lease is held by a timer of event time. A lease ends at its expiry, whether the next command of
the job, or the watermark with the timer, comes first: both leave the same rows. Commands that name another token than the
lease's are refused and change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.plans.dialect import DUCK, Dialect
from tidemark.plans.run import duck_sql, spark_query
from tidemark.plans.scratch import folder, table_at, written

#: What a command is: the job, when, its id (commands of one second are run by it), what to do, and the token that the worker holds.
COMMAND = "job_id long, moment long, command_id long, op string, token long"
RESULT = "job_id long, moment long, command_id long, op string, outcome string, state string, attempts int, token long, expires_at long, next_attempt_at long"
_STATE = "state string, attempts int, token long, expires_at long, next_attempt_at long"
#: Seconds that a lease lasts, that commands may come late, and the longest wait after a failure.
LEASE, LATE, LONGEST = 28_800, 600, 21_600
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def wait(attempts: int) -> int:
    """Seconds until a failed job is due again."""
    return min(LONGEST, 2 ** min(attempts, 10) * 15)


def step(job: tuple | None, at: int, command_id: int, op: str, token: int | None, lease: int) -> tuple[str, tuple | None]:
    """(outcome, job after it) of a command on a job (state, attempts, token, expires_at, next_attempt_at) whose lease, if any, has not ended."""
    if job is None:
        return ("enqueued", ("pending", 0, None, None, at)) if op == "enqueue" else ("unknown", None)
    state, attempts, held, _, due = job
    if op == "lease" and state in ("pending", "failed") and due <= at:
        return "leased", ("leased", attempts + 1, command_id, at + lease, due)
    if op in ("renew", "complete", "fail") and state == "leased" and held == token:
        if op == "renew":
            return "renewed", ("leased", attempts, held, at + lease, due)
        return ("completed", ("completed", attempts, None, None, due)) if op == "complete" else ("failed", ("failed", attempts, None, None, at + wait(attempts)))
    return ("ignored" if op == "enqueue" else "refused"), job


class Queue(StatefulProcessor):
    """The token of a lease is the id of the command that took it. A batch's commands of one job are run in order of time and id."""

    def __init__(self, lease: int):
        self.lease = lease

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # pandas turns integers of a column with nulls into floats, so tokens come as objects
        commands = sorted((int(r.moment), int(r.command_id), r.op, None if pd.isna(r.token) else int(r.token)) for part in rows for r in part.itertuples(index=False, name="Row"))
        job, out = (tuple(self.job.get()) if self.job.exists() else None), []
        timer = job[3] if job else None
        for at, command_id, op, token in commands:
            if job and job[3] is not None and job[3] <= at:
                ended, job = job[3], ("pending", job[1], None, None, job[4])
                out.append((key[0], ended, None, "expire", "returned", *job))
            outcome, job = step(job, at, command_id, op, token, self.lease)
            out.append((key[0], at, command_id, op, outcome, *(job or (None,) * 5)))
        if job:
            self.job.update(job)
            if timer != job[3]:
                if timer is not None:
                    self.handle.deleteTimer(timer * 1000)
                if job[3] is not None:
                    self.handle.registerTimer(job[3] * 1000)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = tuple(self.job.get())
        if job[3] is not None and job[3] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            ended, job = job[3], ("pending", job[1], None, None, job[4])
            self.job.update(job)
            yield _frame([(key[0], ended, None, "expire", "returned", *job)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = {"string": "object", "long": "Int64", "int": "Int32"}
    return pd.DataFrame(rows, columns=names).astype({n: kinds[x.split()[1]] for n, x in zip(names, RESULT.split(", "), strict=True)})


def run_queue(commands: DataFrame, lease: int = LEASE, late: int = LATE) -> DataFrame:
    """RESULT rows of a stream of COMMANDs: one for each command, and one (op expire, no command) for each lease that ended by time.

    Commands without job or time are dropped, those that come later than `late` seconds behind the latest too; equal commands are
    commands of their own.
    """
    timed = commands.where("job_id IS NOT NULL AND moment IS NOT NULL").withColumn("ts", F.timestamp_seconds("moment")).withWatermark("ts", f"{late} seconds")
    return timed.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Queue(lease), outputStructType=RESULT, outputMode="append", timeMode="eventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Keyed state with timers needs the RocksDB store; a query takes the setting when it starts."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _commands(d: Dialect) -> str:
    """Commands made of events: a job is a user's week; workers renew, complete and fail with the id of the job's latest lease command, granted or not."""
    job = "item_id * 100 + CAST(floor((captured_at - 1704067200) / 604800.0) AS BIGINT)"
    order = "PARTITION BY job_id ORDER BY moment, command_id"
    return f"""SELECT job_id, moment, command_id, CASE WHEN row_number() OVER ({order}) = 1 THEN 'enqueue' ELSE op END AS op,
        CAST(max(CASE WHEN op = 'lease' THEN moment * 100000000 + command_id END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 100000000 AS BIGINT) AS token FROM (
        SELECT {job} AS job_id, captured_at AS moment, event_id AS command_id, CASE metric WHEN 'click' THEN 'lease' WHEN 'view' THEN 'renew' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'enqueue' END AS op
        FROM v_metrics WHERE item_id IS NOT NULL AND captured_at IS NOT NULL) x"""


def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every command of every job with its outcome and the job's state after it, and every lease that ran out."""
    landed = written(spark_query(_commands)(spark, sf_dir), "commands")
    path = f"{folder(spark)}/tidemark/queue-{uuid.uuid4().hex}"
    with rocks(spark):
        out = run_queue(spark.readStream.schema(COMMAND).parquet(landed._scratch))
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return table_at(spark, f"{path}/rows", RESULT)


def _oracle(d: Dialect) -> str:
    """The queue one command after another, all jobs at once, by recursion over their numbers."""
    done = "op IN ('renew', 'complete', 'fail') AND live AND held = claimed"
    can = "op = 'lease' AND known AND NOT live AND state <> 'completed' AND due <= moment"
    return f"""WITH RECURSIVE k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY moment, command_id) AS k, max(moment) OVER () - {LATE} AS low FROM ({_commands(d)}) y),
r AS (SELECT job_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS moment, CAST(NULL AS BIGINT) AS command_id, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS INTEGER) AS attempts,
    CAST(NULL AS BIGINT) AS token, CAST(NULL AS BIGINT) AS expires_at, CAST(NULL AS BIGINT) AS next_attempt_at, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS BIGINT) AS ended_due, CAST(NULL AS INTEGER) AS ended_attempts FROM k WHERE k = 1
  UNION ALL SELECT job_id, k, moment, command_id, op,
    CASE WHEN NOT known THEN CASE WHEN op = 'enqueue' THEN 'enqueued' ELSE 'unknown' END WHEN {can} THEN 'leased' WHEN {done} THEN CASE op WHEN 'renew' THEN 'renewed' WHEN 'complete' THEN 'completed' ELSE 'failed' END WHEN op = 'enqueue' THEN 'ignored' ELSE 'refused' END,
    CASE WHEN NOT known THEN CASE WHEN op = 'enqueue' THEN 'pending' END WHEN {can} THEN 'leased' WHEN {done} THEN CASE op WHEN 'renew' THEN 'leased' WHEN 'complete' THEN 'completed' ELSE 'failed' END WHEN ended IS NOT NULL THEN 'pending' ELSE state END,
    CAST(CASE WHEN NOT known AND op = 'enqueue' THEN 0 WHEN {can} THEN attempts + 1 ELSE attempts END AS INTEGER),
    CASE WHEN {can} THEN command_id WHEN live AND NOT ({done} AND op <> 'renew') THEN held END,
    CASE WHEN {can} OR ({done} AND op = 'renew') THEN moment + {LEASE} WHEN live AND NOT ({done}) THEN expires END,
    CASE WHEN NOT known AND op = 'enqueue' THEN moment WHEN {done} AND op = 'fail' THEN moment + CAST(least({LONGEST}, power(2, least(attempts, 10)) * 15) AS BIGINT) ELSE due END,
    ended, due, attempts
  FROM (SELECT k.job_id, k.k, k.moment, k.command_id, k.op, k.token AS claimed, r.state, r.attempts, r.token AS held, r.expires_at AS expires, r.next_attempt_at AS due, r.state IS NOT NULL AS known,
      coalesce(r.state = 'leased' AND r.expires_at > k.moment, FALSE) AS live, CASE WHEN r.expires_at <= k.moment THEN r.expires_at END AS ended FROM r JOIN k ON k.job_id = r.job_id AND k.k = r.k + 1) z)
SELECT job_id, moment, command_id, op, outcome, state, attempts, token, expires_at, next_attempt_at FROM r WHERE k > 0
UNION ALL SELECT job_id, ended, NULL, 'expire', 'returned', 'pending', ended_attempts, NULL, NULL, ended_due FROM r WHERE ended IS NOT NULL
UNION ALL SELECT r.job_id, r.expires_at, NULL, 'expire', 'returned', 'pending', r.attempts, NULL, NULL, r.next_attempt_at FROM r JOIN (SELECT job_id, max(k) AS k, max(low) AS low FROM k GROUP BY job_id) l ON l.job_id = r.job_id AND l.k = r.k WHERE r.expires_at <= l.low"""


SPARK_QUERIES = {"job_queue": job_queue}
ORACLES = {"job_queue": duck_sql(_oracle)}
