"""Streams: owned windows with watermarks, monotone progress, and job states with timeouts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.shared import shared_dir


def owned_windows(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """ST1: events (ts, event_type, value) by tumbling window; a window closes when the watermark passes it, later rows are late."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def progress(events: DataFrame) -> DataFrame:
    """ST3, ST4: the largest progress and revision of each job so far (update mode)."""
    return events.groupBy("job_id").agg(F.max("progress").alias("progress"), F.max("revision").alias("revision"))


#: States that a job may go to from each.
NEXT = {None: {"uploading"}, "uploading": {"running", "cancelled", "error"}, "running": {"done", "error", "cancelled"}}


def job_states(events: DataFrame, timeout: str = "30 minutes") -> DataFrame:
    """ST5, ST6 over (job_id, ts, wanted): the state of each job after each batch; a running job times out to error.

    A change that the state machine doesn't know is counted and ignored. Needs a watermark on ts.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, refused = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "state": ["error"], "refused": [int(refused)]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "wanted"])
        for wanted in rows["wanted"]:
            if wanted in NEXT.get(now, set()):
                now = wanted
            else:
                refused += 1
        state.update((now, int(refused)))
        if now in ("uploading", "running"):
            state.setTimeoutTimestamp(int(max(rows["ts"].max().timestamp() * 1000, state.getCurrentWatermarkMs()) + pd.Timedelta(timeout).total_seconds() * 1000))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "refused": [int(refused)]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, state string, refused long", "state string, refused long", "append", GroupStateTimeout.EventTimeTimeout)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """events.parquet as a stream of its files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream emits for all that is there now, written as tables in the shared folder: each batch adds its rows, in complete
    mode it takes the place of the one before. Nothing passes through the driver."""
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex}"
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{path}/rows")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a replay of events that the watermark has closed: those of the last two hours stay open."""
    events = read_events(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(owned_windows(events), "append").withColumn("window_start", F.unix_seconds("window_start"))


def progress_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), F.floor(F.col("value") % 100).cast("long").alias("progress"), F.col("event_id").alias("revision"))
    return drained(progress(events), "complete")


QUERIES = {"stream_windows": window_query, "stream_progress": progress_query}
ORACLES = {
    "stream_windows": """SELECT CAST(floor(epoch_us(ts) / 1e6 / 86400) * 86400 AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE (floor(epoch_us(ts) / 1e6 / 86400) + 1) * 86400 <= (SELECT max(epoch_us(ts)) / 1e6 - 7200 FROM events) GROUP BY 1, 2""",
    "stream_progress": """SELECT user_id AS job_id, max(CAST(floor(value % 100) AS BIGINT)) AS progress, max(event_id) AS revision FROM events GROUP BY user_id""",
}
