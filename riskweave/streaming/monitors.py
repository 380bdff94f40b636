"""Structured Streaming jobs on the event trace."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from riskweave.session import shared_folder

EVENT_SCHEMA = StructType(
    [
        StructField("event_id", LongType()),
        StructField("ts", TimestampType()),
        StructField("user_id", LongType()),
        StructField("event_type", StringType()),
        StructField("value", DoubleType()),
        StructField("props", StringType()),
    ]
)


def event_stream(
    spark: SparkSession, path: str, schema: StructType = EVENT_SCHEMA, files_per_batch: int = 100
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all available data to parquet files and stop; a rerun continues after it."""
    return (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def new_target(spark: SparkSession, name: str) -> tuple[str, str]:
    base = os.path.join(shared_folder(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    return os.path.join(base, "data"), os.path.join(base, "checkpoint")


#: Sessions are merged in each task before they are shuffled: a busy user sends a row per session and
#: task, not a row per event.
SESSIONS_MERGED_EARLY = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the streams that start inside; a stream keeps those it started with."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_to_table(stream: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Drain a stream into a fresh table of the shared folder and read the table."""
    spark = stream.sparkSession
    target, checkpoint = new_target(spark, name)
    with settings(spark, conf or {}):
        started = to_table(stream, target, checkpoint)
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def run_per_batch(
    stream: DataFrame, name: str, write: Callable[[DataFrame, int, str], None], mode: str = "update"
) -> str:
    """Drain a stream through ``foreachBatch``; ``write`` gets the batch, its id and the folder.

    The folder of a batch is named after its id, so a repeated batch overwrites itself.
    """
    target, checkpoint = new_target(stream.sparkSession, name)
    drain(stream, write, target, checkpoint, mode)
    return target


def drain(
    stream: DataFrame, write: Callable[[DataFrame, int, str], None], target: str, checkpoint: str, mode: str
) -> None:
    """Run ``write`` on every batch of the data that is there; a rerun continues after it."""
    writer: DataStreamWriter = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: write(batch, number, target))
    )
    writer.start().awaitTermination()


# --------------------------------------------------------------------------- windows


def windowed_kpis(
    events: DataFrame, length: str, slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Volume, error rate and mean value per event-time window.

    The 95th percentile is approximate here: a streaming state must stay bounded.
    """
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        events.withWatermark("ts", delay)
        .groupBy(window.alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.sum((F.col("event_type") == "error").cast("int")).alias("n_errors"),
            F.sum(F.col("value").cast("decimal(18,2)")).alias("value"),
            F.percentile_approx("value", 0.95, 10000).alias("p95"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "n",
            "n_errors",
            F.col("value").cast("double").alias("value"),
            F.col("p95"),
        )
    )


def late_row_counts(
    stream: DataFrame, time: str, delay_seconds: int, target: str, checkpoint: str
) -> DataFrame:
    """Rows and late rows of each micro-batch: batch, n_rows, n_late, newest (microseconds).

    A row is late if it is older than the newest row of all batches before, less the delay: the
    rows that an operator with a watermark of that delay may drop. A batch writes one row to a
    folder named after its id, so a repeated batch counts once, and a rerun with the same folders
    goes on after the last batch.
    """
    columns = "batch int, n_rows long, n_late long, newest long"
    seen = F.unix_micros(F.col(time).cast("timestamp"))

    def write(batch: DataFrame, number: int, _: str) -> None:
        newest = None
        if number:
            before = batch.sparkSession.read.schema(columns).parquet(target).where(F.col("batch") < number)
            newest = before.agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else seen < newest - delay_seconds * 1_000_000
        counts = batch.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(late).alias("n_late"), F.max(seen).alias("newest")
        )
        counts.write.mode("overwrite").parquet(os.path.join(target, f"batch={number}"))

    drain(stream, write, target, checkpoint, "append")
    return stream.sparkSession.read.schema(columns).parquet(target)


class _Progress(StreamingQueryListener):
    """The progress of one query, a narrow row per micro-batch, until the query has ended."""

    def __init__(self) -> None:
        self.query: str | None = None
        self.ended = threading.Event()
        self.rows: dict[str, dict[int, tuple[int, int, int]]] = {}
        self.over: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(operator.numRowsDroppedByWatermark for operator in p.stateOperators)
        self.rows.setdefault(str(p.runId), {})[p.batchId] = (p.batchId, p.numInputRows, dropped)

    def onQueryTerminated(self, event) -> None:
        self.over.add(str(event.runId))
        if self.query in self.over:
            self.ended.set()

    def wait(self, run: str, seconds: float) -> list[tuple[int, int, int]]:
        """All rows of a run that has ended; its events may still be on their way."""
        self.query = run
        if run not in self.over and not self.ended.wait(seconds):
            raise TimeoutError(f"no end of query {run} after {seconds} s")
        return [row for _, row in sorted(self.rows.get(run, {}).items())]


_DROPPED = "batch long, n_rows long, n_groups_dropped long"


def windows_with_drops(
    events: DataFrame, length: str, delay: str, target: str, checkpoint: str, patience: float = 60.0
) -> None:
    """Run the window query over all data that is there and note what its watermark dropped.

    ``target/windows`` gets the windows each micro-batch changed (update mode), ``target/progress`` a
    row per batch from the query's own progress. Both are named after the batch, so a repeated batch
    overwrites itself, and a rerun with the same folders goes on after the last batch. The progress
    of a run is written when it ends: a driver lost before leaves batches without a row there.
    """
    spark = events.sparkSession
    progress = _Progress()
    spark.streams.addListener(progress)
    try:
        started = (
            windowed_kpis(events, length, delay=delay)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(
                lambda rows, n: rows.withColumn("batch", F.lit(n).cast("long"))
                .write.mode("overwrite").parquet(os.path.join(target, "windows", f"part={n}"))
            )
            .start()
        )
        started.awaitTermination()
        rows = progress.wait(str(started.runId), patience)
    finally:
        spark.streams.removeListener(progress)
    for row in rows:
        one = spark.createDataFrame([row], _DROPPED).coalesce(1)
        one.write.mode("overwrite").parquet(os.path.join(target, "progress", f"part={row[0]}"))


def dropped_row_counts(spark: SparkSession, target: str) -> DataFrame:
    """Rows that the query of ``windows_with_drops`` read, kept and dropped in each batch with rows.

    Spark counts drops after rows of one window are summed (``n_groups_dropped``), so the number of
    rows kept comes from the windows: what each gained over the batch that changed it before. A
    dropped window never opens again, so the gains of all batches add up to the final windows.
    """
    seen = spark.read.schema(_DROPPED).parquet(os.path.join(target, "progress"))
    windows = spark.read.schema("window_start timestamp, n long, batch long").parquet(os.path.join(target, "windows"))
    before = F.lag("n", 1, 0).over(Window.partitionBy("window_start").orderBy("batch"))
    kept = windows.withColumn("gain", F.col("n") - before).groupBy("batch").agg(F.sum("gain").alias("n_kept"))
    n_kept = F.coalesce("n_kept", F.lit(0))
    return seen.where("n_rows > 0").join(kept, "batch", "left").select(
        "batch", "n_rows", n_kept.alias("n_kept"), (F.col("n_rows") - n_kept).alias("n_dropped"), "n_groups_dropped"
    )


# ---------------------------------------------------------------------------- alerts


def row_alerts(events: DataFrame, bound: float) -> DataFrame:
    return events.where((F.col("event_type") == "error") & (F.col("value") > bound)).select(
        "event_id", "ts", "user_id", "value", F.lit("large_error").alias("alert")
    )


def spike_alerts(
    events: DataFrame, length: str, max_rate: float, delay: str = "1 hour"
) -> DataFrame:
    kpis = windowed_kpis(events, length, delay=delay)
    rate = F.col("n_errors") / F.col("n")
    return kpis.where(rate > max_rate).select(
        "window_start", "n", "n_errors", rate.alias("error_rate"), F.lit("error_spike").alias("alert")
    )


# ------------------------------------------------------------------ joins, duplicates


def with_feedback(
    predictions: DataFrame,
    feedback: DataFrame,
    key: str,
    prediction_time: str,
    feedback_time: str,
    delay: str = "1 hour",
    bound_seconds: int = 2 * 86400,
) -> DataFrame:
    """Each prediction with the feedback that came within the bound, or without.

    Feedback has the columns ``feedback_key`` and ``feedback_time``. An unmatched prediction
    is emitted once the watermark says no feedback can come any more. Both sides also meet on
    a time slot as long as the bound: a prediction lies in one slot, a feedback is sent to the
    slots its prediction may lie in, so the rows of one busy key spread over many tasks.
    """

    def slot(seconds: Column) -> Column:
        return F.floor(seconds / bound_seconds).cast("long")

    seen = F.unix_seconds(F.col(feedback_time))
    p = predictions.withWatermark(prediction_time, delay).withColumn(
        "_slot", slot(F.unix_seconds(F.col(prediction_time)))
    )
    f = feedback.withWatermark(feedback_time, delay).withColumn(
        "_feedback_slot", F.explode(F.sequence(slot(seen - bound_seconds), slot(seen)))
    )
    joined = p.join(
        f,
        F.expr(
            f"{key} = feedback_key AND _slot = _feedback_slot "
            f"AND {feedback_time} >= {prediction_time} "
            f"AND {feedback_time} <= {prediction_time} + INTERVAL {bound_seconds} SECONDS"
        ),
        "leftOuter",
    )
    return joined.drop("_slot", "_feedback_slot")


def without_duplicates(
    runs: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 day"
) -> DataFrame:
    return runs.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


# ------------------------------------------------------------------------------ state


def last_state(events: DataFrame, key: str, time: str, value: Column) -> DataFrame:
    """Newest value per key and number of rows; the map side keeps one row per key.

    Over a stream this is the state per key, in update mode: a row for every key a micro-batch
    touched. The state holds one row per key and, like the table it stands for, never expires.
    """
    newest = F.max(F.struct(F.col(time), value.alias("state"))).alias("m")
    return events.groupBy(key).agg(newest, F.count("*").alias("n")).select(
        key, F.col("m.state").alias("state"), F.col(f"m.{time}").alias("last_seen"), "n"
    )


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per user: events, errors, retries and whether the last word was an error.

    A retry is an error after which the user went on in the same session. Start the stream with
    ``SESSIONS_MERGED_EARLY`` where one user may be busy.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(
            F.count("*").alias("n"),
            F.sum((F.col("event_type") == "error").cast("int")).alias("n_errors"),
            F.max_by("event_type", F.struct("ts", "event_type")).alias("last_type"),
        )
        .select(
            "user_id",
            F.col("s.start").alias("session_start"),
            F.col("s.end").alias("session_end"),
            "n",
            "n_errors",
            (F.col("n_errors") - (F.col("last_type") == "error").cast("int")).alias("n_retries"),
            (F.col("last_type") == "error").cast("int").alias("abandoned"),
        )
    )
