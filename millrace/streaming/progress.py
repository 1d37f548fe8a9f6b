"""Progress of runs as an append-only table of events, read as a batch or as a stream."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "run_id string, type string, ts timestamp, phase string, phase_number int, total_phases int, level string, message string, details string"
TYPES = ("phase_start", "phase_complete", "step_start", "step_complete", "log", "pipeline_complete", "pipeline_failed", "stream_end")


def percent(phase_number: Column, total: Column) -> Column:
    """Whole per cent of the phases, rounded down."""
    return F.when(total > 0, F.floor(phase_number / total * 100)).cast("int")


class ProgressLog:
    """Writes the events of a run as JSON files into a folder that streams can follow, on whatever
    file system the folder's address names."""

    def __init__(self, folder: str, run_id: str, total_phases: int = 7, spark: SparkSession | None = None):
        self.folder, self.run_id, self.total = str(folder).rstrip("/"), run_id, total_phases
        sc = (spark or SparkSession.active()).sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(sc._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def emit(self, kind: str, **fields) -> None:
        if kind not in TYPES:
            raise ValueError(f"unknown kind of event: {kind}")
        details = fields.pop("details", None)
        row = {"run_id": self.run_id, "type": kind, "ts": datetime.now(timezone.utc).isoformat(), "total_phases": self.total, "details": json.dumps(details) if details is not None else None} | fields
        name = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}.json"
        part = self._path(f"{self.folder}/.{name}")
        out = self._fs.create(part)
        out.write((json.dumps(row) + "\n").encode())
        out.close()
        self._fs.rename(part, self._path(f"{self.folder}/{name}"))  # a stream never sees half a file

    def phase_start(self, phase: str, number: int) -> None:
        self.emit("phase_start", phase=phase, phase_number=number)

    def phase_complete(self, phase: str, number: int, **details) -> None:
        self.emit("phase_complete", phase=phase, phase_number=number, details=details)

    def log(self, message: str, level: str = "info") -> None:
        self.emit("log", message=message, level=level)

    def complete(self, **details) -> None:
        self.emit("pipeline_complete", details=details)
        self.emit("stream_end")

    def fail(self, error: str) -> None:
        self.emit("pipeline_failed", message=error, level="error")
        self.emit("stream_end")


def replay(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(folder)


def follow(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def run_states(events: DataFrame) -> DataFrame:
    """Per run its state and phases done; works on a batch and, in update mode, on a stream.

    Pending without events but logs, running after the first phase event, completed or failed by the
    last of the closing events.
    """
    closing = F.col("type").isin("pipeline_complete", "pipeline_failed")
    return events.groupBy("run_id").agg(
        F.max(F.when(closing, F.struct("ts", "type"))).alias("_end"), F.max(F.when(F.col("type").startswith("phase_") | F.col("type").startswith("step_"), 1).otherwise(0)).alias("_any"),
        F.coalesce(F.max(F.when(F.col("type") == "phase_complete", F.col("phase_number"))), F.lit(0)).alias("phases_completed"), F.max("total_phases").alias("_total"), F.count("*").alias("n_events"),
    ).select(
        "run_id",
        F.when(F.col("_end.type") == "pipeline_complete", "completed").when(F.col("_end.type") == "pipeline_failed", "failed").when(F.col("_any") == 1, "running").otherwise("pending").alias("status"),
        "phases_completed", percent(F.col("phases_completed"), F.col("_total")).alias("progress_pct"), "n_events",
    )


def sse_lines(events: DataFrame) -> DataFrame:
    """``data: {json}`` and a blank line per event, for a server-sent stream."""
    body = F.to_json(F.struct("type", "ts", "run_id", "phase", "phase_number", "total_phases", percent(F.col("phase_number"), F.col("total_phases")).alias("progress_pct"), "level", "message", "details"))
    return events.select("run_id", "ts", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("line"))


def deliver(events: DataFrame, sink: Callable[[str], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hand the lines of a stream to a sink, batch by batch in the order of time.

    ``every``: poll at this interval (``"3 seconds"``); else take what is there and stop.
    """

    def hand_over(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("ts", "run_id").toLocalIterator():
            sink(row["line"])

    writer = sse_lines(events).writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def event_windows(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours", *keys: str) -> DataFrame:
    """Counts and sums per window and key, with a watermark; for the stream of events."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = timed.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")
