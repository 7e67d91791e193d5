"""Streams of submissions: first sightings, daily counts, idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import scratch_path


def submission_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 64) -> DataFrame:
    """The submissions as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/submissions.parquet").schema
    # A pattern, so that a table of one file and a folder of files both do.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/submissions.parque[t]")


#: How late a row may come; what is older leaves the state.
LATEST = "400 days"


def run_available(stream: DataFrame, mode: str, path: str, checkpoint: str) -> None:
    """Process what is there and stop.  Each batch's output is written under its number, so that a batch that is
    run again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        at = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(at)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New submission ids by assignment: repeats of an id are dropped by the stream's state, which keeps an id for
    ``LATEST`` after its first row."""
    stream = submission_stream(spark, sf_dir).select("work_answer_id", "assignment_id", "collected_at").withWatermark("collected_at", LATEST)
    stream = stream.dropDuplicatesWithinWatermark(["work_answer_id"])
    path = scratch_path(spark, "first-seen")
    run_available(stream, "append", path, scratch_path(spark, "stream"))
    return spark.read.parquet(path).groupBy("assignment_id").agg(F.count(F.lit(1)).alias("submissions"))


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected rows by day and status, in tumbling windows over event time.  A batch writes the windows that it
    changed; the last writing of a window counts, and windows older than ``LATEST`` leave the state."""
    stream = submission_stream(spark, sf_dir).withWatermark("collected_at", LATEST)
    stream = stream.groupBy(F.window("collected_at", "1 day").alias("w"), "status").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "daily")
    run_available(stream.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "status", "n"), "update", path, scratch_path(spark, "stream"))
    return spark.read.parquet(path).groupBy("day", "status").agg(F.max_by("n", "batch").alias("n"))


def open_sessions(spark: SparkSession, sf_dir: str, gap: str = "7 days") -> DataFrame:
    """Sessions of each student's collected rows: a new one after a gap, late rows joined into theirs.  The open
    ones are part of the result, so that the whole of it is written each time; bounded by the students' sessions."""
    stream = submission_stream(spark, sf_dir).where("student_no <> ''")
    stream = stream.groupBy(F.session_window("collected_at", gap).alias("w"), "student_no").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "sessions")
    run_available(stream.select("student_no", F.unix_millis("w.start").alias("start_ms"), "n"), "complete", path, scratch_path(spark, "stream"))
    return spark.read.parquet(path)
