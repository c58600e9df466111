"""Structured Streaming: weekly booking totals over arriving booking files.

Optional extension (the dashboard itself has no streaming): new booking
files land in a folder; a streaming query keeps weekly totals per project.
Windows are 7 days, shifted by 4 days so they start on Mondays (the epoch,
1970-01-01, is a Thursday), i.e. the same weeks as ``date_trunc('week')``.
The watermark bounds the state: a week's total is final once bookings 28
days newer have been seen, and bookings that arrive later still are dropped.
:func:`dropped_rows` counts those; a batch run of ``trends.weekly_totals``
over the stored bookings has them all.

:func:`start_weekly_upserts` keeps totals that late bookings correct: each
micro-batch adds its own part, named by the batch, and readers add the parts
up. It has no state and drops nothing; a batch that is replayed after a
failure writes the same part again.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators.trends import week_start
from ..sources.store import path_exists

_PART = "batch_id"
WEEK = "7 days"
MONDAY_OFFSET = "4 days"
DEFAULT_WATERMARK = "28 days"


def weekly_totals_stream(bookings_stream: DataFrame, measure_col: str = S.DEFAULT_MEASURE,
                         watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Streaming weekly hours per project (event time = ``booking_ts``).

    Watermarks need a zoned TIMESTAMP; the zone-less booking time is read in
    the session zone (UTC), so window bounds keep their wall-clock dates.
    """
    return (bookings_stream
            .filter(F.col("booking_ts").isNotNull())
            .withColumn("event_ts", F.col("booking_ts").cast("timestamp"))
            .withWatermark("event_ts", watermark)
            .groupBy(F.window("event_ts", WEEK, WEEK, MONDAY_OFFSET).alias("w"), "project_nr")
            .agg(F.sum(F.col(measure_col).cast("double")).alias("hours"),
                 F.count(F.lit(1)).alias("n_bookings"))
            .select("project_nr", F.col("w.start").cast("date").alias("week_start"), "hours", "n_bookings"))


def read_booking_stream(spark: SparkSession, directory: str, max_files_per_trigger: Optional[int] = None) -> DataFrame:
    """Booking Parquet files arriving in ``directory`` (canonical schema)."""
    reader = spark.readStream.schema(S.BOOKINGS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def start_weekly_totals(spark: SparkSession, source_dir: str, checkpoint_dir: str, sink_dir: Optional[str] = None,
                        query_name: Optional[str] = None, available_now: bool = True,
                        output_mode: str = "append") -> StreamingQuery:
    """Start the query. With ``sink_dir`` results go to Parquet files
    (append mode: a week is written once final); otherwise to an in-memory
    table named ``query_name`` (for tests). The checkpoint folder must be on
    shared storage so a restarted driver resumes exactly once."""
    out = weekly_totals_stream(read_booking_stream(spark, source_dir))
    writer = out.writeStream.option("checkpointLocation", checkpoint_dir).outputMode(output_mode)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    if sink_dir:
        return writer.format("parquet").start(sink_dir)
    return writer.format("memory").queryName(query_name or "weekly_totals").start()


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after their week was final, in the query's recent
    batches (Spark keeps the progress of the last hundred)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


# Totals that late rows correct -------------------------------------------------
def weekly_parts(bookings: DataFrame, measure_col: str = S.DEFAULT_MEASURE) -> DataFrame:
    """What a set of bookings adds to the weekly totals."""
    return (bookings.filter(F.col("booking_ts").isNotNull())
            .groupBy("project_nr", week_start().alias("week_start"))
            .agg(F.sum(F.col(measure_col).cast("double")).alias("hours"), F.count(F.lit(1)).alias("n_bookings")))


def upsert_batch(batch: DataFrame, batch_id: int, sink_dir: str, measure_col: str = S.DEFAULT_MEASURE) -> None:
    """Write the part of one micro-batch; nothing to do if it is complete already."""
    part = f"{sink_dir.rstrip('/')}/{_PART}={batch_id}"
    if not path_exists(batch.sparkSession, f"{part}/_SUCCESS"):
        weekly_parts(batch, measure_col).write.mode("overwrite").parquet(part)


def start_weekly_upserts(spark: SparkSession, source_dir: str, checkpoint_dir: str, sink_dir: str,
                         max_files_per_trigger: Optional[int] = None, available_now: bool = True) -> StreamingQuery:
    """Start the query that keeps ``sink_dir``. A sink belongs to one checkpoint folder, which numbers its batches."""
    stream = read_booking_stream(spark, source_dir, max_files_per_trigger)
    writer = (stream.writeStream.option("checkpointLocation", checkpoint_dir)
              .foreachBatch(lambda batch, batch_id: upsert_batch(batch, batch_id, sink_dir)))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def read_weekly_upserts(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The weekly totals so far: the parts of all complete batches, added up."""
    parts = spark.read.schema(f"project_nr string, week_start date, hours double, n_bookings bigint, {_PART} bigint").parquet(sink_dir)
    return parts.groupBy("project_nr", "week_start").agg(F.sum("hours").alias("hours"), F.sum("n_bookings").alias("n_bookings"))
