"""Lines that keep arriving: classified as they come, duplicates within a time bound removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillstone.operators.capture import classify_lines

LINE_SCHEMA = "occurrence_id string, stream_id string, source_locator string, line_number bigint, raw_text string, ingested_at timestamp"


def line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of lines as a stream."""
    return spark.readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def classified_stream(lines: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each line once (repeats within ``lateness`` of one another are dropped), with action, reason and event class."""
    once = lines.withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["occurrence_id"])
    return classify_lines(once, ["occurrence_id", "stream_id", "source_locator", "line_number", "ingested_at"])


def windowed_counts(classified: DataFrame, width: str = "1 hour") -> DataFrame:
    """``start, action, n`` per event-time window."""
    return classified.groupBy(F.window("ingested_at", width), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "action", "n")


def write_stream(rows: DataFrame, target: str, checkpoint: str, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Parquet files, exactly once; ``once`` ends when what is there has been read."""
    writer = rows.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
