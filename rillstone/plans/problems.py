"""Queries of the general training-data problems (pN_...), over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators import clocks, drift, nested, orphans, redelivery, rejects
from rillstone.plans import problem_sql

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.reject_lines(table(spark, sf, "occurrences"), "raw_text", ["occurrence_id"]).select("occurrence_id").distinct()


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected lines by stream and reason, beside what the capture tools said of them."""
    lines = table(spark, sf, "occurrences").withColumn("claimed", F.lower(F.trim(F.coalesce("parse_status", F.lit("")))))
    bad = rejects.reject_lines(lines, "raw_text", ["stream_id", "occurrence_id", "claimed"])
    return bad.groupBy("stream_id", "claimed", "reason").agg(F.count("*").alias("n_lines"))


def _references(spark: SparkSession, sf: str) -> tuple[list[orphans.Reference], list[orphans.Target]]:
    lines, events, receipts = (table(spark, sf, t) for t in ("occurrences", "owner_events", "receipts"))
    targets = [orphans.Target("occurrences", lines, "occurrence_id", "ingested_at", "deleted_at"), orphans.Target("owner_events", events, "event_id", "delivered_at")]
    written = "disposition IN ('EMITTED', 'CONTRIBUTED', 'DROPPED')"
    return [
        orphans.Reference("owner_events", events, "delivery_id", "source_occurrence_ids", "delivered_at", "occurrences", own_key="event_id"),
        orphans.Reference("receipts", receipts, "receipt_id", "occurrence_id", "ingested_at", "occurrences"),
        orphans.Reference("receipts", receipts, "receipt_id", "event_id", "ingested_at", "owner_events", when=written),
    ], targets


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    cascade = orphans.orphan_cascade(*_references(spark, sf))
    return cascade.filter("orphaned = 'direct'").select("src_table", "src_key", "src_field", "ref_key").distinct()


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphan_cascade(*_references(spark, sf)))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    talks = nested.shred(table(spark, sf, "conversations"), "row_id", "chat_messages", "chat_messages", "uuid", ["type", "text"])
    kind = F.element_at("cells", "type")
    blocks = talks.filter((F.col("element") == "content") & (kind == '"text"') & nested.non_blank_string(F.element_at("cells", "text")))
    rows = nested.shred(table(spark, sf, "session_catalog").filter("session_id IS NOT NULL"), "session_id", "friction", "friction", None, ["ref"])
    frictions = rows.filter(F.col("element").isin("friction", "related") & nested.non_blank_string(F.element_at("cells", "ref")))
    pick = lambda df, kind: df.filter(F.col("parent_key").isNotNull() & F.col("anchored_path").rlike(r"^\d+(\.\d+)*$")).select("parent_key", F.lit(kind).alias("child_kind"), F.col("anchored_path").alias("child_path"))
    return pick(blocks, "block").unionByName(pick(frictions, "friction")).distinct()


def p4_tables(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows and distinct documents each flat table of the conversations and of the friction entries has, all fields read."""
    long = nested.shred(table(spark, sf, "conversations"), "row_id", "chat_messages", "chat_messages", "uuid")
    long = long.unionByName(nested.shred(table(spark, sf, "session_catalog").filter("session_id IS NOT NULL"), "session_id", "friction", "friction"))
    return long.groupBy("element", "parent_element").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_key").alias("n_docs"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    shape = drift.message_shape()
    report = drift.drift_report(table(spark, sf, "conversations"), "export_file", "chat_messages", shape)
    return report.select(F.col("file").alias("export_file"), F.concat(F.lit(f"{shape.prefix}."), "path").alias("field_path")).distinct()


def p5_renames(spark: SparkSession, sf: str) -> DataFrame:
    report = drift.drift_report(table(spark, sf, "conversations"), "export_file", "chat_messages", drift.message_shape())
    return report.filter("renamed_to IS NOT NULL").groupBy("path", "renamed_to").agg(F.count("*").alias("n_files"))


def p5_unified(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    report = drift.drift_report(rows, "export_file", "chat_messages", drift.message_shape())
    return drift.unify_messages(rows, "row_id", "export_file", "chat_messages", report)


def _times(spark: SparkSession, sf: str) -> DataFrame:
    events, talks = table(spark, sf, "owner_events"), table(spark, sf, "conversations")
    out = events.select(F.lit("owner_events").alias("src_table"), F.col("delivery_id").alias("row_key"), F.lit("timestamp").alias("src_field"), F.col("timestamp").alias("value"), "origin_zone")
    for name in ("created_at", "updated_at"):
        out = out.unionByName(talks.select(F.lit("conversations").alias("src_table"), F.col("row_id").alias("row_key"), F.lit(name).alias("src_field"), F.col(name).alias("value"), "origin_zone"))
    return clocks.normalise_times(out.filter("value IS NOT NULL"), ["src_table", "row_key", "src_field"], "value", "origin_zone")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _times(spark, sf).filter("status = 'instant' AND NOT is_canonical").select("src_table", "row_key", "src_field", "utc_us").distinct()


def p6_status(spark: SparkSession, sf: str) -> DataFrame:
    return _times(spark, sf).groupBy("src_table", "src_field", "status").agg(F.count("*").alias("n_values"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return redelivery.redelivered(table(spark, sf, "owner_events"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_reasons, p3_found, p3_report, p4_found, p4_tables, p5_found, p5_renames, p5_unified, p6_found, p6_status, p7_found)}
_SHAPE = drift.message_shape()
SQL: dict[str, str] = {
    "p3_found": problem_sql.P3_FOUND, "p3_report": problem_sql.P3_REPORT, "p4_found": problem_sql.P4_FOUND, "p5_found": problem_sql.p5_found(_SHAPE.required, _SHAPE.optional, _SHAPE.prefix), "p7_found": problem_sql.P7_FOUND,
}
