"""Canonical capture: every line gets one receipt, owner lines become events, counters are recomputable."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.instants import canonical_instant
from rillstone.functions.strictjson import canonical, strict_loads
from rillstone.functions.text import valid_locator, valid_stream
from rillstone.operators.rejects import content_state
from rillstone.runtime import materialise

# The enumerations of the data model.
DISPOSITIONS = ["EMITTED", "CONTRIBUTED", "SUPPRESSED", "DROPPED", "REJECTED"]
EVENT_CLASSES = [
    "ordinary_user_turn", "queued_mid_turn_user_message", "queue_operation_record", "attachment_only_message", "message_with_attachment_and_text", "steering_interruption", "resumed_session", "close_handoff_event",
]
MESSAGE_CLASSES = ["ordinary_user_turn", "attachment_only_message", "message_with_attachment_and_text"]
REASON_CODES = [
    "OWNER_EVENT_EMITTED", "SEMANTIC_EVENT_ASSEMBLY", "DUPLICATE_DURABLE_ID", "NON_OWNER_ACTOR", "TOOL_RECORD", "SYSTEM_BOUNDARY", "CARRIED_HISTORY_ECHO", "MALFORMED_JSON", "NON_OBJECT_JSON", "MALFORMED_RECORD",
    "MISSING_ACTOR", "INVALID_ATTACHMENT", "MISSING_REQUIRED_FIELD", "INVALID_TIMESTAMP",
]

_ATTACHMENT = "struct<id:string,name:string,mime_type:string,byte_count:bigint,sha256:string>"
_PARSED = (
    "parse_status string, record string, sender string, record_type string, record_type_raw string, boundary string, content_state string, event_id string, record_id string, session_id string, logical_seq bigint, "
    f"resume_of string, tool_call_id string, optional_ok boolean, has_timestamp boolean, timestamp string, text_blocks array<string>, attachments array<{_ATTACHMENT}>"
)


def _flatten(text: str | None) -> dict:
    out: dict = {"parse_status": "MALFORMED_JSON"}
    try:
        value = strict_loads(text or "")
    except ValueError:
        return out
    if not isinstance(value, dict):
        return {"parse_status": "NON_OBJECT_JSON"}
    filled = lambda n: value[n] if isinstance(value.get(n), str) and value[n] else None
    sender, kind, seq = value.get("sender"), value.get("record_type"), value.get("logical_seq")
    blocks = value.get("content") if isinstance(value.get("content"), list) else []
    blocks = [b for b in blocks if isinstance(b, dict)]
    texts = [t for t in [filled("text"), *(b.get("text") for b in blocks if b.get("type") == "text")] if isinstance(t, str) and t]
    state = content_state(value)
    return {
        "parse_status": "OBJECT", "record": canonical(value), "sender": sender.strip().lower() if isinstance(sender, str) else "", "record_type": kind.strip().lower() if isinstance(kind, str) else "",
        "record_type_raw": kind if isinstance(kind, str) else None, "boundary": filled("boundary"), "content_state": state, "event_id": filled("event_id"), "record_id": filled("record_id"), "session_id": filled("session_id"),
        "logical_seq": seq if type(seq) is int and 1 <= seq < 2**63 else None, "resume_of": filled("resume_of"), "tool_call_id": filled("tool_call_id"),
        "optional_ok": all(value.get(n) is None or filled(n) for n in ("resume_of", "tool_call_id", "boundary")), "has_timestamp": "timestamp" in value,
        "timestamp": canonical_instant(value["timestamp"]) if isinstance(value.get("timestamp"), str) else None, "text_blocks": texts,
        "attachments": [{k: b[k] for k in ("id", "name", "mime_type", "byte_count", "sha256")} for b in blocks if b.get("type") == "attachment"] if state != "invalid" else [],
    }


def parse_lines(lines: DataFrame, keep: list[str], text: str = "raw_text") -> DataFrame:
    """``keep...`` and the typed fields of each line's strict parse."""
    chosen = lines.select(*keep, F.col(text).alias("__raw"))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])
    attachment = pa.struct([("id", pa.string()), ("name", pa.string()), ("mime_type", pa.string()), ("byte_count", pa.int64()), ("sha256", pa.string())])
    special = {"logical_seq": pa.int64(), "optional_ok": pa.bool_(), "has_timestamp": pa.bool_(), "text_blocks": pa.list_(pa.string()), "attachments": pa.list_(attachment)}
    fields = ["parse_status", "record", "sender", "record_type", "record_type_raw", "boundary", "content_state", "event_id", "record_id", "session_id", "logical_seq", "resume_of", "tool_call_id", "optional_ok", "has_timestamp", "timestamp", "text_blocks", "attachments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_flatten(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array([r.get(f) for r in rows], special.get(f, pa.string())) for f in fields)], names=[*keep, *fields])

    return chosen.mapInArrow(run, f"{own}, {_PARSED}")


def classify() -> tuple[Column, Column]:
    """``(reason, event class)`` of parsed lines; the first rule that holds decides, and a null reason means captured."""
    c = F.col
    text, files = c("content_state").contains("t"), c("content_state").contains("a")
    kind = c("record_type")
    event_class = (
        F.when(c("resume_of").isNotNull(), "resumed_session").when(kind == "queue_operation", "queue_operation_record").when(kind == "steering", "steering_interruption").when(kind == "close", "close_handoff_event")
        .when((kind == "message") & files & text, "message_with_attachment_and_text").when((kind == "message") & files, "attachment_only_message")
        .when((kind == "message") & F.lower("boundary").contains("queue") & text, "queued_mid_turn_user_message").when((kind == "message") & text, "ordinary_user_turn")
    )
    needs_text = event_class.isin("resumed_session", "queue_operation_record", "steering_interruption", "close_handoff_event")
    missing = c("event_id").isNull() | c("record_id").isNull() | c("session_id").isNull() | (F.coalesce("record_type_raw", F.lit("")) == "") | ~c("has_timestamp") | c("logical_seq").isNull() | ~c("optional_ok")
    reason = (
        F.when(c("parse_status") != "OBJECT", c("parse_status")).when(c("sender") == "", "MISSING_ACTOR").when(c("record_type_raw") == "malformed", "MALFORMED_RECORD").when(c("content_state") == "invalid", "INVALID_ATTACHMENT")
        .when(c("boundary") == "carried_history_echo", "CARRIED_HISTORY_ECHO").when(kind.isin("tool_pair", "tool_call", "tool_result") | (c("sender") == "tool"), "TOOL_RECORD")
        .when((kind == "compaction") | (c("sender") == "system"), "SYSTEM_BOUNDARY").when(~c("sender").isin("human", "owner"), "NON_OWNER_ACTOR").when(missing, "MISSING_REQUIRED_FIELD")
        .when(c("timestamp").isNull(), "INVALID_TIMESTAMP").when(event_class.isNull() | (needs_text & ~text), "MISSING_REQUIRED_FIELD")
    )
    return reason, event_class


def classify_lines(lines: DataFrame, keep: list[str], text: str = "raw_text") -> DataFrame:
    reason, event_class = classify()
    parsed = parse_lines(lines, keep, text).withColumn("reason", reason)
    suppressed = F.col("reason").isin("CARRIED_HISTORY_ECHO", "TOOL_RECORD", "SYSTEM_BOUNDARY", "NON_OWNER_ACTOR")
    return parsed.withColumn("event_class", F.when(F.col("reason").isNull(), event_class)).withColumn("action", F.when(F.col("reason").isNull(), "CAPTURE").when(suppressed, "SUPPRESSED").otherwise("REJECTED"))


def occurrence_violations(lines: DataFrame) -> DataFrame:
    """Lines whose envelope breaks the contract, with the first violation; duplicate ids and locators are among them."""
    n = F.regexp_extract("source_locator", "#L([0-9]+)$", 1).try_cast("bigint")
    twice = lambda c: lines.groupBy(F.col(c).alias(f"__{c}")).count().filter("count > 1").select(f"__{c}", F.lit(True).alias(f"__twice_{c}"))
    counted = lines
    for c in ("occurrence_id", "source_locator"):
        counted = counted.join(twice(c), F.col(c) == F.col(f"__{c}"), "left").drop(f"__{c}")
    violation = (
        F.when(F.coalesce("occurrence_id", F.lit("")) == "", "occurrence_id:empty").when(~valid_stream(F.col("stream_id")), "stream_id:form").when(~valid_locator(F.col("source_locator")), "source_locator:form")
        .when(F.coalesce(n != F.col("line_number"), F.lit(True)), "line_number:locator").when(F.coalesce(F.sha2("raw_text", 256) != F.col("raw_line_sha256"), F.lit(True)), "raw_line_sha256:mismatch")
        .when(F.col("__twice_occurrence_id"), "occurrence_id:duplicate").when(F.col("__twice_source_locator"), "source_locator:duplicate")
    )
    return counted.withColumn("violation", violation).filter("violation IS NOT NULL").drop("__twice_occurrence_id", "__twice_source_locator")


def with_roles(rows: DataFrame, event: str, record: str, order: list[str]) -> DataFrame:
    """Adds ``disposition``: the first row of an event is EMITTED, the first of each further record of it CONTRIBUTED, all others DROPPED. ``order`` tells the
    rows apart; firsts are found by aggregation, so no event is sorted in one task."""
    place = F.struct(*order)
    records = rows.groupBy(event, record).agg(F.min(place).alias("__record"))
    firsts = records.join(records.groupBy(event).agg(F.min("__record").alias("__event")), event).select(F.col("__record"), (F.col("__record") == F.col("__event")).alias("__emitted"))
    # a row that is the first of its record is told by its place alone
    marked = rows.withColumn("__record", place).join(firsts, "__record", "left")
    return marked.withColumn("disposition", F.when(F.col("__emitted").isNull(), "DROPPED").when(F.col("__emitted"), "EMITTED").otherwise("CONTRIBUTED")).drop("__record", "__emitted")


def joined_blocks(rows: DataFrame, event: str, order: str, blocks: str) -> DataFrame:
    """``event, text``: the distinct blocks of an event's rows, in the order in which they first came, one a line. Copies collapse before an event is
    gathered; null blocks are none."""
    each = rows.select(event, order, F.posexplode(blocks).alias("__k", "__t")).filter("__t IS NOT NULL")
    once = each.groupBy(event, "__t").agg(F.min(F.struct(order, "__k")).alias("__at"))
    listed = once.groupBy(event).agg(F.array_sort(F.collect_list(F.struct("__at", "__t"))).alias("__l"))
    return listed.select(event, F.array_join(F.transform("__l", lambda x: x["__t"]), "\n").alias("text"))


def normalise(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(events, receipts)`` of occurrences (``occurrence_id, stream_id, source_locator, line_number, raw_text``).

    Within an event the lines rank by stream and line number. The first is EMITTED, a further record CONTRIBUTED, an identical copy of a record
    DROPPED. Contradictions (an event in two streams, one record id with two contents, differing scalars or instants, one attachment id with two
    contents, classes that do not go together) raise an error when the events are read.
    """
    keep = ["occurrence_id", "stream_id", "source_locator", "line_number"]
    rows = materialise(classify_lines(lines.select(*keep, "raw_text"), keep), "classified")
    captured = with_roles(rows.filter("action = 'CAPTURE'"), "event_id", "record_id", ["line_number", "occurrence_id", "stream_id"])
    accepted = captured.filter("disposition <> 'DROPPED'")
    member = F.struct(F.struct("line_number", "occurrence_id").alias("at"), "record_id", "occurrence_id", "source_locator", "text_blocks", "attachments", "session_id", "resume_of", "logical_seq", "tool_call_id", "boundary", "timestamp", "event_class", "stream_id", "line_number")
    distinct_scalars = F.count_distinct(F.struct("session_id", "resume_of", "logical_seq", "tool_call_id", "boundary", "timestamp"))
    copies = captured.groupBy("event_id", "record_id").agg(F.count_distinct("record").alias("v")).groupBy("event_id").agg(F.max("v").alias("record_versions"))
    groups = accepted.groupBy("event_id").agg(F.array_sort(F.collect_list(member)).alias("m"), distinct_scalars.alias("scalars"), F.count_distinct("stream_id").alias("streams"), F.collect_set("event_class").alias("classes"))
    groups = groups.join(copies, "event_id")
    first = F.element_at("m", 1)
    files = F.array_distinct(F.flatten(F.transform("m", lambda x: x["attachments"])))
    texts = F.array_distinct(F.flatten(F.transform("m", lambda x: x["text_blocks"])))
    special = F.array_except("classes", F.array(*map(F.lit, MESSAGE_CLASSES)))
    merged = F.when(F.size(special) == 1, F.element_at(special, 1)).when((F.size(files) > 0) & (F.size(texts) > 0), "message_with_attachment_and_text").when(F.size(files) > 0, "attachment_only_message").otherwise("ordinary_user_turn")
    conflict = (
        F.when(F.col("streams") > 1, "cross-stream event").when(F.col("record_versions") > 1, "conflicting durable id").when(F.col("scalars") > 1, "conflicting scalar or timestamp")
        .when(F.size(F.array_distinct(F.transform(files, lambda f: f["id"]))) < F.size(files), "conflicting attachment id").when((F.size(special) > 1) | ((F.size(special) == 1) & (F.size("classes") > 1)), "incompatible classes")
    )
    sound = F.when(conflict.isNotNull(), F.raise_error(F.concat(conflict, F.lit(": "), "event_id")).cast("string")).otherwise(F.col("event_id"))
    derivation = F.when(F.size("m") > 1, "MULTI_RECORD_ASSEMBLY").otherwise("DIRECT_SOURCE_FIELDS")
    events = groups.select(
        sound.alias("event_id"), F.transform("m", lambda x: x["record_id"]).alias("source_record_ids"), F.transform("m", lambda x: x["occurrence_id"]).alias("source_occurrence_ids"), first["session_id"].alias("session_id"),
        first["resume_of"].alias("resume_of"), first["logical_seq"].alias("logical_seq"), first["timestamp"].alias("timestamp"), F.lit("owner").alias("actor"), merged.alias("event_class"), texts.alias("text_blocks"),
        files.alias("attachments"), first["tool_call_id"].alias("tool_call_id"), first["boundary"].alias("boundary"),
        F.struct(F.transform("m", lambda x: x["source_locator"]).alias("source_locators"), derivation.alias("derivation")).alias("provenance"), first["stream_id"].alias("stream_id"), first["line_number"].alias("first_line"),
    )
    classes = events.select("event_id", "event_class")
    kept = captured.drop("event_class").join(classes, "event_id").withColumn("reason_code", F.when(F.col("disposition") == "DROPPED", "DUPLICATE_DURABLE_ID").when(F.col("disposition") == "EMITTED", "OWNER_EVENT_EMITTED").otherwise("SEMANTIC_EVENT_ASSEMBLY"))
    others = rows.filter("action <> 'CAPTURE'").withColumns({"disposition": F.col("action"), "reason_code": F.col("reason"), "event_class": F.lit(None).cast("string")})
    columns = [F.concat(F.lit("RCPT-"), "occurrence_id").alias("receipt_id"), "occurrence_id", "source_locator", F.col("record_id").alias("source_record_id"), "event_id", "event_class", "disposition", "reason_code"]
    return events, kept.select(*columns).unionByName(others.select(*columns))


def event_order(events: DataFrame) -> DataFrame:
    """By stream, sequence, instant (whole seconds, then fraction digits), first line and id."""
    second, fraction = F.substring("timestamp", 1, 19), F.regexp_extract("timestamp", r"\.(\d+)Z$", 1)
    return events.orderBy("stream_id", "logical_seq", second, fraction, "first_line", "event_id")


def disposition_counts(receipts: DataFrame) -> DataFrame:
    """``disposition, n`` with a row for each disposition."""
    every = receipts.sparkSession.createDataFrame([(d,) for d in DISPOSITIONS], "disposition string")
    return every.join(receipts.groupBy("disposition").agg(F.count("*").alias("n")), "disposition", "left").fillna(0, ["n"])


def class_counts(receipts: DataFrame) -> DataFrame:
    """``event_class, semantic_events, emitted_events, contributing_occurrences, dropped_occurrences`` with a row for each class."""
    every = receipts.sparkSession.createDataFrame([(c,) for c in EVENT_CLASSES], "event_class string")
    emitted = F.count_if(F.col("disposition") == "EMITTED")
    sums = receipts.groupBy("event_class").agg(
        emitted.alias("semantic_events"), emitted.alias("emitted_events"), F.count_if(F.col("disposition").isin("EMITTED", "CONTRIBUTED")).alias("contributing_occurrences"), F.count_if(F.col("disposition") == "DROPPED").alias("dropped_occurrences")
    )
    return every.join(sums, "event_class", "left").fillna(0)


def reason_counts(receipts: DataFrame) -> DataFrame:
    """``reason_code, n`` of the reasons observed."""
    return receipts.groupBy("reason_code").agg(F.count("*").alias("n"))


def build_counters(events: DataFrame, receipts: DataFrame) -> dict:
    """The nested counters; each is a handful of numbers."""
    d = {r["disposition"]: r["n"] for r in disposition_counts(receipts).collect()}
    c = {r["event_class"]: {k: r[k] for k in r.asDict() if k != "event_class"} for r in class_counts(receipts).collect()}
    n = events.count()
    return {"occurrences": sum(d.values()), "receipts": sum(d.values()), "semantic_events": n, "emitted_events": d["EMITTED"], "by_disposition": d, "by_event_class": c, "by_reason_code": {r["reason_code"]: r["n"] for r in reason_counts(receipts).collect()}}


def recount(events: DataFrame, receipts: DataFrame) -> dict:
    """The same counters by another way: classes from the events, contributors from their sources, only drops and the rest from the receipts."""
    by_class = {c: dict.fromkeys(("semantic_events", "emitted_events", "contributing_occurrences", "dropped_occurrences"), 0) for c in EVENT_CLASSES}
    for r in events.groupBy("event_class").agg(F.count("*").alias("n"), F.sum(F.size("source_occurrence_ids")).alias("k")).collect():
        by_class[r["event_class"]] |= {"semantic_events": r["n"], "emitted_events": r["n"], "contributing_occurrences": r["k"]}
    disposition, reason = dict.fromkeys(DISPOSITIONS, 0), {}
    for r in receipts.groupBy("disposition", "reason_code", "event_class").agg(F.count("*").alias("n")).collect():  # a few dozen combinations
        disposition[r["disposition"]] += r["n"]
        reason[r["reason_code"]] = reason.get(r["reason_code"], 0) + r["n"]
        if r["disposition"] == "DROPPED":
            by_class[r["event_class"]]["dropped_occurrences"] += r["n"]
    total, emitted = sum(disposition.values()), sum(c["emitted_events"] for c in by_class.values())
    return {"occurrences": total, "receipts": total, "semantic_events": emitted, "emitted_events": emitted, "by_disposition": disposition, "by_event_class": by_class, "by_reason_code": reason}


def counter_violations(counters: dict) -> list[str]:
    """What is wrong with the shape of counters: missing or unknown names, and numbers that are no integers of at least 0."""
    numbers = lambda d, where: [f"{where}.{k}" for k, v in d.items() if type(v) is not int or v < 0]
    out = [f"names: {k}" for k in {"occurrences", "receipts", "semantic_events", "emitted_events", "by_disposition", "by_event_class", "by_reason_code"} ^ counters.keys()]
    if out:
        return out
    out += numbers({k: counters[k] for k in ("occurrences", "receipts", "semantic_events", "emitted_events")}, "total") + numbers(counters["by_disposition"], "by_disposition") + numbers(counters["by_reason_code"], "by_reason_code")
    out += [f"by_disposition: {k}" for k in set(DISPOSITIONS) ^ counters["by_disposition"].keys()] + [f"by_event_class: {k}" for k in set(EVENT_CLASSES) ^ counters["by_event_class"].keys()]
    out += [f"by_reason_code: {k}" for k in counters["by_reason_code"] if k not in REASON_CODES]
    for name, row in counters["by_event_class"].items():
        out += numbers(row, name)
    return out


def event_violations(events: DataFrame) -> DataFrame:
    """Events that break the contract, with the first violation."""
    c = F.col
    ids, lines, locators = c("source_record_ids"), c("source_occurrence_ids"), c("provenance.source_locators")
    distinct = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    has_text, has_files = F.coalesce(F.size("text_blocks") > 0, F.lit(False)), F.coalesce(F.size("attachments") > 0, F.lit(False))
    expected = F.when(F.size(ids) > 1, "MULTI_RECORD_ASSEMBLY").otherwise("DIRECT_SOURCE_FIELDS")
    violation = (
        F.when(F.coalesce("event_id", F.lit("")) == "", "event_id:empty").when(F.coalesce("session_id", F.lit("")) == "", "session_id:empty").when(F.coalesce(c("logical_seq") < 1, F.lit(True)), "logical_seq:range")
        .when(F.coalesce(c("actor") != "owner", F.lit(True)), "actor:value").when(~F.coalesce(c("event_class").isin(EVENT_CLASSES), F.lit(False)), "event_class:value")
        .when(~F.coalesce(c("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:[0-5]\d(\.\d*[1-9])?Z$"), F.lit(False)), "timestamp:canonical")
        .when(F.coalesce(F.size(ids) < 1, F.lit(True)) | F.coalesce(F.size(ids) != F.size(lines), F.lit(True)) | F.coalesce(F.size(ids) != F.size(locators), F.lit(True)), "sources:cardinality")
        .when(~(distinct(ids) & distinct(lines) & distinct(locators)), "sources:unique").when(F.coalesce(c("provenance.derivation") != expected, F.lit(True)), "derivation:cardinality")
        .when(~distinct(c("text_blocks")), "text_blocks:unique").when(~distinct(F.transform("attachments", lambda a: a["id"])), "attachments:unique")
        .when(F.exists("attachments", lambda a: ~F.coalesce(a["sha256"].rlike("^[0-9a-f]{64}$") & (a["byte_count"] >= 0), F.lit(False))), "attachments:form")
        .when((c("event_class") == "attachment_only_message") & (has_text | ~has_files), "class:shape").when((c("event_class") == "message_with_attachment_and_text") & ~(has_text & has_files), "class:shape")
        .when((c("event_class") == "ordinary_user_turn") & (~has_text | has_files), "class:shape").when((c("event_class") == "resumed_session") & c("resume_of").isNull(), "class:resume_of")
        .when(c("event_class").isin("queue_operation_record", "steering_interruption", "close_handoff_event") & c("boundary").isNull(), "class:boundary")
    )
    return events.withColumn("violation", violation).filter("violation IS NOT NULL")


def receipt_violations(receipts: DataFrame) -> DataFrame:
    """Receipts whose id, disposition, reason and class do not go together, with the first violation."""
    c = F.col
    captured = {"EMITTED": "OWNER_EVENT_EMITTED", "CONTRIBUTED": "SEMANTIC_EVENT_ASSEMBLY", "DROPPED": "DUPLICATE_DURABLE_ID"}
    suppressing = ["NON_OWNER_ACTOR", "TOOL_RECORD", "SYSTEM_BOUNDARY", "CARRIED_HISTORY_ECHO"]
    fits = F.lit(False)
    for d, r in captured.items():
        fits = fits | ((c("disposition") == d) & (c("reason_code") == r))
    rejecting = [r for r in REASON_CODES if r not in suppressing and r not in captured.values()]
    fits = fits | ((c("disposition") == "SUPPRESSED") & c("reason_code").isin(suppressing)) | ((c("disposition") == "REJECTED") & c("reason_code").isin(rejecting))
    violation = (
        F.when(~F.coalesce(c("receipt_id") == F.concat(F.lit("RCPT-"), "occurrence_id"), F.lit(False)), "receipt_id:binding").when(~F.coalesce(c("disposition").isin(DISPOSITIONS), F.lit(False)), "disposition:value")
        .when(~F.coalesce(fits, F.lit(False)), "reason_code:disposition").when(c("disposition").isin([*captured]) & (c("event_id").isNull() | c("event_class").isNull() | c("source_record_id").isNull()), "captured:fields")
        .when(~c("disposition").isin([*captured]) & c("event_class").isNotNull(), "event_class:uncaptured")
    )
    return receipts.withColumn("violation", violation).filter("violation IS NOT NULL")


def packet_violations(lines: DataFrame, events: DataFrame, receipts: DataFrame) -> DataFrame:
    """``kind, key`` of what does not match between occurrences, receipts and events."""
    line_ids, receipt_ids = lines.select("occurrence_id"), receipts.select("occurrence_id")
    used = events.select("event_id", F.explode("source_occurrence_ids").alias("occurrence_id"))
    claimed = receipts.filter("disposition IN ('EMITTED', 'CONTRIBUTED')").select("event_id", "occurrence_id")
    tag = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    doubled = receipts.groupBy("occurrence_id").count().filter("count > 1")
    parts = [
        tag(line_ids.join(receipt_ids, "occurrence_id", "left_anti"), "line-without-receipt", "occurrence_id"), tag(receipt_ids.join(line_ids, "occurrence_id", "left_anti"), "receipt-without-line", "occurrence_id"),
        tag(doubled, "line-with-several-receipts", "occurrence_id"), tag(used.join(claimed, ["event_id", "occurrence_id"], "left_anti"), "event-source-without-receipt", "occurrence_id"),
        tag(claimed.join(used, ["event_id", "occurrence_id"], "left_anti"), "receipt-without-event-source", "occurrence_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _canonical_rows(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([canonical({k: r[k] for k in columns}) for r in batch.to_pylist()], pa.string())], names=["value"])

    return run


def canonical_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``value``: each row as one canonical JSON text, keys sorted, ASCII only, nulls kept."""
    return rows.select(*columns).mapInArrow(_canonical_rows(columns), "value string")


# The fields of the written records.
EVENT_KEYS = [
    "event_id", "source_record_ids", "source_occurrence_ids", "session_id", "resume_of", "logical_seq", "timestamp", "actor", "event_class",
    "text_blocks", "attachments", "tool_call_id", "boundary", "provenance",
]
RECEIPT_KEYS = [
    "receipt_id", "occurrence_id", "source_locator", "source_record_id", "event_id", "event_class", "disposition", "reason_code",
]
LINE_KEYS = [
    "occurrence_id", "stream_id", "source_locator", "line_number", "raw_line_sha256", "raw_text",
]


def publish_bundle(lines: DataFrame, target: str, still_unchanged=lambda: True) -> dict[str, str]:
    """Write a bundle directory of JSON lines, counters and hashes in one step; returns the hashes.

    The directory must not exist. Everything is staged beside it and renamed last, after ``still_unchanged`` agreed; a failure leaves nothing.
    Lines are streamed to the driver's disk in order, so a bundle has the size of a file, not of the driver's memory.
    """
    if os.path.exists(target):
        raise FileExistsError(target)
    staging = tempfile.mkdtemp(prefix=".bundle-", dir=os.path.dirname(os.path.abspath(target)))
    try:
        bad = occurrence_violations(lines).select("violation").head(1)
        if bad:
            raise ValueError(bad[0][0])
        events, receipts = normalise(lines)
        events = materialise(events, "events")
        wrong = event_violations(events).select("violation", "event_id").head(1)
        if wrong:
            raise ValueError(f"{wrong[0][0]}: {wrong[0][1]}")
        receipts = materialise(receipts, "receipts")
        order = receipts.join(lines.select("occurrence_id", "stream_id", "line_number"), "occurrence_id").orderBy("stream_id", "line_number")
        files = {
            "occurrences.jsonl": canonical_lines(lines.orderBy("stream_id", "line_number"), LINE_KEYS), "events.jsonl": canonical_lines(event_order(events), EVENT_KEYS), "receipts.jsonl": canonical_lines(order, RECEIPT_KEYS)
        }
        hashes = {}
        for name, rows in files.items():
            digest = hashlib.sha256()
            with open(os.path.join(staging, name), "wb") as f:
                for r in rows.toLocalIterator():
                    line = (r[0] + "\n").encode()
                    digest.update(line)
                    f.write(line)
            hashes[name] = digest.hexdigest()
        for name, value in (("counters.json", build_counters(events, receipts)), ("manifest.json", {"outputs": hashes})):
            with open(os.path.join(staging, name), "w", encoding="ascii") as f:
                f.write(json.dumps(value, sort_keys=True, separators=(",", ":")) + "\n")
        if not still_unchanged():
            raise ValueError("the input changed while it was read")
        os.rename(staging, target)
        return hashes
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
