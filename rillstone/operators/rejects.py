"""Rows that fail to parse, told apart from those that load (problem 1)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.functions.instants import in_profile
from rillstone.functions.strictjson import kind_of, strict_loads
from rillstone.runtime import materialise

#: Reasons by precedence; the first that holds is reported.
REASONS = ["MALFORMED_JSON", "NON_OBJECT_JSON", "MISSING_ACTOR", "MALFORMED_RECORD", "INVALID_ATTACHMENT", "MISSING_REQUIRED_FIELD", "INVALID_TIMESTAMP", "INVALID_SHAPE"]
#: Beyond so many invalid distinct values the dictionary is joined by shuffle instead of broadcast.
DICTIONARY_BROADCAST_ROWS = 20_000

# Fixed values of the record format.
ATTACHMENT_FIELDS = {"type", "id", "name", "mime_type", "byte_count", "sha256"}
UNCAPTURED_TYPES = {"tool_pair", "tool_call", "tool_result", "compaction"}
TEXT_TYPES = {"queue_operation", "steering", "close"}
ECHO = "carried_history_echo"

_HEX = frozenset("0123456789abcdef")


def content_state(record: dict) -> str:
    """``invalid``, or which of text (t) and attachment (a) the record holds, such as ``t``, ``ta`` or an empty text."""
    text = record.get("text")
    has_text, has_file = isinstance(text, str) and text != "", False
    content = record.get("content")
    if content is None:
        content = []
    elif not isinstance(content, list):
        return "invalid"
    for block in content:
        if not isinstance(block, dict):
            return "invalid"
        kind = block.get("type")
        if kind == "text":
            body = block.get("text")
            if not isinstance(body, str):
                return "invalid"
            has_text |= body != ""
        elif kind == "attachment":
            size, digest = block.get("byte_count"), block.get("sha256")
            named = all(isinstance(block.get(k), str) and block[k] for k in ("id", "name", "mime_type", "sha256"))
            if block.keys() != ATTACHMENT_FIELDS or not named or kind_of(size) != "number" or isinstance(size, float) or size < 0 or len(digest) != 64 or not _HEX.issuperset(digest):
                return "invalid"
            has_file = True
        else:
            return "invalid"
    return "t" * has_text + "a" * has_file


#: The text of a cell whose name the record does not have; no JSON text is empty.
ABSENT = ""
REQUIRED, OPTIONAL = ("event_id", "record_id", "session_id", "record_type"), ("resume_of", "tool_call_id", "boundary")


def _raw(record: dict, name: str) -> str:
    return json.dumps(record[name], separators=(",", ":")) if name in record else ABSENT


def cells_of(record: dict) -> list[tuple[str, str]]:
    """``(column, text)`` of the cells that a record's rules look at, as they stand in the record."""
    cells = [("sender", _raw(record, "sender")), ("malformed", _raw(record, "record_type")), ("content", _raw(record, "content"))]
    if _captured(record):
        cells += [(n, _raw(record, n)) for n in (*REQUIRED, "logical_seq", *OPTIONAL, "timestamp")]
    return cells


def _captured(record: dict) -> bool:
    sender, kind = record.get("sender"), record.get("record_type")
    folded = kind.strip().lower() if isinstance(kind, str) else ""
    return isinstance(sender, str) and sender.strip().lower() in ("human", "owner") and record.get("boundary") != ECHO and folded not in UNCAPTURED_TYPES


def shape_fault(record: dict) -> str | None:
    """The structural check across the fields of a captured record: whether there is the text or attachment that its type asks for."""
    if not _captured(record):
        return None
    kind = record.get("record_type")
    folded, state = kind.strip().lower() if isinstance(kind, str) else "", content_state(record)
    if record.get("resume_of") is not None or folded in TEXT_TYPES:
        return None if "t" in state else "INVALID_SHAPE"
    return None if folded == "message" and state else "INVALID_SHAPE"


def cast_reason(column: str, text: str) -> str | None:
    """Why a distinct cell cannot be cast to what its column asks for; None if it can."""
    there = text != ABSENT
    value = strict_loads(text) if there else None
    full = isinstance(value, str) and value != ""
    if column == "sender":
        return None if full and value.strip() else "MISSING_ACTOR"
    if column == "malformed":
        return "MALFORMED_RECORD" if value == "malformed" else None
    if column == "content":
        return "INVALID_ATTACHMENT" if content_state({"content": value}) == "invalid" else None
    if column in REQUIRED:
        return None if full else "MISSING_REQUIRED_FIELD"
    if column == "logical_seq":
        return None if type(value) is int and value >= 1 else "MISSING_REQUIRED_FIELD"
    if column in OPTIONAL:
        return None if value is None or full else "MISSING_REQUIRED_FIELD"
    return None if in_profile(value) else "INVALID_TIMESTAMP"


def _parser(keys: int, names: list[str]):
    cell = pa.struct([("column", pa.string()), ("digest", pa.binary()), ("text", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons, cells = [], []
            for text in batch.column(keys).to_pylist():
                reason, found = None, []
                try:
                    value = strict_loads(text or "")
                    if isinstance(value, dict):
                        reason = shape_fault(value)
                        found = [{"column": c, "digest": blake2b(t.encode(), digest_size=16).digest(), "text": t} for c, t in cells_of(value)]
                    else:
                        reason = "NON_OBJECT_JSON"
                except (ValueError, RecursionError):
                    reason = "MALFORMED_JSON"
                reasons.append(reason)
                cells.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], pa.array(reasons, pa.string()), pa.array(cells, pa.list_(cell))], names=names)

    return parse


def _reasons(column: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([cast_reason(c, t) for c, t in zip(column, text)], dtype=object)


def invalid_values(cells: DataFrame) -> DataFrame:
    """``column, digest, reason`` of the distinct cells ``column, digest, text`` that cannot be cast: each distinct value of a column is cast once."""
    return cells.distinct().withColumn("reason", F.pandas_udf(_reasons, "string")("column", "text")).filter("reason IS NOT NULL").select("column", "digest", "reason").distinct()


def reject_lines(lines: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys..., reason``: one row per distinct key of lines that must be rejected.

    Structural faults (no strict JSON, no object, a shape that does not fit the type) are found by a strict parse of each line; all other faults
    come from the cells as they stand: each distinct value of a column is cast once, and the dictionary of invalid values with their reasons is
    joined back to the lines by digests of 128 bits. Null and blank lines are MALFORMED_JSON. Of several reasons the first of REASONS is given. An empty input gives no
    rows; columns that ``lines`` has besides ``keys`` and ``text`` are not looked at.
    """
    chosen = lines.select(*keys, F.col(text).alias("__raw"))
    names = [*keys, "__structure", "__cells"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]] + ["`__structure` string", "`__cells` array<struct<column:string,digest:binary,text:string>>"])
    parsed = materialise(chosen.mapInArrow(_parser(len(keys), names), schema), "parsed")
    structural = parsed.filter("__structure IS NOT NULL").select(*keys, F.col("__structure").alias("reason"))
    dictionary = materialise(invalid_values(parsed.select(F.explode("__cells").alias("c")).select("c.*")), "invalid")
    small = dictionary.limit(DICTIONARY_BROADCAST_ROWS + 1).count() <= DICTIONARY_BROADCAST_ROWS
    dictionary = dictionary.toDF("__column", "__digest", "reason")
    cells = parsed.select(*keys, F.explode("__cells").alias("__c")).select(*keys, F.col("__c.column").alias("__column"), F.col("__c.digest").alias("__digest"))
    found = cells.join(F.broadcast(dictionary) if small else dictionary, ["__column", "__digest"]).select(*keys, "reason")
    order = F.create_map(*[F.lit(x) for i, r in enumerate(REASONS) for x in (r, i)])
    first = structural.unionByName(found).groupBy(*keys).agg(F.min(order[F.col("reason")]).alias("__rank"))
    return first.select(*keys, F.element_at(F.array(*map(F.lit, REASONS)), F.col("__rank") + 1).alias("reason"))


def split_lines(lines: DataFrame, text: str = "raw_text") -> tuple[DataFrame, DataFrame]:
    """``(loaded, rejected)``: all input rows, each in exactly one of the two; ``rejected`` has ``reject_reason`` besides.

    A column ``reject_reason`` or ``line_digest`` of the input is replaced.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("\0null")))
    keyed = lines.drop("reject_reason", "line_digest").withColumn("line_digest", digest)
    bad = reject_lines(keyed, text, ["line_digest"]).withColumnRenamed("reason", "reject_reason")
    loaded = keyed.join(bad, "line_digest", "left_anti").drop("line_digest")
    return loaded, keyed.join(bad, "line_digest").drop("line_digest")
