"""Line-oriented sources."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.strictjson import strict_loads
from rillstone.functions.text import SPACES, filled, locator, occurrence_id, strip

#: Line ends of the strict format, and those a tolerant text reader knows.
STRICT_ENDS = "\r\n|\n|\r"
TOLERANT_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def split_records(text: Column, ends: str = STRICT_ENDS) -> Column:
    """Lines of a text; a line end at the very end adds no empty record, an empty text has none."""
    parts = F.split(text, ends)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))).otherwise(parts)


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, sha256, size``: each file read once, with its identity."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def verify_unchanged(spark: SparkSession, path: str, captured: DataFrame) -> DataFrame:
    """Rows of files that changed, vanished or appeared since they were captured."""
    now = capture_files(spark, path).select("path", F.col("sha256").alias("now"))
    return captured.select("path", "sha256").join(now, "path", "full_outer").filter("NOT (sha256 <=> now)")


def raw_lines(files: DataFrame, stream: str, label: str) -> DataFrame:
    """One row per physical line, blank and malformed ones too. A byte order mark or invalid UTF-8 raises an error."""
    text = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.raise_error(F.concat(F.lit("byte order mark in "), "path")).cast("string"))
    text = text.when(~F.is_valid_utf8(F.col("content").cast("string")), F.raise_error(F.concat(F.lit("invalid UTF-8 in "), "path")).cast("string")).otherwise(F.decode("content", "UTF-8"))
    lines = files.select("path", F.posexplode(split_records(text)).alias("p", "raw_text"))
    n = F.col("p") + 1
    return lines.select(
        occurrence_id(F.lit(stream), n).alias("occurrence_id"), F.lit(stream).alias("stream_id"), locator(F.lit(label), n).alias("source_locator"), n.cast("bigint").alias("line_number"),
        F.sha2("raw_text", 256).alias("raw_line_sha256"), "raw_text",
    )


def _faults(required: frozenset[str], optional: frozenset[str]):
    def judge(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                value = strict_loads(text or "")
                bad = "not an object" if not isinstance(value, dict) else ", ".join([f"without {k}" for k in sorted(required - value.keys())] + [f"unknown {k}" for k in sorted(value.keys() - required - optional)])
            except ValueError as e:
                bad = f"no strict JSON: {e}"
            out.append(bad or None)
        return pd.Series(out, dtype=object)

    return judge


def _is_whole(texts: pd.Series) -> pd.Series:
    def whole(text: str) -> bool:
        try:
            json.loads(text)
        except (ValueError, RecursionError):
            return False
        return True

    return texts.map(whole)


def strict_fault(text: Column, required: list[str], optional: list[str] = ()) -> Column:
    """Why a line is not exactly one JSON object of the given names, each once, with finite numbers and nothing after it; null if it is."""
    return F.pandas_udf(_faults(frozenset(required), frozenset(optional)), "string")(text)


def tolerant_records(spark: SparkSession, path: str) -> DataFrame:
    """``line_number, line, record, reason`` of a JSONL file: ``record`` is a variant where the line is an object; reason is ``parse_error``
    or ``non_object`` else. Blank lines are left out, bad bytes replaced."""
    text = spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("t"))
    lines = text.select("path", F.posexplode(split_records(F.col("t"), TOLERANT_ENDS)).alias("p", "line")).withColumn("line", strip(F.col("line"))).filter("line <> ''")
    value = F.try_parse_json("line")
    # the reader of variants stops at the end of the first value
    whole = F.pandas_udf(_is_whole, "boolean")("line")
    reason = F.when(value.isNull() | ~whole, "parse_error").when(~F.schema_of_variant(value).startswith("OBJECT"), "non_object")
    return lines.select("path", (F.col("p") + 1).alias("line_number"), "line", F.when(reason.isNull(), value).alias("record"), reason.alias("reason"))


def field(record: Column, name: str) -> Column:
    """A string field of a variant record; null where it is absent or no string."""
    v = F.try_variant_get(record, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(record, f"$.{name}", "string"))


def threads_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows; those without a goal are left out."""
    r = F.col("record")
    rows = tolerant_records(spark, path).filter("reason IS NULL")
    cols = [field(r, n).alias(n) for n in ("topic", "goal", "status", "state", "last_touched", "slug")]
    lists = [F.try_variant_get(r, f"$.{n}", "array<string>").alias(n) for n in ("status_sources", "pointers")]
    return rows.select(*cols, *lists).filter(filled(strip(F.col("goal"))).isNotNull())


def conversations_document(spark: SparkSession, path: str) -> DataFrame:
    """``position, conversation`` (a variant) of an export: an array, or an object with a ``conversations`` array; a byte order mark is cut."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("t"))
    doc = text.select(F.parse_json("t").alias("v"))
    listed = doc.select(F.coalesce(F.try_variant_get("v", "$.conversations", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")).alias("a"))
    return listed.select(F.posexplode("a").alias("position", "conversation"))


def topic_registry(spark: SparkSession, path: str) -> DataFrame:
    """``slug, topic``: one row per entry and topic, extra topics too; entries without a slug are left out."""
    schema = "struct<assignments:map<string,struct<slug:string,topic:string,source:string,first_seen:string,extra_topics:array<string>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", "^\ufeff", ""), schema).alias("d"))
    entries = doc.select(F.explode("d.assignments").alias("key", "e"))
    topics = F.concat(F.array("e.topic"), F.coalesce("e.extra_topics", F.array().cast("array<string>")))
    return entries.select(strip(F.col("e.slug")).alias("slug"), F.explode(topics).alias("topic")).filter("slug <> '' AND topic <> ''").distinct()


def string_map(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of a JSON object of strings; names that begin with ``_`` and other values are left out."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return doc.select(F.explode("m").alias("key", "value")).filter("NOT startswith(key, '_')")


def term_lists(spark: SparkSession, path: str) -> DataFrame:
    """``name, terms`` of a JSON object of lists; names that begin with ``_``, other values and empty terms are left out."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = doc.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("key", F.try_variant_get("value", "$", "array<string>").alias("terms"))
    terms = F.filter(F.transform("terms", lambda t: F.lower(F.regexp_replace(t, f"^{SPACES}+|{SPACES}+$", ""))), lambda t: t != "")
    return rows.filter("terms IS NOT NULL AND NOT startswith(key, '_')").select(F.col("key").alias("name"), terms.alias("terms"))
