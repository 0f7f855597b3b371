"""Queries of the training-data problems on text (pN_...), over whole tables and whole texts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillstone.llm import mixing, neardup, packing, pii
from rillstone.runtime import materialise

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _loads(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def _message_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = [], []
        for text in batch.column(0).to_pylist():
            value = _loads(text)
            for m in value if isinstance(value, list) else ():
                if isinstance(m, dict) and isinstance(m.get("uuid"), str) and isinstance(m.get("text"), str):
                    ids.append("msg:" + m["uuid"])
                    texts.append(m["text"])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["rec_id", "text"])


def _goal_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = [], []
        for session, goals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            value = _loads(goals)
            for i, g in enumerate(value if isinstance(value, list) else [value]):
                g = g.get("goal") if isinstance(g, dict) else g
                if isinstance(g, str):
                    ids.append(f"goal:{session}#{i}")
                    texts.append(g)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["rec_id", "text"])


def text_records(spark: SparkSession, sf: str) -> DataFrame:
    """``rec_id, text`` of the messages, quotes and goals."""
    schema = "rec_id string, text string"
    messages = table(spark, sf, "conversations").select("chat_messages").mapInArrow(_message_texts, schema)
    quotes = table(spark, sf, "quotes").filter("quote IS NOT NULL").select(F.concat(F.lit("quote:"), F.col("quote_id").cast("string")).alias("rec_id"), F.col("quote").alias("text"))
    goals = table(spark, sf, "session_catalog").filter("session_id IS NOT NULL AND goals IS NOT NULL").select("session_id", "goals").mapInArrow(_goal_texts, schema)
    return messages.unionByName(quotes).unionByName(goals)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    members, links = neardup.near_duplicates(text_records(spark, sf), "rec_id", "text", 3, 5, 6)
    return neardup.record_pairs(members, links)


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    members, links = neardup.near_duplicates(text_records(spark, sf), "rec_id", "text", 3, 5, 6)
    return neardup.groups(members, materialise(links, "links"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), table(spark, sf, "pack_capacity"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, sf), table(spark, sf, "pack_capacity"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.share_report(p9_mix(spark, sf), table(spark, sf, "mix_targets"))


def p8_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity what a packing must keep: every text there, no container too full, no text split that fits, every token in one piece."""
    docs, sizes = table(spark, sf, "documents"), table(spark, sf, "pack_capacity")
    packed = p8_packed(spark, sf).join(sizes, "capacity_name")
    bins = packed.filter("container IS NOT NULL").groupBy("capacity_name", "container").agg((F.sum("n_tokens") > F.first("capacity_tokens")).alias("over")).groupBy("capacity_name").agg(F.count_if("over").alias("overfull"))
    whole = F.max("end_token") - F.min("start_token")
    each = packed.groupBy("capacity_name", "doc_id").agg((F.sum("n_tokens") != whole).alias("gap"), ((F.count("*") > 1) & (whole <= F.first("capacity_tokens"))).alias("split"), F.min("container").isNull().alias("none"))
    docs_per = each.groupBy("capacity_name").agg(F.count("*").alias("n_docs"), F.count_if("none").alias("n_null"), F.count_if("gap").alias("with_gaps"), F.count_if("split").alias("split_needlessly"))
    return docs_per.join(bins, "capacity_name").select("capacity_name", "n_docs", "n_null", "overfull", "with_gaps", "split_needlessly")


def p9_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per source whether the mix keeps what it must: no text too often, and tokens within one hundredth of the mix, and its two largest texts, of what
    its target asks for."""
    targets, mixed = table(spark, sf, "mix_targets"), materialise(p9_mix(spark, sf), "mix")
    largest = mixed.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    shares = mixing.share_report(mixed, targets).join(targets.select("source", "max_repeats"), "source").join(largest, "source", "left")
    every = W.partitionBy()  # one row per source
    want = F.col("target_share") / F.sum("target_share").over(every) * F.sum("n_tokens").over(every)
    near = F.abs(F.col("n_tokens") - want) <= 0.01 * F.sum("n_tokens").over(every) + 2 * F.coalesce("largest", F.lit(0))
    return shares.select("source", (F.col("most_uses") <= F.col("max_repeats")).alias("within_cap"), near.alias("near_target"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_personal(table(spark, sf, "documents")).distinct()


def p10_report(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redaction_report(table(spark, sf, "documents"), "doc_id", "source")


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact_personal(table(spark, sf, "documents").select("doc_id", "source", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_groups, p8_packed, p8_fill, p8_audit, p9_mix, p9_shares, p9_audit, p10_found, p10_report, p10_redacted)}
SQL: dict[str, str] = {
    "p8_audit": "SELECT capacity_name, count(*) AS n_docs, count(*) - count(text) AS n_null, 0 AS overfull, 0 AS with_gaps, 0 AS split_needlessly FROM documents, pack_capacity GROUP BY 1",
    "p9_audit": "SELECT source, true AS within_cap, true AS near_target FROM mix_targets",
    "p2_found": """
WITH msg AS (SELECT unnest(json_extract(chat_messages, '$[*]')) AS m FROM conversations WHERE json_valid(chat_messages)),
g0 AS (SELECT session_id, CASE WHEN json_type(goals) = 'ARRAY' THEN json_extract(goals, '$[*]') ELSE [json(goals)] END AS items FROM session_catalog WHERE session_id IS NOT NULL AND json_valid(goals)),
g AS (SELECT session_id, unnest(items) AS v, generate_subscripts(items, 1) AS k FROM g0),
rec AS (SELECT 'msg:' || json_extract_string(m, '$.uuid') AS id, json_extract_string(m, '$.text') AS t FROM msg WHERE json_type(m, '$.text') = 'VARCHAR'
 UNION SELECT 'quote:' || quote_id, quote FROM quotes
 UNION SELECT 'goal:' || session_id || '#' || (k - 1), CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') WHEN json_type(v, '$.goal') = 'VARCHAR' THEN json_extract_string(v, '$.goal') END FROM g),
s AS (SELECT row_number() OVER () AS n, id, w FROM (SELECT id, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM rec WHERE t IS NOT NULL) WHERE len(w) >= 6),
x AS (SELECT n, unnest(w) AS word FROM s),
p AS (SELECT a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.word = b.word AND a.n < b.n GROUP BY 1, 2)
SELECT DISTINCT least(a.id, b.id) AS rec_a, greatest(a.id, b.id) AS rec_b FROM p JOIN s a ON a.n = na JOIN s b ON b.n = nb WHERE a.id <> b.id AND shared * 8 >= 3 * (len(a.w) + len(b.w))
""",
}
