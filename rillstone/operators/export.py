"""Chat exports: which conversations are kept, their human prompts, one document each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.text import SPACES, blank, filled, safe_name, strip


def message_text(message: Column) -> Column:
    """The text of a message (a variant) if it is not blank, else its text blocks, one a line."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    own = F.when(kind(F.try_variant_get(message, "$.text", "variant")) == "STRING", F.try_variant_get(message, "$.text", "string"))
    blocks = F.coalesce(F.try_variant_get(message, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    usable = lambda b: (F.try_variant_get(b, "$.type", "string") == "text") & (kind(F.try_variant_get(b, "$.text", "variant")) == "STRING")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: F.coalesce(usable(b), F.lit(False))), lambda b: F.try_variant_get(b, "$.text", "string")), "\n")
    return F.when(F.coalesce(own.rlike(f"[^{SPACES[1:-1]}]"), F.lit(False)), own).otherwise(joined)


def messages(conversations: DataFrame, key: str, json_col: str) -> DataFrame:
    """``key, position, sender, text`` of all messages that are objects."""
    listed = F.coalesce(F.try_variant_get(F.try_parse_json(json_col), "$", "array<variant>"), F.array().cast("array<variant>"))
    rows = conversations.select(F.col(key), F.posexplode(listed).alias("position", "m"))
    rows = rows.filter(F.schema_of_variant("m").startswith("OBJECT"))
    return rows.select(key, "position", F.lower(strip(F.try_variant_get("m", "$.sender", "string"))).alias("sender"), strip(message_text(F.col("m"))).alias("text"))


def human_prompts(conversations: DataFrame, key: str, json_col: str) -> DataFrame:
    """``key, position, text`` of what people typed; blank texts are left out."""
    return messages(conversations, key, json_col).filter("sender = 'human' AND text <> ''").drop("sender")


def conversation_day(updated: Column, created: Column) -> Column:
    """The date the conversation was last touched, from the strict beginning of its times; null if it has none."""
    raw = F.substring(F.coalesce(filled(updated), created), 1, 10)
    return F.when(raw.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")).cast("date"))


def first_claims(rows: DataFrame, order: str) -> DataFrame:
    """``safe_uuid`` and the smallest ``order`` of the rows that have it: the conversation that claims the identifier. The order tells rows apart."""
    return rows.groupBy("safe_uuid").agg(F.min(order).alias(order))


def decide(conversations: DataFrame, order: str, json_col: str, min_date: str | None = None) -> DataFrame:
    """Adds ``safe_uuid`` and ``decision``: the first of date_unknown, before_min_date, missing_uuid, duplicate_uuid, zero_human that holds, else written.

    A conversation that reaches the identifier check claims its identifier, even if it is dropped later for want of prompts.
    """
    rows = conversations.withColumns({"safe_uuid": safe_name(F.col("uuid")), "__day": conversation_day(F.col("updated_at"), F.col("created_at"))})
    early = F.when(F.lit(min_date is not None) & F.col("__day").isNull(), "date_unknown").when(F.lit(min_date is not None) & (F.col("__day") < F.lit(min_date).cast("date")), "before_min_date").when(F.col("safe_uuid") == "", "missing_uuid")
    rows = rows.withColumn("__early", early)
    claims = first_claims(rows.filter("__early IS NULL"), order).select(order, F.lit(True).alias("__first"))
    prompts = human_prompts(conversations, order, json_col).select(order).distinct().withColumn("__human", F.lit(True))
    rows = rows.join(claims, order, "left").join(prompts, order, "left")
    decision = F.coalesce("__early", F.when(F.col("__first").isNull(), "duplicate_uuid"), F.when(F.col("__human").isNull(), "zero_human"), F.lit("written"))
    return rows.withColumn("decision", decision).drop("__day", "__early", "__first", "__human")


def documents(conversations: DataFrame, order: str, json_col: str, min_date: str | None = None) -> DataFrame:
    """``safe_uuid, document``: one Markdown text of numbered prompts per written conversation."""
    kept = decide(conversations, order, json_col, min_date).filter("decision = 'written'").select(order, "safe_uuid")
    prompts = human_prompts(conversations, order, json_col).join(kept, order)
    listed = F.array_sort(F.collect_list(F.struct("position", "text")))
    body = prompts.groupBy("safe_uuid").agg(listed.alias("p"))
    items = F.transform("p", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.replace(x["text"], F.lit("\n"), F.lit("\n   "))))
    head = F.concat(F.lit("---\nsession_id: "), "safe_uuid", F.lit("\nprompts: "), F.size("p").cast("string"), F.lit("\n---\n\n## Prompts\n\n"))
    return body.select("safe_uuid", F.concat(head, F.array_join(items, "\n"), F.lit("\n")).alias("document"))


def write_documents(docs: DataFrame, folder: str) -> DataFrame:
    """Write each document to its own file in a folder that all executors share, replacing it whole; returns ``safe_uuid, written``."""

    def write(batches):
        import os
        import uuid

        import pyarrow as pa

        for batch in batches:
            os.makedirs(folder, exist_ok=True)
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                temp = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(temp, "w", encoding="utf-8", newline="\n") as f:
                    f.write(text)
                os.replace(temp, os.path.join(folder, f"{name}-prompts.md"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([True] * batch.num_rows)], names=["safe_uuid", "written"])

    return docs.select("safe_uuid", "document").mapInArrow(write, "safe_uuid string, written boolean")
