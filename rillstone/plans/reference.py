"""Queries of the engine's own operators over whole tables, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.functions.noise import without_noise
from rillstone.operators import capture, census, export, ledger, similarity, threads
from rillstone.plans.problems import table
from rillstone.runtime import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_CUTOVER = "2026-04"
_WORDS = "list_sort(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')))"

# --- chat exports -------------------------------------------------------------------------------------------------------------------

_MESSAGES = """
WITH arr AS (SELECT row_id, chat_messages, json_array_length(chat_messages) AS n FROM conversations WHERE json_valid(chat_messages) AND json_type(chat_messages) = 'ARRAY'),
msg AS (SELECT row_id, unnest(range(n::BIGINT)) AS position, chat_messages FROM arr),
m AS (SELECT row_id, position, json_extract(chat_messages, '$[' || position || ']') AS j FROM msg),
t AS (SELECT row_id, position, lower(trim(json_extract_string(j, '$.sender'))) AS sender,
  CASE WHEN json_type(j, '$.text') = 'VARCHAR' AND regexp_matches(json_extract_string(j, '$.text'), '\\S') THEN json_extract_string(j, '$.text')
  ELSE coalesce((SELECT string_agg(json_extract_string(b.value, '$.text'), chr(10) ORDER BY b.k) FROM (
      SELECT unnest(json_extract(j, '$.content[*]')) AS value, generate_subscripts(json_extract(j, '$.content[*]'), 1) AS k) b
    WHERE json_extract_string(b.value, '$.type') = 'text' AND json_type(b.value, '$.text') = 'VARCHAR'), '') END AS text
  FROM m WHERE json_type(j) = 'OBJECT')
"""


@query(_MESSAGES + "SELECT row_id, position, trim(text, chr(10) || ' ') AS text FROM t WHERE sender = 'human' AND trim(text, chr(10) || ' ') <> ''")
def human_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = export.human_prompts(table(spark, sf, "conversations"), "row_id", "chat_messages")
    return rows.select("row_id", F.col("position").cast("bigint").alias("position"), "text")


@query(_MESSAGES + "SELECT row_id FROM conversations WHERE row_id NOT IN (SELECT row_id FROM t WHERE sender = 'human' AND trim(text, chr(10) || ' ') <> '')")
def zero_human_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return rows.select("row_id").join(export.human_prompts(rows, "row_id", "chat_messages").select("row_id").distinct(), "row_id", "left_anti")


@query()
def export_documents(spark: SparkSession, sf: str) -> DataFrame:
    return export.documents(table(spark, sf, "conversations"), "row_id", "chat_messages", "2025-10-01")


@query(
    _MESSAGES
    + """, d AS (SELECT c.row_id, regexp_replace(regexp_replace(coalesce(uuid, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS u,
   substring(coalesce(nullif(updated_at, ''), created_at), 1, 10) AS day, c.row_id IN (SELECT row_id FROM t WHERE sender = 'human' AND trim(text, chr(10) || ' ') <> '') AS human FROM conversations c),
 e AS (SELECT *, CASE WHEN NOT coalesce(regexp_full_match(day, '\\d{4}-\\d\\d-\\d\\d') AND try_cast(day AS DATE) IS NOT NULL, false) THEN 'date_unknown' WHEN day < '2025-10-01' THEN 'before_min_date' WHEN u = '' THEN 'missing_uuid' END AS early FROM d),
 r AS (SELECT *, row_number() OVER (PARTITION BY early IS NULL, u ORDER BY row_id) AS rn FROM e)
 SELECT coalesce(early, CASE WHEN rn > 1 THEN 'duplicate_uuid' WHEN NOT human THEN 'zero_human' ELSE 'written' END) AS decision, count(*) AS n FROM r GROUP BY 1"""
)
def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return export.decide(table(spark, sf, "conversations"), "row_id", "chat_messages", "2025-10-01").groupBy("decision").agg(F.count("*").alias("n"))


@query(
    """SELECT row_id, safe_uuid FROM (SELECT row_id, regexp_replace(regexp_replace(coalesce(uuid, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS safe_uuid,
       row_number() OVER (PARTITION BY regexp_replace(regexp_replace(coalesce(uuid, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') ORDER BY row_id) AS n FROM conversations) WHERE n = 1"""
)
def uuid_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("row_id", T.safe_name(F.col("uuid")).alias("safe_uuid"))
    return export.first_claims(rows, "row_id").select("row_id", "safe_uuid")


# --- capture ------------------------------------------------------------------------------------------------------------------------


@query()
def disposition_receipts(spark: SparkSession, sf: str) -> DataFrame:
    return capture.classify_lines(table(spark, sf, "occurrences"), ["occurrence_id"]).select("occurrence_id", "action", "reason", "event_class").distinct()


@query()
def disposition_by_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = capture.classify_lines(table(spark, sf, "occurrences"), ["stream_id"])
    return rows.groupBy("stream_id", "action").agg(F.count("*").alias("n"))


_ENUM = "(VALUES ('EMITTED'), ('CONTRIBUTED'), ('SUPPRESSED'), ('DROPPED'), ('REJECTED')) AS e(disposition)"


@query(f"SELECT e.disposition, count(r.receipt_id) AS n FROM {_ENUM} LEFT JOIN receipts r ON r.disposition = e.disposition GROUP BY 1")
def disposition_counters(spark: SparkSession, sf: str) -> DataFrame:
    return capture.disposition_counts(table(spark, sf, "receipts"))


@query(
    "SELECT e.event_class, count(*) FILTER (r.disposition = 'EMITTED') AS semantic_events, count(*) FILTER (r.disposition = 'EMITTED') AS emitted_events, count(*) FILTER (r.disposition IN ('EMITTED', 'CONTRIBUTED')) AS contributing_occurrences, "
    "count(*) FILTER (r.disposition = 'DROPPED') AS dropped_occurrences FROM (VALUES " + ", ".join(f"('{c}')" for c in capture.EVENT_CLASSES) + ") AS e(event_class) LEFT JOIN receipts r ON r.event_class = e.event_class GROUP BY 1"
)
def class_counters(spark: SparkSession, sf: str) -> DataFrame:
    return capture.class_counts(table(spark, sf, "receipts"))


@query("SELECT reason_code, count(*) AS n FROM receipts GROUP BY 1")
def reason_counters(spark: SparkSession, sf: str) -> DataFrame:
    return capture.reason_counts(table(spark, sf, "receipts"))


@query(
    """SELECT delivery_id, CASE WHEN n_record > 1 THEN 'DROPPED' WHEN n_event = 1 THEN 'EMITTED' ELSE 'CONTRIBUTED' END AS role FROM (SELECT delivery_id, row_number() OVER (PARTITION BY event_id ORDER BY delivery_id) AS n_event,
       row_number() OVER (PARTITION BY event_id, array_to_string(list_sort(source_record_ids), ',') ORDER BY delivery_id) AS n_record FROM owner_events WHERE event_id IS NOT NULL)"""
)
def receipt_role_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "owner_events").filter("event_id IS NOT NULL").withColumn("records", F.array_join(F.array_sort("source_record_ids"), ","))
    return capture.with_roles(rows, "event_id", "records", ["delivery_id"]).select("delivery_id", F.col("disposition").alias("role"))


@query(
    """WITH b AS (SELECT event_id, delivery_id, unnest(text_blocks) AS t, generate_subscripts(text_blocks, 1) AS k FROM owner_events WHERE event_id IS NOT NULL),
 f AS (SELECT event_id, t, min((delivery_id, k)) AS first FROM b WHERE t IS NOT NULL GROUP BY 1, 2),
 j AS (SELECT event_id, string_agg(t, chr(10) ORDER BY first) AS text FROM f GROUP BY 1)
 SELECT e.event_id, count(*) AS deliveries, min(e.delivery_id) AS first_delivery, min(e.logical_seq) AS logical_seq, coalesce(any_value(j.text), '') AS text FROM owner_events e LEFT JOIN j ON j.event_id = e.event_id WHERE e.event_id IS NOT NULL GROUP BY 1"""
)
def event_assembly(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "owner_events").filter("event_id IS NOT NULL")
    sums = rows.groupBy("event_id").agg(F.count("*").alias("deliveries"), F.min("delivery_id").alias("first_delivery"), F.min("logical_seq").alias("logical_seq"))
    return sums.join(capture.joined_blocks(rows, "event_id", "delivery_id", "text_blocks"), "event_id", "left").fillna("", ["text"])


@query("SELECT occurrence_id, printf('%s-O%06d', stream_id, line_number) AS made_id, split_part(source_locator, '#L', 1) || '#L' || line_number AS made_locator, sha256(raw_text) AS line_hash, 'RCPT-' || occurrence_id AS receipt_id FROM occurrences")
def locators_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_number")
    label = F.substring_index("source_locator", "#L", 1)
    return table(spark, sf, "occurrences").select(
        "occurrence_id", T.occurrence_id(F.col("stream_id"), n).alias("made_id"), T.locator(label, n).alias("made_locator"), F.sha2("raw_text", 256).alias("line_hash"), F.concat(F.lit("RCPT-"), "occurrence_id").alias("receipt_id")
    )


@query()
def occurrence_checks(spark: SparkSession, sf: str) -> DataFrame:
    return capture.occurrence_violations(table(spark, sf, "occurrences")).groupBy("violation").agg(F.count("*").alias("n"))


@query()
def event_checks(spark: SparkSession, sf: str) -> DataFrame:
    return capture.event_violations(table(spark, sf, "owner_events")).groupBy("violation").agg(F.count("*").alias("n"))


@query()
def receipt_checks(spark: SparkSession, sf: str) -> DataFrame:
    return capture.receipt_violations(table(spark, sf, "receipts")).groupBy("violation").agg(F.count("*").alias("n"))


@query(
    """SELECT kind, count(*) AS n FROM (
 SELECT 'line-without-receipt' AS kind FROM occurrences o WHERE NOT EXISTS (SELECT 1 FROM receipts r WHERE r.occurrence_id = o.occurrence_id)
 UNION ALL SELECT 'receipt-without-line' FROM receipts r WHERE NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.occurrence_id = r.occurrence_id)
 UNION ALL SELECT 'line-with-several-receipts' FROM (SELECT occurrence_id FROM receipts GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'event-source-without-receipt' FROM (SELECT event_id, unnest(source_occurrence_ids) AS occurrence_id FROM owner_events) u WHERE NOT EXISTS (SELECT 1 FROM receipts r WHERE r.event_id = u.event_id AND r.occurrence_id = u.occurrence_id AND r.disposition IN ('EMITTED', 'CONTRIBUTED'))
 UNION ALL SELECT 'receipt-without-event-source' FROM receipts r WHERE r.disposition IN ('EMITTED', 'CONTRIBUTED') AND NOT EXISTS (SELECT 1 FROM (SELECT event_id, unnest(source_occurrence_ids) AS occurrence_id FROM owner_events) u WHERE r.event_id = u.event_id AND r.occurrence_id = u.occurrence_id)
 ) GROUP BY 1"""
)
def packet_integrity(spark: SparkSession, sf: str) -> DataFrame:
    bad = capture.packet_violations(table(spark, sf, "occurrences"), table(spark, sf, "owner_events"), table(spark, sf, "receipts"))
    return bad.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT delivery_id, timestamp AS t, regexp_extract(timestamp, '^(\\d{4}-\\d\\d-\\d\\d)[Tt](\\d\\d:\\d\\d:[0-5]\\d)(\\.\\d+)?([Zz]|[+-]\\d\\d:\\d\\d)$', ['d', 'c', 'f', 'z']) AS g FROM owner_events),
 q AS (SELECT delivery_id, try_strptime(g.d || ' ' || g.c, '%Y-%m-%d %H:%M:%S') AS local, g.f AS f, CASE WHEN lower(g.z) = 'z' THEN 0 WHEN substr(g.z, 2, 2) <= '23' AND substr(g.z, 5, 2) <= '59' THEN (CASE WHEN g.z[1] = '-' THEN -1 ELSE 1 END) * (try_cast(substr(g.z, 2, 2) AS INT) * 60 + try_cast(substr(g.z, 5, 2) AS INT)) END AS off FROM p WHERE g.d <> '')
 SELECT delivery_id, strftime(local - to_minutes(off), '%Y-%m-%dT%H:%M:%S') || regexp_replace(f, '\\.?0*$', '') || 'Z' AS canonical FROM q WHERE local IS NOT NULL AND off IS NOT NULL"""
)
def canonical_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "owner_events").select("delivery_id", T.canonical_timestamp(F.col("timestamp")).alias("canonical")).filter("canonical IS NOT NULL")


# --- text ---------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT token, count(*) AS df FROM (SELECT unnest({_WORDS.format('text')}) AS token FROM documents) GROUP BY 1")
def tokens_docfreq(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


_PLACES = T.PLACE
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '{_PLACES}', ' ', 'g'), '[a-z]+'), ' ') AS normalized FROM documents")
def normalized_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_prompt(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '{_PLACES}', ' ', 'g'), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)), ' ') AS topics FROM documents")
def topic_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_topic(F.col("text")).alias("topics"))


_FLAT = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, replace(CASE WHEN length({_FLAT.format('text')}) > 80 THEN substring({_FLAT.format('text')}, 1, 79) || '…' ELSE {_FLAT.format('text')} END, '|', '\\|') AS cell FROM documents")
def markdown_cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.cell(F.col("text"), 80).alias("cell"))


@query()
def strip_noise(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", without_noise(F.col("text")).alias("typed"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower({_FLAT.format('text')}) ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def echo_collapse(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").filter("text IS NOT NULL")
    items = rows.select(F.format_string("%020d", "doc_id").alias("date"), F.lit("").alias("session_id"), F.lit("").alias("lane"), "text", "doc_id")
    return ledger.collapse_echo(items).select("doc_id")


@query(
    f"""WITH c AS (SELECT DISTINCT slug, project, outcome_summary, date, {_WORDS.format("outcome_summary || ' ' || coalesce(project, '')")} AS t FROM session_catalog WHERE outcome_summary IS NOT NULL AND slug IS NOT NULL),
 s AS (SELECT slug, outcome_summary AS goal, project AS topic, len(list_intersect(t, ['atlas', 'handoff', 'registry', 'storage'])) / 4.0::DOUBLE AS score, coalesce(epoch(try_cast(date AS TIMESTAMP)), '-infinity'::DOUBLE) AS at_ FROM c)
 SELECT slug, goal, topic, score FROM s WHERE score > 0 ORDER BY score DESC, at_ DESC, lower(goal), slug LIMIT 50"""
)
def query_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "session_catalog").filter("outcome_summary IS NOT NULL AND slug IS NOT NULL")
    rows = rows.select("slug", F.col("outcome_summary").alias("goal"), F.col("project").alias("topic"), F.col("date").alias("last_touched")).distinct()
    return threads.search(rows, "Registry, storage: handoff (Atlas)", 50).select("slug", "goal", "topic", "score")


# --- threads ------------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT session_id, slug, CASE WHEN NOT json_valid(open_threads) OR open_threads IS NULL THEN 0 WHEN json_type(open_threads) = 'ARRAY' THEN json_array_length(open_threads)::BIGINT WHEN json_type(open_threads) = 'BOOLEAN' THEN (open_threads = 'true')::BIGINT
 WHEN json_type(open_threads) = 'VARCHAR' THEN greatest(0, coalesce(CASE WHEN regexp_full_match(trim(json_extract_string(open_threads, '$')), '[+-]?\\d+') THEN try_cast(trim(json_extract_string(open_threads, '$')) AS BIGINT) END, 0))
 WHEN json_type(open_threads) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN greatest(0, trunc(try_cast(open_threads AS DOUBLE))::BIGINT) ELSE 0 END AS open_count FROM session_catalog"""
)
def open_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "session_catalog").select("session_id", "slug", threads.open_count(F.col("open_threads")).alias("open_count"))


_GOALS = """
WITH c AS (SELECT row_number() OVER () AS n, * FROM (SELECT DISTINCT slug, session_id, date, goals, open_threads, open_text, status_claimed FROM session_catalog WHERE trim(coalesce(slug, '')) <> '')),
g0 AS (SELECT n, slug, session_id, date, CASE WHEN json_type(goals) = 'VARCHAR' THEN [json(goals)] WHEN json_type(goals) = 'ARRAY' THEN json_extract(goals, '$[*]') END AS items FROM c WHERE json_valid(goals)),
g1 AS (SELECT n, slug, session_id, date, unnest(items) AS v FROM g0),
g2 AS (SELECT n, slug, session_id, date, trim(coalesce(CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE json_extract_string(v, '$.goal') END, '')) AS goal,
  coalesce(nullif(trim(regexp_replace(lower(coalesce(CASE WHEN json_type(v) = 'OBJECT' THEN json_extract_string(v, '$.verdict') END, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS verdict FROM g1),
goal AS (SELECT * FROM g2 WHERE goal <> ''),
claim AS (SELECT slug, session_id, date, substring(trim(status_claimed, chr(32) || chr(9) || chr(10)), 1, 160) AS goal FROM c WHERE trim(coalesce(status_claimed, ''), chr(32) || chr(9) || chr(10)) <> '' AND n NOT IN (SELECT n FROM goal)),
said AS (SELECT slug, session_id, date, goal, 'claimed-' || verdict || '@' || slug AS status, CASE WHEN verdict = 'met' THEN 'met' ELSE 'unknown' END AS state FROM goal
 UNION ALL SELECT slug, session_id, date, goal, 'claimed-unknown@' || slug, 'unknown' FROM claim)
"""


@query(_GOALS + "SELECT slug, session_id, date, goal, status, state FROM said")
def goal_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return threads.thread_rows(table(spark, sf, "session_catalog")).filter("state <> 'open'").select("slug", "session_id", "date", "goal", "status", "state")


_OPEN_COUNT = SQL["open_counts"].partition("slug, ")[2].partition(" AS open_count")[0]
_LEDGER = (
    _GOALS
    + f""", o0 AS (SELECT slug, session_id, date, trim(coalesce(open_text, ''), chr(32) || chr(9) || chr(10)) AS said_open, {_OPEN_COUNT} AS k FROM c),
 t AS (SELECT * FROM said UNION ALL SELECT slug, session_id, date, coalesce(nullif(substring(said_open, 1, 160), ''), 'Open threads: ' || k), 'open-threads@' || slug, 'open' FROM o0 WHERE k > 0),
 w AS (SELECT DISTINCT state, goal, slug, status, {_WORDS.format('goal')} AS tk FROM t WHERE state IN ('met', 'open')),
 x AS (SELECT m.goal AS mg, m.slug AS ms, m.status AS mst, p.goal AS og, p.slug AS os, p.status AS ost FROM w m JOIN w p ON m.state = 'met' AND p.state = 'open' AND m.slug <> p.slug AND len(m.tk) > 0 AND len(p.tk) > 0 AND len(list_intersect(m.tk, p.tk)) * 5 >= 3 * least(len(m.tk), len(p.tk))),
 sides AS (SELECT 'met' AS state, mg AS goal, ms AS slug, mst AS status, ost AS other FROM x UNION SELECT 'open', og, os, ost, mst FROM x),
 a AS (SELECT state, goal, slug, status, list_sort(list_distinct(list_append(list(other), status))) AS src FROM sides GROUP BY state, goal, slug, status),
 topics AS (SELECT DISTINCT slug, project AS topic FROM session_catalog WHERE project <> '')
"""
)


@query(
    _LEDGER
    + """ SELECT coalesce(p.topic, 'untagged') AS topic, t.slug, t.goal, CASE WHEN a.src IS NULL THEN t.status ELSE 'conflict' END AS status, CASE WHEN a.src IS NULL THEN t.state ELSE 'conflict' END AS state, array_to_string(coalesce(a.src, [t.status]), '; ') AS sources, t.date AS last_touched
 FROM t LEFT JOIN topics p ON p.slug = t.slug LEFT JOIN a ON a.state = t.state AND a.goal = t.goal AND a.slug = t.slug AND a.status = t.status"""
)
def thread_ledger(spark: SparkSession, sf: str) -> DataFrame:
    catalog = table(spark, sf, "session_catalog")
    topics = catalog.select("slug", F.col("project").alias("topic")).filter("topic <> ''").distinct()
    rows = threads.with_conflicts(threads.with_topics(threads.thread_rows(catalog), topics))
    return rows.select("topic", "slug", "goal", "status", "state", F.array_join("status_sources", "; ").alias("sources"), F.col("date").alias("last_touched"))


@query(
    _GOALS
    + f""", met AS (SELECT DISTINCT goal AS a, {_WORDS.format('goal')} AS ta FROM said WHERE state = 'met'), o AS (SELECT DISTINCT goal AS b, {_WORDS.format('goal')} AS tb FROM said WHERE state <> 'met')
 SELECT a, b FROM met, o WHERE len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb)) * 5 >= 3 * least(len(ta), len(tb))"""
)
def conflict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = threads.thread_rows(table(spark, sf, "session_catalog")).filter("state <> 'open'").select(F.expr("state = 'met'").alias("met"), F.col("goal").alias("item_id")).distinct()
    items = materialise(rows, "goals").withColumn("tokens", T.tokens(F.col("item_id")))
    met, other = items.filter("met").select("item_id", "tokens"), items.filter("NOT met").select("item_id", "tokens")
    return similarity.overlap_pairs(met, other, 3, 5)


@query("SELECT coalesce(nullif(entry_source, ''), 'UNKNOWN') AS source, count(*) AS n FROM session_catalog GROUP BY 1")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return threads.source_counts(table(spark, sf, "session_catalog"))


@query(f"SELECT d.doc_id, coalesce(t.topic, 'untagged') AS topic FROM documents d LEFT JOIN (SELECT DISTINCT session_id, project AS topic FROM session_catalog WHERE project <> '' AND session_id IS NOT NULL) t ON t.session_id = d.session_id")
def membership_untagged(spark: SparkSession, sf: str) -> DataFrame:
    topics = table(spark, sf, "session_catalog").select(F.col("session_id").alias("slug"), F.col("project").alias("topic")).filter("topic <> '' AND slug IS NOT NULL")
    return threads.with_topics(table(spark, sf, "documents").select("doc_id", F.col("session_id").alias("slug")), topics).select("doc_id", "topic")


@query(
    """WITH p AS (SELECT session_id AS k, min(source_path) AS path FROM quotes WHERE session_id IS NOT NULL GROUP BY 1)
 SELECT DISTINCT c.session_id, c.slug, coalesce(a.path, b.path) AS prompt_path FROM session_catalog c LEFT JOIN p a ON a.k = c.session_id LEFT JOIN p b ON b.k = c.slug"""
)
def fallback_key_join(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "quotes").filter("session_id IS NOT NULL").select(F.col("session_id").alias("session_key"), F.col("source_path").alias("path"))
    return threads.prompt_paths(table(spark, sf, "session_catalog").select("session_id", "slug"), keys).select("session_id", "slug", "prompt_path").distinct()


@query(
    "SELECT session_id, slug, array_to_string(list_filter([CASE WHEN trim(coalesce(handoff_path, '')) <> '' THEN 'handoff=' || trim(handoff_path) END, CASE WHEN trim(coalesce(transcript_md_path, '')) <> '' THEN 'transcript=' || trim(transcript_md_path) END, "
    "CASE WHEN trim(coalesce(raw_jsonl_path, '')) <> '' THEN 'jsonl=' || trim(raw_jsonl_path) END], lambda x: x IS NOT NULL), '; ') AS pointers FROM session_catalog"
)
def pointer_lists(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    pointers = threads.pointer_list(c("handoff_path"), c("transcript_md_path"), c("raw_jsonl_path"), F.lit(None).cast("string"))
    return table(spark, sf, "session_catalog").select("session_id", "slug", F.array_join(pointers, "; ").alias("pointers"))


# --- similarity ---------------------------------------------------------------------------------------------------------------------

_ITEMS = f"WITH i AS (SELECT quote_id AS item_id, session_id, {_WORDS.format('quote')} AS t FROM quotes WHERE quote IS NOT NULL GROUP BY ALL)"
_PAIRS = _ITEMS + ", p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) AS s, len(a.t) AS na, len(b.t) AS nb FROM i a JOIN i b ON a.item_id < b.item_id)"


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "quotes").filter("quote IS NOT NULL").select(F.col("quote_id").alias("item_id"), "session_id", "quote").distinct()
    return rows.withColumn("tokens", T.tokens(F.col("quote")))


@query(_PAIRS + " SELECT a, b, s::INT AS shared FROM p WHERE s > 0 AND s * 20 >= 11 * (na + nb - s)")
def similar_pairs_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.jaccard_pairs(_quotes(spark, sf), 11, 20).select("a", "b", "shared")


@query(_PAIRS + " SELECT a, b, s::INT AS shared FROM p WHERE s >= 5 AND s * 5 >= 4 * least(na, nb)")
def similar_pairs_containment(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.containment_pairs(_quotes(spark, sf), 4, 5, 5).select("a", "b", "shared")


_CC = (
    _PAIRS.replace("WITH i", "WITH RECURSIVE i")
    + """, e AS (SELECT a, b FROM p WHERE s >= 5 AND s * 5 >= 4 * least(na, nb)), e2 AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT item_id AS x, item_id AS y FROM i UNION SELECT r.x, e2.y FROM reach r JOIN e2 ON e2.x = r.y), cc AS (SELECT x AS item_id, min(y) AS cluster_id FROM reach GROUP BY 1)"""
)


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    items = _quotes(spark, sf)
    clusters = similarity.connected(items.select("item_id").distinct(), similarity.containment_pairs(items, 4, 5, 5))
    return items.withColumn("normalized", F.array_join("tokens", " ")).join(clusters, "item_id")


@query(_CC + " SELECT item_id, cluster_id FROM cc")
def clusters_cc(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf).select("item_id", "cluster_id").distinct()


@query(
    _PAIRS.replace("WITH i", "WITH RECURSIVE i")
    + """, e AS (SELECT b AS x, a AS y FROM p WHERE s > 0 AND s * 20 >= 11 * (na + nb - s)), reach AS (SELECT item_id AS x, item_id AS y FROM i UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y) SELECT x AS item_id, min(y) AS cluster_id FROM reach GROUP BY 1"""
)
def clusters_greedy(spark: SparkSession, sf: str) -> DataFrame:
    items = _quotes(spark, sf)
    return similarity.greedy(items.select("item_id").distinct(), similarity.jaccard_pairs(items, 11, 20))


_SIGNED = (
    _CC
    + """, m AS (SELECT cc.cluster_id, i.* FROM cc JOIN i ON i.item_id = cc.item_id), n AS (SELECT cluster_id, count(*) AS n, min((length(array_to_string(t, ' ')), array_to_string(t, ' ')))[2] AS shortest FROM m GROUP BY 1),
 k AS (SELECT cluster_id, w, count(*) AS k FROM (SELECT cluster_id, unnest(t) AS w FROM m) GROUP BY 1, 2),
 s AS (SELECT n.cluster_id, coalesce(string_agg(k.w, ' ' ORDER BY k.w) FILTER (k.k >= greatest(1, (n.n + 1) // 2)), any_value(n.shortest)) AS signature FROM n LEFT JOIN k ON k.cluster_id = n.cluster_id GROUP BY 1)"""
)


@query(_SIGNED + " SELECT cluster_id, signature, substring(sha1(signature), 1, 10) AS key FROM s")
def cluster_signature(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.signatures(_clusters(spark, sf)).withColumn("key", F.substring(F.sha1("signature"), 1, 10))


@query(_SIGNED + ", r AS (SELECT cluster_id, count(*) AS size, count(DISTINCT session_id) AS sessions, sum(len(t))::DOUBLE AS score FROM m GROUP BY 1) SELECT r.*, s.signature FROM r JOIN s ON s.cluster_id = r.cluster_id WHERE size >= 2")
def cluster_report(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.cluster_report(_clusters(spark, sf), 2)


# --- recurrence ledger --------------------------------------------------------------------------------------------------------------


def _lanes(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.close_items(table(spark, sf, "session_catalog")).unionByName(ledger.quote_items(table(spark, sf, "quotes").dropDuplicates()))


@query()
def lane_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _lanes(spark, sf).groupBy("lane").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


@query()
def recurrence_ledger(spark: SparkSession, sf: str) -> DataFrame:
    members = ledger.cluster_items(_lanes(spark, sf).filter("lane <> 'close-outcome'"))
    rows = materialise(ledger.summarise(members, _CUTOVER, 2), "ledger")
    kept = materialise(members.select("cluster_id", "item_id", "normalized", "tokens").join(rows.select("cluster_id"), "cluster_id", "left_semi"), "kept")
    return rows.join(ledger.keys_and_labels(kept, corpus=members), "cluster_id").withColumn("lanes", F.array_join("lanes", ", "))


_EVIDENCE = """WITH g AS (SELECT DISTINCT project AS k, session_id, date AS d, handoff_path AS h, slug, coalesce(had_incident, false) AS met FROM session_catalog WHERE project <> ''),
 f AS (SELECT k, min(d) FILTER (met AND d <> '') AS first_met, max(d) FILTER (met AND d <> '') AS last_met FROM g GROUP BY 1),
 s AS (SELECT g.k, count(*) AS records, count(DISTINCT nullif(d, '')) AS days, count(DISTINCT nullif(session_id, '')) AS sessions, min(nullif(d, '')) AS first_seen, max(nullif(d, '')) AS last_seen, any_value(first_met) AS first_met, any_value(last_met) AS last_met,
   count(*) FILTER (d <> '' AND d > first_met) AS later, coalesce(arg_min(h, (coalesce(d, ''), coalesce(session_id, ''), coalesce(slug, ''))) FILTER (h <> ''), '') AS root_caused FROM g JOIN f ON f.k = g.k GROUP BY 1)
"""


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The sessions of each project as the members of one cluster; those with an incident count as met."""
    rows = table(spark, sf, "session_catalog").filter("project <> ''").select("project", "session_id", "date", "handoff_path", "slug", F.coalesce("had_incident", F.lit(False)).alias("met")).distinct()
    given = {"session_id": F.col("session_id"), "date": F.col("date"), "handoff": F.col("handoff_path"), "text": F.col("slug"), "lane": F.lit("close-goal"), "verdict": F.when(F.col("met"), "met")}
    return rows.select(F.col("project").alias("cluster_id"), *[F.coalesce(given[c], F.lit("")).alias(c) if c in given else F.lit("").alias(c) for c in ledger.ITEM_COLUMNS])


@query(
    _EVIDENCE
    + """SELECT k AS project, CASE WHEN sessions > 0 THEN sessions ELSE records END AS times_seen, records, days, days <= 1 AS single_day, first_seen, last_seen, 'close-row' AS grade,
 CASE WHEN first_met IS NULL THEN 'not met' WHEN later > 0 THEN 'met ' || first_met || ', recurred ' || later || 'x after' ELSE 'met ' || last_met || ', no recurrence since' END AS fix, CASE WHEN first_met IS NOT NULL AND later = 0 THEN 'no' ELSE 'yes' END AS still_open FROM s WHERE sessions >= 2"""
)
def project_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    out = ledger.summarise(_evidence(spark, sf), _CUTOVER, 2)
    return out.select(F.col("cluster_id").alias("project"), "times_seen", "records", "days", "single_day", "first_seen", "last_seen", "grade", "fix", "still_open")


@query(_EVIDENCE + f"SELECT k AS project, first_seen, last_seen, coalesce(substring(first_seen, 1, 7) < '{_CUTOVER}' AND substring(last_seen, 1, 7) >= '{_CUTOVER}', false) AS spans_eras FROM s")
def era_span(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.summarise(_evidence(spark, sf), _CUTOVER).select(F.col("cluster_id").alias("project"), "first_seen", "last_seen", "spans_eras")


@query(
    """SELECT source AS cluster_id, rn AS nth, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY session_id, printf('%020d', doc_id)) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE session_id IS NOT NULL) WHERE n <= 3 OR rn IN (1, n // 2 + 1, n)"""
)
def exemplars(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").filter("session_id IS NOT NULL").select(F.col("source").alias("cluster_id"), F.col("session_id").alias("date"), F.format_string("%020d", "doc_id").alias("text"), F.col("doc_id").alias("item_id"))
    return ledger.exemplars(rows).select("cluster_id", F.col("nth").cast("bigint").alias("nth"), F.col("text").cast("bigint").alias("doc_id"))


@query(_EVIDENCE + "SELECT k AS project, root_caused AS root_cause FROM s WHERE root_caused <> ''")
def first_root_cause(spark: SparkSession, sf: str) -> DataFrame:
    out = ledger.summarise(_evidence(spark, sf), _CUTOVER)
    return out.filter("root_caused <> ''").select(F.col("cluster_id").alias("project"), F.col("root_caused").alias("root_cause"))


@query(
    """SELECT q.quote_id FROM (SELECT DISTINCT quote_id, session_id, quote FROM quotes WHERE session_id IS NOT NULL AND quote IS NOT NULL) q
 WHERE NOT EXISTS (SELECT 1 FROM owner_events e WHERE e.session_id = q.session_id AND list_contains(e.text_blocks, q.quote)) AND NOT EXISTS (SELECT 1 FROM session_catalog c WHERE c.session_id = q.session_id AND c.outcome_summary = q.quote)"""
)
def exact_precedence(spark: SparkSession, sf: str) -> DataFrame:
    quotes = table(spark, sf, "quotes").filter("session_id IS NOT NULL AND quote IS NOT NULL").select("quote_id", "session_id", F.col("quote").alias("text")).distinct()
    events = table(spark, sf, "owner_events").select("session_id", F.explode("text_blocks").alias("text"))
    close = table(spark, sf, "session_catalog").select("session_id", F.col("outcome_summary").alias("text"))
    return ledger.supersede(ledger.supersede(quotes, close), events).select("quote_id")


@query(
    """SELECT s.name, count(c.session_id) AS hits, count(DISTINCT c.session_id) AS sessions FROM (VALUES ('adapters', 'adapter', 'parser'), ('storage', 'archive', 'bucket'), ('nothing', 'quantum', 'banana')) AS s(name, t1, t2)
 LEFT JOIN session_catalog c ON c.session_id IS NOT NULL AND (contains(lower(c.outcome_summary), s.t1) OR contains(lower(c.outcome_summary), s.t2)) GROUP BY 1"""
)
def seeded_threads(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("adapters", ["adapter", "parser"]), ("storage", ["archive", "bucket"]), ("nothing", ["quantum", "banana"])], "name string, terms array<string>")
    rows = table(spark, sf, "session_catalog").filter("session_id IS NOT NULL").select("session_id", F.col("outcome_summary").alias("text"), F.lit("close-outcome").alias("lane"), F.lit("").alias("date"))
    return ledger.seeded_threads(rows, seeds).select("name", "hits", "sessions")


_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_MONTHS = ["2026-03", "2026-04", "2026-05", "2026-06"]


@query(
    f"""WITH c AS (SELECT nullif(regexp_extract(lower(session_id), '{_UUID}'), '') AS s FROM session_catalog WHERE substring(date, 1, 7) IN ('2026-03', '2026-04', '2026-05', '2026-06')), r AS (SELECT DISTINCT s FROM c WHERE s IS NOT NULL),
 d AS (SELECT DISTINCT lower(session_id) AS s FROM documents WHERE session_id <> '')
 SELECT (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM r) AS real, (SELECT count(*) FROM d WHERE s IN (SELECT s FROM r)) AS joined, (SELECT count(*) FROM d WHERE s NOT IN (SELECT s FROM r)) AS unlisted"""
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("logs/"), F.coalesce("project", F.lit("none")), F.lit("/"), "session_id", F.lit(".jsonl"))
    catalog = table(spark, sf, "session_catalog").select("date", path.alias("raw_jsonl_path"), F.lit("").alias("transcript_md_path"))
    return ledger.coverage_numbers(table(spark, sf, "documents").select("session_id"), catalog, _MONTHS).select("total", "real", "joined", "unlisted")


@query(
    """SELECT 'both' AS side, session_id FROM (SELECT session_id FROM owner_events INTERSECT SELECT session_id FROM documents) WHERE session_id IS NOT NULL UNION ALL SELECT 'events', session_id FROM (SELECT session_id FROM owner_events EXCEPT SELECT session_id FROM documents) WHERE session_id IS NOT NULL"""
)
def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    e, d = (table(spark, sf, t).select("session_id").filter("session_id IS NOT NULL") for t in ("owner_events", "documents"))
    return e.intersect(d).select(F.lit("both").alias("side"), "session_id").unionByName(e.subtract(d).select(F.lit("events").alias("side"), "session_id"))


@query("SELECT 'document' AS lane, session_id, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'quote', session_id, count(*) FROM quotes GROUP BY 2 UNION ALL SELECT 'event', session_id, count(*) FROM owner_events GROUP BY 2")
def lane_union(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).select(F.lit(lane).alias("lane"), "session_id") for lane, t in (("document", "documents"), ("quote", "quotes"), ("event", "owner_events"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lane", "session_id").agg(F.count("*").alias("n"))


@query(
    """WITH f0 AS (SELECT DISTINCT session_id, date, slug, handoff_path, project, outcome_summary, goals, friction FROM session_catalog WHERE entry_source = 'close' AND json_valid(friction)),
 f AS (SELECT unnest(json_extract(friction, '$[*]')) AS v FROM f0 WHERE json_type(friction) = 'ARRAY'),
 refs AS (SELECT DISTINCT json_extract_string(v, '$.ref') AS ref FROM f WHERE json_type(v) = 'OBJECT' AND trim(coalesce(json_extract_string(v, '$.what'), '')) <> '' AND json_extract_string(v, '$.ref') <> ''),
 n0 AS (SELECT replace(regexp_extract(text, '(?m)^title: (.*)$', 1), ' ', '_') AS stem, doc_id, text FROM documents WHERE source = 'memory' AND text IS NOT NULL),
 notes AS (SELECT stem, arg_min(text, doc_id) AS text, array_to_string(list_sort(regexp_split_to_array(lower(stem), '[_\\-.]+')), '|') AS bag FROM n0 WHERE stem <> '' GROUP BY 1),
 r AS (SELECT ref, regexp_replace(ref, '\\.md$', '') AS key, array_to_string(list_sort(regexp_split_to_array(lower(regexp_replace(ref, '\\.md$', '')), '[_\\-.]+')), '|') AS bag FROM refs)
 SELECT CASE WHEN e.stem IS NOT NULL THEN CASE WHEN regexp_matches(substring(e.text, 1, 3000), '(?i)superseded') THEN '[S]' ELSE '' END WHEN EXISTS (SELECT 1 FROM notes k WHERE k.bag = r.bag) THEN '[!]' ELSE '[?]' END AS mark, count(*) AS n FROM r LEFT JOIN notes e ON e.stem = r.key GROUP BY 1"""
)
def citation_marks(spark: SparkSession, sf: str) -> DataFrame:
    catalog = table(spark, sf, "session_catalog")
    refs = ledger.close_items(catalog).filter("lane = 'close-friction' AND ref <> ''").select("ref")
    notes = table(spark, sf, "documents").filter("source = 'memory' AND text IS NOT NULL").select(F.regexp_replace(F.regexp_extract("text", r"(?m)^title: (.*)$", 1), " ", "_").alias("stem"), "doc_id", "text")
    notes = notes.filter("stem <> ''").groupBy("stem").agg(F.min_by("text", "doc_id").alias("text"))
    return ledger.citations(refs, notes).groupBy("mark").agg(F.count("*").alias("n"))


# --- census -------------------------------------------------------------------------------------------------------------------------

_RULES = [("captures", "keep-in-place", "", 2), ("captures/desk-main", "archive", "dest=a", 3), ("captures/lab-slate/000001.jsonl", "gated", "", 4), ("captures/relay-north", "move", "dest=b", 5), ("captures/relay-north", "junk-disposal", "", 6)]
_RULE_SQL = "(VALUES " + ", ".join(f"('{p}', '{d}', '{r}', {n})" for p, d, r, n in _RULES) + ") AS r(pattern, disposition, reason, n)"
_PATHS_SQL = "(SELECT DISTINCT split_part(source_locator, '#L', 1) AS path FROM occurrences UNION SELECT DISTINCT source_path FROM quotes WHERE source_path IS NOT NULL)"


def _census(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "occurrences").select(F.substring_index("source_locator", "#L", 1).alias("path")).union(table(spark, sf, "quotes").filter("source_path IS NOT NULL").select("source_path")).distinct()
    rules, _ = census.load_rules(spark.createDataFrame(_RULES, "pattern string, disposition string, reason string, line_no int"))
    return census.apply_rules(paths.withColumn("type", F.lit("file")), rules)


_DECIDED = f"(SELECT p.path, arg_max(r.disposition, (CASE WHEN p.path = r.pattern THEN 1 ELSE 0 END, length(r.pattern), r.n)) AS disposition FROM {_PATHS_SQL} p LEFT JOIN {_RULE_SQL} ON p.path = r.pattern OR starts_with(p.path, r.pattern || '/') GROUP BY 1)"


@query(f"SELECT path, coalesce(disposition, '') AS disposition FROM {_DECIDED}")
def prefix_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _census(spark, sf).select("path", "disposition")


@query(f"SELECT path FROM {_DECIDED} WHERE disposition IS NULL")
def completeness_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _census(spark, sf).filter("disposition = ''").select("path")


@query(
    f"SELECT split_part(path, '/', 1) AS top_level, " + ", ".join(f"count(*) FILTER (disposition = '{d}') AS \"{d}\"" for d in census.DISPOSITIONS) + f", count(*) FILTER (disposition IS NULL) AS \"UNASSIGNED\" FROM {_DECIDED} GROUP BY 1"
)
def census_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return census.crosstab(_census(spark, sf).withColumn("top_level", T.top_level(F.col("path"))))


@query(
    """WITH a AS (SELECT stream_id, count(DISTINCT occurrence_id) AS n_lines FROM occurrences GROUP BY 1), b AS (SELECT regexp_extract(source_locator, '^captures/([^/]+)/', 1) AS stream_id, count(DISTINCT occurrence_id) AS n_receipts FROM receipts GROUP BY 1)
 SELECT coalesce(a.stream_id, b.stream_id) AS stream_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_receipts, 0) AS n_receipts FROM a FULL JOIN b ON a.stream_id = b.stream_id WHERE coalesce(n_lines, 0) <> coalesce(n_receipts, 0)"""
)
def count_crosscheck(spark: SparkSession, sf: str) -> DataFrame:
    paths = lambda name, stream: table(spark, sf, name).filter("occurrence_id IS NOT NULL").select(F.concat(stream, F.lit("/"), "occurrence_id").alias("path")).distinct()
    named = F.regexp_extract("source_locator", "^captures/([^/]+)/", 1)
    off = census.count_mismatches(paths("occurrences", F.col("stream_id")), paths("receipts", named).filter("path IS NOT NULL"))
    return off.select(F.col("top_level").alias("stream_id"), F.col("n_a").alias("n_lines"), F.col("n_b").alias("n_receipts"))
