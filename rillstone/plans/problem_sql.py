"""SQL that the problem queries are checked against."""

from __future__ import annotations

_FOLD = "lower(trim({0}, chr(32) || chr(9) || chr(10) || chr(13)))"

P3_FOUND = f"""
WITH t AS (SELECT 'line' AS kind, {_FOLD.format('occurrence_id')} AS k, ingested_at AS a, deleted_at AS d FROM occurrences UNION ALL SELECT 'event', {_FOLD.format('event_id')}, delivered_at, NULL FROM owner_events),
r AS (SELECT 'owner_events' AS src_table, delivery_id::VARCHAR AS src_key, 'source_occurrence_ids' AS src_field, unnest(source_occurrence_ids) AS ref_key, delivered_at AS at, 'line' AS kind FROM owner_events
 UNION ALL SELECT 'receipts', receipt_id, 'occurrence_id', occurrence_id, ingested_at, 'line' FROM receipts
 UNION ALL SELECT 'receipts', receipt_id, 'event_id', event_id, ingested_at, 'event' FROM receipts WHERE disposition IN ('EMITTED', 'CONTRIBUTED', 'DROPPED'))
SELECT DISTINCT src_table, src_key, src_field, ref_key FROM r WHERE ref_key IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM t WHERE t.kind = r.kind AND t.k = {_FOLD.format('r.ref_key')} AND t.a <= r.at AND (t.d IS NULL OR t.d > r.at))
"""

P3_REPORT = f"""
WITH RECURSIVE t AS (SELECT 'occurrences' AS kind, {_FOLD.format('occurrence_id')} AS k, ingested_at AS a, deleted_at AS d FROM occurrences UNION ALL SELECT 'owner_events', {_FOLD.format('event_id')}, delivered_at, NULL FROM owner_events),
r AS (SELECT DISTINCT * FROM (SELECT 'owner_events' AS src_table, delivery_id::VARCHAR AS src_key, 'source_occurrence_ids' AS src_field, unnest(source_occurrence_ids) AS ref_key, delivered_at AS wrote, 'occurrences' AS kind, {_FOLD.format('event_id')} AS own FROM owner_events
 UNION ALL SELECT 'receipts', receipt_id, 'occurrence_id', occurrence_id, ingested_at, 'occurrences', NULL FROM receipts
 UNION ALL SELECT 'receipts', receipt_id, 'event_id', event_id, ingested_at, 'owner_events', NULL FROM receipts WHERE disposition IN ('EMITTED', 'CONTRIBUTED', 'DROPPED')) WHERE ref_key IS NOT NULL),
direct AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.kind = r.kind AND t.k = {_FOLD.format('r.ref_key')} AND t.a <= r.wrote AND (t.d IS NULL OR t.d > r.wrote))),
o AS (SELECT src_table, src_key, src_field, ref_key, wrote, own, 'direct' AS orphaned FROM direct
 UNION SELECT r.src_table, r.src_key, r.src_field, r.ref_key, r.wrote, r.own, 'inherited' FROM r JOIN o ON r.kind = o.src_table AND {_FOLD.format('r.ref_key')} = o.own
  WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.src_table = r.src_table AND d.src_key = r.src_key AND d.src_field = r.src_field AND d.ref_key = r.ref_key))
SELECT src_table, src_field, strftime(date_trunc('month', wrote), '%Y-%m-%d') AS period, orphaned, count(*) AS n_refs, count(DISTINCT src_key) AS n_rows FROM (SELECT DISTINCT src_table, src_key, src_field, ref_key, wrote, own, orphaned FROM o) GROUP BY ALL
"""

P4_FOUND = """
WITH RECURSIVE msg AS (SELECT unnest(json_extract(chat_messages, '$[*]')) AS m FROM conversations WHERE json_valid(chat_messages)),
root AS (SELECT json_extract_string(m, '$.uuid') AS parent_key, json_extract(m, '$.content') AS arr FROM msg),
b AS (SELECT parent_key, v AS block, (k - 1)::VARCHAR AS path FROM (SELECT parent_key, unnest(json_extract(arr, '$[*]')) AS v, generate_subscripts(json_extract(arr, '$[*]'), 1) AS k FROM root WHERE json_type(arr) = 'ARRAY')
 UNION ALL SELECT parent_key, v, path || '.' || (k - 1) FROM (SELECT parent_key, path, unnest(json_extract(block, '$.content[*]')) AS v, generate_subscripts(json_extract(block, '$.content[*]'), 1) AS k FROM b WHERE json_type(block, '$.content') = 'ARRAY')),
f0 AS (SELECT session_id, friction FROM session_catalog WHERE session_id IS NOT NULL AND json_valid(friction) AND json_type(friction) = 'ARRAY'),
f AS (SELECT session_id AS parent_key, v AS item, (k - 1)::VARCHAR AS path FROM (SELECT session_id, unnest(json_extract(friction, '$[*]')) AS v, generate_subscripts(json_extract(friction, '$[*]'), 1) AS k FROM f0)
 UNION ALL SELECT parent_key, v, path || '.' || (k - 1) FROM (SELECT parent_key, path, unnest(json_extract(item, '$.related[*]')) AS v, generate_subscripts(json_extract(item, '$.related[*]'), 1) AS k FROM f WHERE json_type(item, '$.related') = 'ARRAY'))
SELECT DISTINCT parent_key, 'block' AS child_kind, path AS child_path FROM b WHERE parent_key IS NOT NULL AND json_extract_string(block, '$.type') = 'text' AND json_type(block, '$.text') = 'VARCHAR' AND regexp_matches(json_extract_string(block, '$.text'), '\\S')
UNION ALL SELECT DISTINCT parent_key, 'friction', path FROM f WHERE json_type(item, '$.ref') = 'VARCHAR' AND regexp_matches(json_extract_string(item, '$.ref'), '\\S')
"""


def p5_found(required: dict[str, str], optional: dict[str, str], prefix: str) -> str:
    shape = ", ".join(f"('{p}', '{k}', {str(p in required).lower()})" for p, k in {**required, **optional}.items())
    return f"""
WITH s(path, want, needed) AS (VALUES {shape}),
v AS (SELECT c.export_file, ltrim(regexp_replace(j.fullkey, '\\[\\d+\\]|\\$', '', 'g'), '.') AS path, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'BOOLEAN' THEN 'bool' ELSE 'number' END AS kind
 FROM conversations c, json_tree(c.chat_messages) j WHERE json_valid(c.chat_messages) AND j.type <> 'NULL' AND NOT ends_with(j.fullkey, ']') AND j.fullkey <> '$'),
k AS (SELECT DISTINCT export_file, path, kind FROM v),
bad AS (SELECT k.export_file, k.path FROM k LEFT JOIN s ON s.path = k.path WHERE s.want IS NULL OR s.want <> k.kind
 UNION SELECT f.export_file, s.path FROM (SELECT DISTINCT export_file FROM conversations) f, s WHERE s.needed AND NOT EXISTS (SELECT 1 FROM k WHERE k.export_file = f.export_file AND k.path = s.path))
SELECT DISTINCT export_file, '{prefix}.' || path AS field_path FROM bad
"""


P7_FOUND = f"""
WITH d AS (SELECT delivery_id, nullif({_FOLD.format('event_id')}, '') AS i, array_to_string(list_sort(list_distinct(source_record_ids)), ',') AS s FROM owner_events),
loose AS (SELECT DISTINCT s FROM d WHERE i IS NULL AND s IS NOT NULL), linked AS (SELECT i, min(s) AS s FROM d WHERE i IS NOT NULL AND s IN (SELECT s FROM loose) GROUP BY 1),
m AS (SELECT delivery_id, CASE WHEN d.s IN (SELECT s FROM loose) THEN coalesce('s:' || l.s, 's:' || d.s) WHEN l.s IS NOT NULL THEN 's:' || l.s WHEN d.i IS NOT NULL THEN 'i:' || d.i ELSE 'd:' || delivery_id END AS message FROM d LEFT JOIN linked l ON l.i = d.i)
SELECT delivery_id FROM (SELECT delivery_id, min(delivery_id) OVER (PARTITION BY message) AS kept FROM m) WHERE delivery_id <> kept
"""
