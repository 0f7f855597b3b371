"""The engine's jobs from files to files, each with its summary and exit code (0 done, 1 incomplete, 2 broken input).

The same jobs run from the command line: ``python -m rillstone JOB --option value ...``.
"""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.functions.noise import without_noise
from rillstone.operators import capture, census, export, ledger, similarity, threads
from rillstone.runtime import materialise
from rillstone.sources import lines, markdown


def write_text(path: str, text: str) -> None:
    """Replace a file whole."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    os.replace(temp, path)


def write_jsonl(path: str, rows: DataFrame) -> int:
    """Rows in their order as JSON lines, streamed through the driver; returns their number."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder)
    n = 0
    with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
        for r in rows.toLocalIterator():
            f.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False, sort_keys=True) + "\n")
            n += 1
    os.replace(temp, path)
    return n


def summary_line(summary: dict) -> str:
    return "SUMMARY: " + json.dumps(summary, sort_keys=True)


def capture_raw(spark: SparkSession, raw_jsonl: str, stream_id: str, source_label: str, out: str) -> tuple[int, dict]:
    """Raw JSON lines to a canonical bundle; the input is checked again before the bundle appears."""
    files = lines.capture_files(spark, raw_jsonl)
    seen = materialise(files.select("path", "sha256"), "identity")
    try:
        rows = materialise(lines.raw_lines(files, stream_id, source_label), "lines")
        hashes = capture.publish_bundle(rows, out, lambda: lines.verify_unchanged(spark, raw_jsonl, seen).count() == 0)
    except Exception as e:  # any fault of the input leaves no output
        return 2, {"exit_code": 2, "error": str(e).splitlines()[0][:300]}
    return 0, {"exit_code": 0, "occurrences": rows.count(), "outputs": len(hashes)}


def capture_prebuilt(spark: SparkSession, occurrences_jsonl: str, out: str) -> tuple[int, dict]:
    """Prebuilt occurrences (one JSON object a line) to a canonical bundle; any blank line or broken envelope fails the run."""
    schema = "occurrence_id string, stream_id string, fixture_id string, source_locator string, line_number bigint, raw_line_sha256 string, raw_text string"
    text = lines.capture_files(spark, occurrences_jsonl).select(F.explode(lines.split_records(F.decode("content", "UTF-8"))).alias("line"))
    needed = [k for k in capture.LINE_KEYS if k != "stream_id"]
    parsed = materialise(text.select(F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r"), lines.strict_fault(F.col("line"), needed, ["stream_id", "fixture_id"]).alias("fault")), "parsed")
    broken = parsed.filter("fault IS NOT NULL OR r.occurrence_id IS NULL OR (r.stream_id IS NULL) = (r.fixture_id IS NULL)").select("fault").head(1)
    if broken:
        return 2, {"exit_code": 2, "error": f"a line is no occurrence: {broken[0][0]}"}
    rows = materialise(parsed.select("r.*").withColumn("stream_id", F.coalesce("stream_id", "fixture_id")).drop("fixture_id"), "lines")
    try:
        capture.publish_bundle(rows, out)
    except Exception as e:
        return 2, {"exit_code": 2, "error": str(e).splitlines()[0][:300]}
    return 0, {"exit_code": 0, "occurrences": rows.count()}


def load_canonical_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of canonical JSON lines in any number of files; a contract violation or a repeated event id raises an error."""
    attachment = "struct<id:string,name:string,mime_type:string,byte_count:bigint,sha256:string>"
    schema = (
        "event_id string, source_record_ids array<string>, source_occurrence_ids array<string>, session_id string, resume_of string, logical_seq bigint, timestamp string, actor string, event_class string, text_blocks array<string>, "
        f"attachments array<{attachment}>, tool_call_id string, boundary string, provenance struct<source_locators:array<string>,derivation:string>"
    )
    text = spark.read.text(path)
    broken = text.select(lines.strict_fault(F.col("value"), capture.EVENT_KEYS).alias("fault")).filter("fault IS NOT NULL").head(1)
    if broken:
        raise ValueError(f"a line is no event: {broken[0][0]}")
    events = materialise(text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*"), "events")
    bad = capture.event_violations(events).select("violation", "event_id").head(1)
    if bad:
        raise ValueError(f"{bad[0][0]}: {bad[0][1]}")
    twice = events.groupBy("event_id").count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"event_id:duplicate: {twice[0][0]}")
    return events


def convert_export(spark: SparkSession, export_path: str, out: str, min_date: str | None = None) -> tuple[int, dict]:
    """A chat export to one Markdown file per conversation; ``out`` is a folder that all executors share."""
    doc = lines.conversations_document(spark, export_path)
    get = lambda n: F.try_variant_get("conversation", f"$.{n}", "string").alias(n)
    talks = doc.filter(F.schema_of_variant("conversation").startswith("OBJECT")).select(F.col("position").cast("bigint").alias("row_no"), get("uuid"), get("created_at"), get("updated_at"), F.to_json(F.try_variant_get("conversation", "$.chat_messages", "variant")).alias("messages"))
    talks = materialise(talks, "talks")
    counts = {r["decision"]: r["count"] for r in export.decide(talks, "row_no", "messages", min_date).groupBy("decision").count().collect()}
    written = export.write_documents(export.documents(talks, "row_no", "messages", min_date), out).count()
    total = doc.count()
    names = ["before_min_date", "date_unknown", "missing_uuid", "duplicate_uuid", "zero_human"]
    return 0, {"exit_code": 0, "conversations_total": total, "conversations_malformed": total - talks.count(), "conversations_written": written} | {f"conversations_{n}": counts.get(n, 0) for n in names}


def _catalog(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    rows = lines.tolerant_records(spark, path)
    r = F.col("record")
    get = lambda n: lines.field(r, n)
    raw = lambda n: F.to_json(F.try_variant_get(r, f"$.{n}", "variant"))
    names = ["slug", "session_id", "date", "project", "status_claimed", "outcome_summary", "open_text", "transcript_md_path"]
    cols = [get(n).alias(n) for n in names] + [raw(n).alias(n) for n in ("goals", "friction", "open_threads")]
    cols += [F.coalesce(get("entry_source"), get("source")).alias("entry_source"), F.coalesce(T.filled(get("handoff_path")), get("handoff")).alias("handoff_path"), F.coalesce(T.filled(get("raw_jsonl_path")), get("jsonl")).alias("raw_jsonl_path")]
    counts = {x["reason"]: x["count"] for x in rows.filter("reason IS NOT NULL").groupBy("reason").count().collect()}
    return materialise(rows.filter("reason IS NULL").select(*cols), "catalog"), counts


def build_threads(spark: SparkSession, catalog_path: str, registry_path: str, prompt_dir: str | None, out_md: str, out_jsonl: str) -> tuple[int, dict]:
    """Catalog, topic registry and prompt files to the thread ledger, as Markdown and JSON lines."""
    catalog, skipped = _catalog(spark, catalog_path)
    memberships = lines.topic_registry(spark, registry_path).join(catalog.select("slug").distinct(), "slug", "left_semi")
    rows = threads.with_conflicts(threads.with_topics(threads.thread_rows(catalog), memberships))
    if prompt_dir and os.path.isdir(prompt_dir):
        keys = markdown.prompts(markdown.markdown_files(spark, prompt_dir)).select(F.col("session_id").alias("session_key"), "path").distinct()
    else:
        keys = spark.createDataFrame([], "session_key string, path string")
    paths = catalog.select("slug", "handoff_path", "transcript_md_path", "raw_jsonl_path").dropDuplicates(["slug"])
    rows = threads.prompt_paths(rows.join(paths, "slug", "left"), keys)
    c = F.col
    rows = rows.withColumns({"pointers": threads.pointer_list(c("handoff_path"), c("transcript_md_path"), c("raw_jsonl_path"), c("prompt_path")), "last_touched": T.blank(c("date"))})
    rows = materialise(rows.select("topic", "goal", "status", "state", "status_sources", "last_touched", "slug", "pointers", "open_thread_count"), "threads")
    write_text(out_md, "# Threads\n\n" + threads.render(rows))
    n = write_jsonl(out_jsonl, rows.orderBy("topic", F.lower("goal"), "slug"))
    states = {r["state"]: r["count"] for r in rows.groupBy("state").count().collect()}
    return 0, {"exit_code": 0, "rows": n, "sessions": catalog.filter("slug <> ''").count(), "unknown": states.get("unknown", 0), "conflicts": states.get("conflict", 0), "skipped": skipped}


def query_threads(spark: SparkSession, threads_path: str, query: str, top: int = 5) -> tuple[int, dict]:
    """The best rows for a query, as a Markdown table, or NO-MATCH."""
    rows = lines.threads_jsonl(spark, threads_path)
    hits = threads.search(rows, query, top).collect()
    esc = lambda x: str(x or "").replace("|", "\\|").replace("\n", " ")
    table = ["| goal | status (provenance) | last-touched | pointers |", "|---|---|---|---|"] + [f"| {esc(h['goal'])} | {esc(h['status'])} | {esc(h['last_touched'])} | {esc('; '.join(h['pointers'] or []))} |" for h in hits]
    quoted = query.replace("\\", "\\\\").replace('"', '\\"')
    return 0, {"exit_code": 0, "hits": len(hits), "loaded": rows.count(), "table": "\n".join(table) if hits else "NO-MATCH", "query": quoted}


def cluster_prompts(spark: SparkSession, folder: str, out: str, min_cluster: int = 3) -> tuple[int, dict]:
    """Prompt estates to a report of repeated instructions."""
    if min_cluster < 1:
        raise ValueError("min_cluster must be at least 1")
    files = markdown.markdown_files(spark, folder)
    found = materialise(markdown.prompts(files), "prompts")
    ordered = found.filter("text IS NOT NULL").withColumn("item_id", F.format_string("%s\u0001%s\u0001%08d", F.lower("name"), F.col("name"), F.col("position")))
    words = T.words_without_places(F.col("text"))
    members = materialise(ordered.withColumns({"normalized": F.array_join(words, " "), "tokens": F.array_sort(F.array_distinct(words))}), "prompts")
    pairs = similarity.jaccard_pairs(members.select("item_id", "tokens"), 11, 20).select("a", "b")
    if not members.filter(F.size("tokens") == 0).isEmpty():
        pairs = pairs.unionByName(similarity.link_empty(members.select("item_id", "tokens")))
    members = members.join(similarity.greedy(members.select("item_id"), pairs), "item_id")
    report = similarity.cluster_report(members, min_cluster).orderBy(F.desc("score"), F.desc("size"), "signature").collect()  # a report for people
    text = ["# Repeated Instruction Clusters", ""]
    for i, r in enumerate(report, 1):
        text += [f"## Cluster {i}", "", f"- score: {r['score']:.2f}", f"- size: {r['size']}", f"- distinct sessions: {r['sessions']}", f"- normalized signature: {r['signature']}", "", "VERBATIM samples:"]
        for s in members.filter(F.col("cluster_id") == F.lit(r["cluster_id"])).orderBy("item_id").limit(3).collect():
            text += ["", f"- session_id: {s['session_id']}", "", "  > " + s["text"].replace("\n", "\n  > ")]
        text.append("")
    total = members.count()
    rest = 100.0 * (total - sum(r["size"] for r in report)) / total if total else 0.0
    write_text(out, "\n".join([*text, f"UNCLUSTERED: {rest:.1f}%", ""]))
    return 0, {"exit_code": 0, "files": files.count(), "prompts": total, "clusters": len(report), "skipped": found.filter("text IS NULL").count(), "unclustered_percent": round(rest, 1)}


def map_recurrence(
    spark: SparkSession, catalog_path: str, out: str, prompts_path: str | None = None, quotes_path: str | None = None, canonical_path: str | None = None, names_path: str | None = None, seeds_path: str | None = None, memory_dir: str | None = None,
    legacy_dir: str | None = None, notes_dir: str | None = None, owner: str = "Owner", project: str | None = None, cwd_needle: str | None = None, cutover: str = "2026-07", min_sessions: int = 2, top: int = 20, require_early: bool = False,
) -> tuple[int, dict]:
    """All lanes of evidence to the recurrence ledger, as Markdown. Close and legacy items supersede canonical events, those supersede mined items."""
    catalog, skipped = _catalog(spark, catalog_path)
    close = ledger.close_items(catalog)
    if legacy_dir:
        legacy = markdown.legacy_close(markdown.markdown_files(spark, legacy_dir, "*session*.md")).filter("lane <> 'unlinkable'")
        close = close.unionByName(ledger._items(legacy, **{c: F.col(c) for c in ("session_id", "date", "slug", "handoff", "lane", "text")}))
    mined = None
    add = lambda a, b: b if a is None else a.unionByName(b)
    if prompts_path:
        r = F.col("record")
        rows = lines.tolerant_records(spark, prompts_path).filter("reason IS NULL").select(*[lines.field(r, n).alias(n) for n in ("session_id", "timestamp", "text", "cwd", "slug")])
        mined = add(mined, ledger.prompt_items(rows, cwd_needle).withColumn("text", without_noise(F.col("text"))).filter("text <> ''"))
    if quotes_path:
        r = F.col("record")
        rows = lines.tolerant_records(spark, quotes_path).filter("reason IS NULL").select(lines.field(r, "sessionId").alias("session_id"), *[lines.field(r, n).alias(n) for n in ("date", "claim", "quote", "quote_locator")])
        mined = add(mined, ledger.quote_items(rows))
    if notes_dir:
        notes = markdown.session_notes(markdown.markdown_files(spark, notes_dir, recursive=True), owner, project).filter("lane <> 'unlinkable'")
        mined = add(mined, ledger._items(notes, **{c: F.col(c) for c in ("session_id", "date", "slug", "handoff", "project", "lane", "text")}))
    close = materialise(close, "close")
    early = None if mined is None else mined.filter(F.substring("date", 1, 7) < cutover)
    try:
        events = ledger.event_items(load_canonical_events(spark, canonical_path)) if canonical_path else None
    except Exception as e:
        return 2, {"exit_code": 2, "error": str(e).splitlines()[0][:300]}
    if events is not None:
        events = ledger.supersede(events, close)
        early = None if early is None else ledger.supersede(early, events)
    early = None if early is None else materialise(ledger.collapse_echo(early), "early")
    n_early = (0 if early is None else early.count()) + (0 if events is None else events.filter(F.substring("date", 1, 7) < cutover).count())
    if require_early and not n_early:
        return 2, {"exit_code": 2, "early_records": 0}
    everything = close
    for part in (early, events):
        everything = everything if part is None else everything.unionByName(part)
    members = materialise(ledger.cluster_items(everything.filter("lane NOT IN ('close-outcome', 'legacy-outcome')")), "members")
    names = lines.string_map(spark, names_path) if names_path else None
    rows = ledger.summarise(members, cutover, min_sessions).join(ledger.keys_and_labels(members, names), "cluster_id")
    if memory_dir:
        notes = markdown.markdown_files(spark, memory_dir).select("stem", "text")
        marks = ledger.citations(rows.select(F.col("root_caused").alias("ref")), notes).select(F.col("ref").alias("root_caused"), F.col("mark").alias("cite_mark"), F.col("note").alias("cite_note"))
        rows = rows.join(marks, "root_caused", "left").fillna("", ["cite_mark", "cite_note"])
    else:
        rows = rows.withColumns({"cite_mark": F.lit(""), "cite_note": F.lit("")})
    rows = materialise(rows, "ledger")
    parts = ["# Recurrence ledger", "", ledger.render(rows, top)]
    seeded = 0
    if seeds_path:
        hits = ledger.seeded_threads(everything, lines.term_lists(spark, seeds_path)).orderBy("name").collect()
        seeded = len(hits)
        parts += ["## Seeded threads", "", *[f"- {h['name']}: {h['hits']} records in {h['sessions']} sessions, {h['first_seen'] or '-'} to {h['last_seen'] or '-'}" for h in hits], ""]
    write_text(out, "\n".join(parts))
    one = rows.agg(F.count("*").alias("n"), F.count_if("spans_eras").alias("s"), F.count_if(F.col("cite_mark") != "").alias("c")).head()
    return 0, {"exit_code": 0, "close_rows": catalog.filter("entry_source = 'close'").count(), "records": everything.count(), "early_records": n_early, "clusters": one["n"], "spanning_threads": one["s"], "citation_problems": one["c"], "seeded_threads": seeded, "parse_errors": sum(skipped.values())}


def take_census(spark: SparkSession, root: str, out: str, excluded: list[str] | None = None, rules_csv: str | None = None, assert_complete: bool = False) -> tuple[int, dict]:
    """A tree's listing with decisions, cross-tabulated; with ``assert_complete`` an undecided path makes the exit code 1."""
    listed, warnings = census.list_tree(spark, root, excluded or [])
    if rules_csv:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(rules_csv).select("pattern", "disposition", "reason")
        numbered = raw.withColumn("line_no", F.monotonically_increasing_id() + 2)
    else:
        numbered = spark.createDataFrame([], "pattern string, disposition string, reason string, line_no bigint")
    rules, bad = census.load_rules(numbered)
    rows = materialise(census.flag_tracked(census.apply_rules(listed, rules), census.tracked_files(spark, root)), "census")
    again, _ = census.list_tree(spark, root, excluded or [])
    drift = census.count_mismatches(rows.filter("type = 'file'").select("path"), again.filter("type = 'file'").select("path"))
    warnings = warnings.unionByName(bad).unionByName(drift.select(F.lit("count").alias("source"), F.col("top_level").alias("path"), F.lit("count-mismatch").alias("warning"), F.concat_ws(" vs ", "n_a", "n_b").alias("detail")))
    os.makedirs(out, exist_ok=True)
    columns = ["path", "type", "size", "mtime", "git_tracked", "top_level", "disposition", "reason"]
    rows.select(*columns).orderBy("path").toPandas().to_csv(os.path.join(out, "census.csv"), index=False)
    warnings.toPandas().to_csv(os.path.join(out, "warnings.csv"), index=False)
    table = census.crosstab(rows).orderBy("top_level").toPandas()
    heads = list(table.columns)
    write_text(os.path.join(out, "census-summary.md"), "\n".join(["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads), *("| " + " | ".join(map(str, r)) + " |" for r in table.itertuples(index=False)), ""]))
    n, first = census.unassigned(rows)
    code = 1 if assert_complete and n else 0
    return code, {"exit_code": code, "rows": rows.count(), "unassigned": n, "first_unassigned": first, "warnings": warnings.count(), "git_tracked_files": rows.filter("git_tracked = 1").count()}


JOBS = {f.__name__.replace("_", "-"): f for f in (capture_raw, capture_prebuilt, convert_export, build_threads, query_threads, cluster_prompts, map_recurrence, take_census)}
