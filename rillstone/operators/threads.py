"""Work threads: session catalog, topics and prompts become a ledger with conflicts, and the ledger is searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.text import blank, coverage, epoch_seconds, filled, slug, strip, tokens
from rillstone.operators.similarity import overlap_pairs


def open_count(value: Column) -> Column:
    """Of a JSON text: the length of a list; numbers truncated, booleans as 0 or 1, numeric strings read; else 0; never negative."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    listed = F.size(F.try_variant_get(v, "$", "array<variant>"))
    text = strip(F.try_variant_get(v, "$", "string"))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint")).when(kind == "STRING", F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))).otherwise(F.try_variant_get(v, "$", "double").try_cast("bigint"))
    return F.when(kind.startswith("ARRAY"), listed.cast("bigint")).otherwise(F.greatest(F.lit(0).cast("bigint"), F.coalesce(number, F.lit(0).cast("bigint"))))


def goal_items(value: Column) -> Column:
    """Of a JSON text: ``array<struct<goal, verdict>>`` in order; a string is a list of one; blank goals stay, to be counted."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    items = F.when(kind == "STRING", F.array(v)).when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    goal = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.goal", "string"))
    return F.transform(items, lambda x: F.struct(strip(blank(goal(x))).alias("goal"), F.try_variant_get(x, "$.verdict", "string").alias("verdict")))


def thread_rows(catalog: DataFrame) -> DataFrame:
    """``slug, session_id, date, n, goal, status, state, open_thread_count`` of catalog rows (strings ``goals``, ``open_threads``, ``open_text``, ``status_claimed``).

    Goals come first; without a usable one the claimed status stands in. Open threads add a row of their own. Rows without a slug are left out;
    repeated rows count once.
    """
    used = ["slug", "session_id", "date", "goals", "open_threads", "open_text", "status_claimed"]
    rows = catalog.filter(strip(F.col("slug")) != "").select(*used).distinct()
    usable = F.filter(goal_items(F.col("goals")), lambda g: g["goal"] != "")
    rows = rows.withColumns({"__goals": F.coalesce(usable, F.array().cast("array<struct<goal:string,verdict:string>>")), "__open": open_count(F.col("open_threads"))})
    base = ["slug", "session_id", "date"]
    verdict = slug(F.col("g.verdict"))
    goals = rows.select(*base, F.posexplode("__goals").alias("n", "g")).select(
        *base, "n", "g.goal", F.concat(F.lit("claimed-"), verdict, F.lit("@"), "slug").alias("status"), F.when(verdict == "met", "met").otherwise("unknown").alias("state"), F.lit(None).cast("bigint").alias("open_thread_count")
    )
    claim = strip(blank(F.col("status_claimed")))
    claimed = rows.filter((F.size("__goals") == 0) & (claim != "")).select(*base, F.lit(0).alias("n"), F.substring(claim, 1, 160).alias("goal"), F.concat(F.lit("claimed-unknown@"), "slug").alias("status"), F.lit("unknown").alias("state"), F.lit(None).cast("bigint").alias("open_thread_count"))
    text = F.substring(strip(blank(F.col("open_text"))), 1, 160)
    opened = rows.filter("__open > 0").select(*base, F.lit(1_000_000).alias("n"), F.coalesce(filled(text), F.concat(F.lit("Open threads: "), F.col("__open").cast("string"))).alias("goal"), F.concat(F.lit("open-threads@"), "slug").alias("status"), F.lit("open").alias("state"), F.col("__open").alias("open_thread_count"))
    return goals.unionByName(claimed).unionByName(opened)


def with_topics(threads: DataFrame, memberships: DataFrame) -> DataFrame:
    """One row per topic of the slug; slugs without one are ``untagged``."""
    return threads.join(memberships.select("slug", "topic").distinct(), "slug", "left").withColumn("topic", F.coalesce("topic", F.lit("untagged")))


def with_conflicts(threads: DataFrame) -> DataFrame:
    """Adds ``status_sources`` and sets state and status of rows in conflict: a met and an open row of different slugs whose goals overlap by 0.6.

    All rows are compared as they were before. Conflicts are found between distinct goals, by an index of rare tokens.
    """
    goals = threads.filter("state IN ('met', 'open')").select("state", "goal").distinct().withColumn("tokens", tokens(F.col("goal"))).withColumn("item_id", F.col("goal"))
    pairs = overlap_pairs(goals.filter("state = 'met'"), goals.filter("state = 'open'"), 3, 5)
    met = threads.filter("state = 'met'").select(F.col("goal").alias("a"), F.col("status").alias("sa"), F.col("slug").alias("la")).distinct()
    opened = threads.filter("state = 'open'").select(F.col("goal").alias("b"), F.col("status").alias("sb"), F.col("slug").alias("lb")).distinct()
    clash = pairs.join(met, "a").join(opened, "b").filter("la <> lb")
    sides = clash.select(F.lit("met").alias("state"), F.col("a").alias("goal"), F.col("la").alias("slug"), F.col("sa").alias("status"), F.col("sb").alias("other")).unionByName(
        clash.select(F.lit("open").alias("state"), F.col("b").alias("goal"), F.col("lb").alias("slug"), F.col("sb").alias("status"), F.col("sa").alias("other"))
    )
    against = sides.groupBy("state", "goal", "slug", "status").agg(F.array_sort(F.array_union(F.collect_set("other"), F.array(F.first("status")))).alias("sources"))
    joined = threads.join(against, ["state", "goal", "slug", "status"], "left")
    hit = F.col("sources").isNotNull()
    return joined.withColumns({"status_sources": F.coalesce("sources", F.array("status")), "status": F.when(hit, "conflict").otherwise(F.col("status")), "state": F.when(hit, "conflict").otherwise(F.col("state"))}).drop("sources")


def pointer_list(handoff: Column, transcript: Column, raw: Column, prompt: Column) -> Column:
    """Distinct ``label=value`` pointers in a fixed order, blank ones left out."""
    items = [F.when(strip(blank(v)) != "", F.concat(F.lit(label + "="), strip(v))) for label, v in (("handoff", handoff), ("transcript", transcript), ("jsonl", raw), ("prompt-estate", prompt))]
    return F.array_distinct(F.filter(F.array(*items), lambda x: x.isNotNull()))


def prompt_paths(sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Adds ``prompt_path``: the prompt file of the session id, else of the slug (``prompts``: ``session_key, path``)."""
    one = prompts.groupBy("session_key").agg(F.min("path").alias("path"))
    by_id, by_slug = one.toDF("session_id", "p1"), one.toDF("slug", "p2")
    return sessions.join(by_id, "session_id", "left").join(by_slug, "slug", "left").withColumn("prompt_path", F.coalesce("p1", "p2")).drop("p1", "p2")


def resolve_pointers(pointers: DataFrame, listing: DataFrame, archive: DataFrame, ephemeral_root: str) -> DataFrame:
    """``path, resolved, action`` of pointers (``path``) against existing files (``path, sha256``) and archived copies (``path, day, sha256``).

    Outside the ephemeral root a missing file gives way to its newest copy. Under it the newest identical copy is taken; a file without one is to
    be archived (``archive``), and one that has neither file nor copy is ``lost``.
    """
    base = F.substring_index("path", "/", -1)
    dated = archive.filter(F.col("day").rlike(r"^\d{4}-\d\d-\d\d$") & F.expr("try_to_timestamp(day, 'yyyy-MM-dd')").isNotNull()).withColumn("base", base)
    newest = dated.groupBy("base").agg(F.max_by("path", F.struct("day", "path")).alias("newest"))
    same = dated.groupBy("base", "sha256").agg(F.max_by("path", F.struct("day", "path")).alias("identical"))
    rows = pointers.select("path").distinct().withColumn("base", base).join(listing.select("path", "sha256"), "path", "left").join(newest, "base", "left").join(same, ["base", "sha256"], "left")
    ephemeral, there = F.col("path").startswith(ephemeral_root), F.col("sha256").isNotNull()
    resolved = F.when(~ephemeral & there, F.col("path")).when(~ephemeral, F.coalesce("newest", "path")).when(there, F.col("identical")).otherwise(F.col("newest"))
    action = F.when(ephemeral & there & F.col("identical").isNull(), "archive").when(ephemeral & ~there & F.col("newest").isNull(), "lost").otherwise("none")
    return rows.select("path", resolved.alias("resolved"), action.alias("action"))


def search(threads: DataFrame, query: str, top: int = 5) -> DataFrame:
    """``score, goal, status, last_touched, slug, pointers``: the rows whose goal and topic cover the query best, newer first. An empty query and a
    top below 1 find nothing; unreadable dates come last."""
    spark = threads.sparkSession
    wanted = spark.range(1).select(tokens(F.lit(query)).alias("q")).head()[0]
    q = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    scored = threads.withColumns({"score": coverage(q, tokens(F.col("goal")), tokens(F.col("topic"))), "__at": epoch_seconds(F.col("last_touched"))}).filter("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("__at"), F.lower("goal"), "slug").limit(max(0, top)).drop("__at")


def source_counts(catalog: DataFrame) -> DataFrame:
    """``source, n``: rows by entry source; blank is UNKNOWN."""
    return catalog.groupBy(F.coalesce(filled(blank(F.col("entry_source"))), F.lit("UNKNOWN")).alias("source")).agg(F.count("*").alias("n"))


def display_status(status: Column, sources: Column) -> Column:
    return F.when(status == "conflict", F.concat(F.lit("conflict ("), F.array_join(sources, "; "), F.lit(")"))).otherwise(status)


def render(threads: DataFrame) -> str:
    """The ledger as Markdown, by topic; a report for people, so it is collected."""
    out, topic = [], None
    for r in threads.orderBy("topic", F.lower("goal"), "slug").toLocalIterator():
        if r["topic"] != topic:
            topic = r["topic"]
            out += [f"## {topic}", "", "| goal | status | last touched | pointers |", "|---|---|---|---|"]
        esc = lambda x: str(x or "").replace("|", "\\|").replace("\n", " ")
        status = f"conflict ({'; '.join(r['status_sources'])})" if r["status"] == "conflict" else r["status"]
        out.append(f"| {esc(r['goal'])} | {esc(status)} | {esc(r['last_touched'])} | {esc('; '.join(r['pointers'] or []))} |")
    return "\n".join([*out, ""])
