"""The recurrence ledger: lanes of evidence, precedence, clusters and what each cluster tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillstone.functions.text import blank, collapse_spaces, filled, strip, topic_words
from rillstone.operators.similarity import connected, containment_pairs, signatures
from rillstone.runtime import materialise

ITEM_COLUMNS = ["session_id", "date", "slug", "handoff", "project", "text", "lane", "verdict", "ref", "kind"]
CLOSE_LANES = ["close-goal", "close-friction"]
LEGACY_LANES = ["legacy-goal", "legacy-pending", "legacy-decision", "legacy-outcome"]


def _items(df: DataFrame, **given: Column) -> DataFrame:
    return df.select(*[blank(given[c]).alias(c) if c in given else F.lit("").alias(c) for c in ITEM_COLUMNS])


def close_items(catalog: DataFrame) -> DataFrame:
    """Outcome, goal and friction items of the catalog rows whose entry source is ``close``; JSON columns ``goals`` and ``friction``. Repeated rows count once."""
    used = ["session_id", "date", "slug", "handoff_path", "project", "outcome_summary", "goals", "friction"]
    rows = catalog.filter("entry_source = 'close'").select(*used).distinct()
    base = {"session_id": F.col("session_id"), "date": F.substring("date", 1, 10), "slug": F.col("slug"), "handoff": F.col("handoff_path"), "project": F.col("project")}
    array = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    get = lambda v, *names: F.coalesce(*[filled(F.try_variant_get(v, f"$.{n}", "string")) for n in names])
    plain = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    outcomes = _items(rows.filter("outcome_summary <> ''"), text=F.col("outcome_summary"), lane=F.lit("close-outcome"), **base)
    single = F.when(F.schema_of_variant(F.try_parse_json("goals")) == "STRING", F.array(F.try_parse_json("goals")))
    goals = rows.withColumn("g", F.explode(F.coalesce(array("goals"), single)))
    goal_text = F.coalesce(plain(F.col("g")), get(F.col("g"), "goal", "text"))
    goals = _items(goals.filter(strip(blank(goal_text)) != ""), text=strip(goal_text), lane=F.lit("close-goal"), verdict=get(F.col("g"), "verdict", "outcome"), ref=get(F.col("g"), "id"), **base)
    pains = rows.withColumn("f", F.explode(array("friction")))
    pain_text = F.coalesce(plain(F.col("f")), get(F.col("f"), "what"))
    pains = _items(pains.filter(strip(blank(pain_text)) != ""), text=strip(pain_text), lane=F.lit("close-friction"), ref=get(F.col("f"), "ref"), kind=get(F.col("f"), "kind"), **base)
    return outcomes.unionByName(goals).unionByName(pains)


def quote_items(quotes: DataFrame) -> DataFrame:
    """One item per quote: the claim, else the quote; quotes with neither are left out."""
    text = F.coalesce(filled(strip(F.col("claim"))), filled(strip(F.col("quote"))))
    return _items(quotes.filter(text.isNotNull()), text=text, lane=F.lit("quote"), session_id=F.col("session_id"), date=F.substring("date", 1, 10), ref=F.col("quote_locator"))


def prompt_items(prompts: DataFrame, needle: str | None = None) -> DataFrame:
    """One item per prompt (``session_id, timestamp, text, cwd, slug``); prompts run elsewhere than in ``needle`` are left out, unless they do not say."""
    rows = prompts
    if needle is not None:
        cwd = blank(F.col("cwd"))
        rows = rows.filter((cwd == "") | F.lower(F.translate(cwd, "/", "\\")).contains(needle.lower()))
    return _items(rows.filter(strip(blank(F.col("text"))) != ""), text=strip(F.col("text")), lane=F.lit("prompt"), session_id=F.col("session_id"), date=F.substring("timestamp", 1, 10), slug=F.col("slug"))


def event_items(events: DataFrame) -> DataFrame:
    """One item per canonical event that has text."""
    text = F.array_join("text_blocks", "\n")
    return _items(events.filter(strip(blank(text)) != ""), text=text, lane=F.lit("canonical-event"), session_id=F.col("session_id"), date=F.substring("timestamp", 1, 10), ref=F.col("event_id"))


def supersede(items: DataFrame, stronger: DataFrame) -> DataFrame:
    """Items whose session and raw text no stronger item has."""
    return items.join(stronger.select("session_id", "text").distinct(), ["session_id", "text"], "left_anti").select(*items.columns)


def collapse_echo(items: DataFrame) -> DataFrame:
    """Of items alike but for case and white space, the earliest by date, session, lane and text."""
    key = F.md5(F.lower(collapse_spaces(blank(F.col("text")))))
    first = F.min(F.struct("date", "session_id", "lane", "text", *[c for c in items.columns if c not in ("date", "session_id", "lane", "text")]))
    return items.groupBy(key.alias("__key")).agg(first.alias("f")).select(*[F.col("f")[c].alias(c) for c in items.columns])


def cluster_items(items: DataFrame, num: int = 4, den: int = 5, floor: int = 5, least_tokens: int = 3) -> DataFrame:
    """``item_id, cluster_id, tokens, normalized`` and the items' columns, of items with enough topic words, in single-link clusters."""
    words = topic_words(F.col("text"))
    numbered = items.withColumns({"tokens": F.array_sort(F.array_distinct(words)), "normalized": F.array_join(words, " ")}).filter(F.size("tokens") >= least_tokens)
    numbered = materialise(numbered.withColumn("item_id", F.xxhash64(*[F.col(c) for c in ITEM_COLUMNS])).dropDuplicates(["item_id"]), "items")
    clusters = connected(numbered, containment_pairs(numbered.select("item_id", "tokens"), num, den, floor))
    return materialise(numbered.join(clusters, "item_id"), "members")


def summarise(members: DataFrame, cutover: str, least_sessions: int = 0) -> DataFrame:
    """One ledger row per cluster: ``cluster_id, times_seen, records, days, single_day, first_seen, last_seen, lanes, fix, still_open, grade, root_caused, spans_eras``."""
    c = F.col
    day, session = filled(c("date")), filled(c("session_id"))
    met = (c("verdict") == "met") & day.isNotNull()
    first = members.groupBy("cluster_id").agg(F.min(F.when(met, day)).alias("__first_met")).withColumnRenamed("cluster_id", "__of")
    rows = members.withColumns({"__day": day, "__session": session}).join(first, F.col("cluster_id").eqNullSafe(F.col("__of"))).drop("__of")
    order = F.struct("date", "session_id", "lane", "text")
    out = rows.groupBy("cluster_id").agg(
        F.count_distinct("__session").alias("n_sessions"), F.count("*").alias("records"), F.count_distinct("__day").alias("days"), F.min("__day").alias("first_seen"), F.max("__day").alias("last_seen"),
        F.array_sort(F.collect_set("lane")).alias("lanes"), F.min("__first_met").alias("first_met"), F.max(F.when(met, c("__day"))).alias("last_met"), F.count_if(c("__day") > c("__first_met")).alias("after"),
        F.min_by(F.when((c("lane") == "close-friction") & (c("ref") != ""), c("ref")), F.when((c("lane") == "close-friction") & (c("ref") != ""), order)).alias("friction_ref"),
        F.min_by(F.when(c("handoff") != "", c("handoff")), F.when(c("handoff") != "", order)).alias("first_handoff"),
    )
    has = lambda names: F.arrays_overlap("lanes", F.array(*map(F.lit, names)))
    spoken = has(["prompt", "quote"])
    grade = F.when(has(CLOSE_LANES) & spoken, "mixed").when(has(CLOSE_LANES), "close-row").when(has(LEGACY_LANES) & spoken, "legacy+prompts").when(has(LEGACY_LANES), "legacy-close").otherwise("prompts-only")
    fix = (
        F.when(c("first_met").isNull(), F.when(c("grade") == "prompts-only", "no verdict recorded").otherwise("not met"))
        .when(c("after") > 0, F.concat(F.lit("met "), "first_met", F.lit(", recurred "), c("after").cast("string"), F.lit("x after"))).otherwise(F.concat(F.lit("met "), "last_met", F.lit(", no recurrence since")))
    )
    seen = F.when(c("n_sessions") > 0, c("n_sessions")).otherwise(c("records"))
    out = out.withColumn("grade", grade).withColumns({
        "times_seen": seen, "single_day": c("days") <= 1, "fix": fix, "still_open": F.when(c("first_met").isNotNull() & (c("after") == 0), "no").otherwise("yes"), "root_caused": F.coalesce("friction_ref", "first_handoff", F.lit("")),
        "spans_eras": F.coalesce((F.substring("first_seen", 1, 7) < cutover) & (F.substring("last_seen", 1, 7) >= cutover), F.lit(False)),
    })
    return out.filter(c("n_sessions") >= least_sessions).drop("n_sessions", "first_met", "last_met", "after", "friction_ref", "first_handoff")


def keys_and_labels(members: DataFrame, names: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """``cluster_id, signature, key, label``: the key is a short digest of the signature; the label a given name, else the six shared tokens that
    are rarest in the corpus for how many members have them. The corpus is ``members``, unless these are those of some clusters only."""
    sig = signatures(members).withColumn("key", F.substring(F.sha1("signature"), 1, 10))
    corpus = (members if corpus is None else corpus).select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    held = members.select("cluster_id", F.explode("tokens").alias("t")).groupBy("cluster_id", "t").agg(F.count("*").alias("k")).join(corpus, "t").join(size, "cluster_id")
    enough = F.col("k") >= F.when(F.col("n") > 2, F.greatest(F.lit(2), F.expr("(n + 1) DIV 2"))).otherwise(2)
    ranked = held.withColumn("few", F.max(enough.cast("int")).over(W.partitionBy("cluster_id"))).filter(enough | (F.col("few") == 0))
    top = W.partitionBy("cluster_id").orderBy(F.desc(F.col("k") / F.col("df")), F.desc("k"), "t")
    label = ranked.withColumn("r", F.row_number().over(top)).filter("r <= 6").groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " ").alias("made"))
    out = sig.join(label, "cluster_id")
    if names is None:
        return out.withColumnRenamed("made", "label")
    return out.join(names.select("key", F.col("value").alias("given")), "key", "left").select("cluster_id", "signature", "key", F.coalesce("given", "made").alias("label"))


def ledger_order() -> list[Column]:
    """Most days first, then most sessions, most records, threads across eras, key."""
    return [F.desc("days"), F.desc("times_seen"), F.desc("records"), F.desc("spans_eras"), F.asc("key")]


def exemplars(members: DataFrame) -> DataFrame:
    """``cluster_id, nth, text``: all of up to three members, else the first, the middle and the last by date and text.

    Members are counted per date first; only dates that hold one of the places wanted are put in order, each by itself.
    """
    dates = members.groupBy("cluster_id", "date").agg(F.count("*").alias("k"))
    upto = W.partitionBy("cluster_id").orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    dates = dates.withColumns({"before": F.sum("k").over(upto) - F.col("k"), "all": F.sum("k").over(W.partitionBy("cluster_id"))})
    places = F.when(F.col("all") <= 3, F.sequence(F.lit(1).cast("bigint"), F.col("all"))).otherwise(F.array(F.lit(1).cast("bigint"), F.expr("all DIV 2 + 1"), F.col("all")))
    wanted = dates.withColumn("places", F.filter(places, lambda n: (n > F.col("before")) & (n <= F.col("before") + F.col("k")))).filter(F.size("places") > 0)
    wanted = wanted.select(F.col("cluster_id").alias("__c"), F.col("date").alias("__d"), "before", "places")
    near = members.join(wanted, F.col("cluster_id").eqNullSafe(F.col("__c")) & F.col("date").eqNullSafe(F.col("__d")))
    nth = F.col("before") + F.row_number().over(W.partitionBy("cluster_id", "date").orderBy("text", "item_id"))
    return near.withColumn("nth", nth).filter(F.array_contains("places", F.col("nth"))).select("cluster_id", "nth", "text")


def seeded_threads(items: DataFrame, seeds: DataFrame) -> DataFrame:
    """``name, hits, sessions, first_seen, last_seen``: close and legacy items that contain one of a seed's terms; seeds without a hit keep a row.

    ``seeds`` (``name, terms``) is a small list given by hand, of at most 10,000 rows.
    """
    few = seeds.limit(10_001).collect()
    if len(few) > 10_000:
        raise ValueError("more than 10,000 seeds")
    rows = items.filter(F.col("lane").startswith("close") | F.col("lane").startswith("legacy"))
    tests = [F.when(F.coalesce(F.greatest(*([F.contains(F.lower("text"), F.lit(t)) for t in s["terms"]] + [F.lit(False)] * 2)), F.lit(False)), F.lit(s["name"])) for s in few]
    empty = rows.sparkSession.createDataFrame([(s["name"],) for s in few], "name string")
    if not few:
        return empty.select("name", *[F.lit(None).cast("string").alias(c) for c in ("hits", "sessions", "first_seen", "last_seen")])
    hit = rows.select("session_id", filled(F.col("date")).alias("date"), F.explode(F.array_compact(F.array(*tests))).alias("name"))
    sums = hit.groupBy("name").agg(F.count("*").alias("hits"), F.count_distinct(filled(F.col("session_id"))).alias("sessions"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    return empty.join(sums, "name", "left").fillna(0, ["hits", "sessions"])


def citations(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """``ref, mark, note`` of references against memory notes (``stem, text``): nothing if found, ``[S]`` if found but superseded, ``[!]`` if only a note
    of the same words is there, ``[?]`` if none is."""
    parts = lambda c: F.array_join(F.array_sort(F.split(F.lower(c), r"[_\-.]+")), "|")
    line = collapse_spaces(F.regexp_extract(F.substring("text", 1, 3000), r"(?im)^(.*superseded.*)$", 1))
    known = notes.select("stem", F.substring(line, 1, 180).alias("retired"), parts(F.col("stem")).alias("bag"))
    exact = known.select(F.col("stem").alias("ref"), F.col("retired").alias("r1"), F.lit(True).alias("found"))
    near = known.groupBy("bag").agg(F.min_by(F.struct("stem", "retired"), "stem").alias("alike"))
    asked = refs.select("ref").filter("ref <> ''").distinct().withColumn("bag", parts(F.regexp_replace("ref", r"\.md$", "")))
    joined = asked.withColumn("key", F.regexp_replace("ref", r"\.md$", "")).join(exact.withColumnRenamed("ref", "key"), "key", "left").join(near, "bag", "left")
    mark = F.when(F.col("found"), F.when(F.col("r1") != "", "[S]").otherwise("")).when(F.col("alike").isNotNull(), "[!]").otherwise("[?]")
    note = F.when(F.col("found"), F.col("r1")).when(F.col("alike").isNotNull(), F.concat_ws(" ", F.col("alike.stem"), filled(F.col("alike.retired")))).otherwise("")
    return joined.select("ref", mark.alias("mark"), note.alias("note"))


def coverage_numbers(recovered: DataFrame, catalog: DataFrame, months: list[str], temp_pattern: str = r"^c--users-.+-appdata-local-temp") -> DataFrame:
    """One row ``total, temp, real, joined, unlisted, pct_of_all, pct_of_real``: how many of the catalog's sessions of the months were recovered."""
    uuid = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    path = F.lower(F.translate(blank(F.coalesce(filled(F.col("raw_jsonl_path")), filled(F.col("transcript_md_path")))), "\\", "/"))
    segment = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    rows = catalog.filter(F.substring("date", 1, 7).isin(months)).select(segment.rlike(temp_pattern).alias("is_temp"), filled(F.regexp_extract(path, uuid, 1)).alias("sid"))
    real = rows.filter("NOT is_temp AND sid IS NOT NULL").select("sid").distinct()
    ids = recovered.select(F.lower("session_id").alias("sid")).filter("sid <> ''").distinct()
    sums = rows.agg(F.count("*").alias("total"), F.count_if("is_temp").alias("temp"))
    joined = ids.join(real, "sid", "left_semi").agg(F.count("*").alias("joined"))
    unlisted = ids.join(real, "sid", "left_anti").agg(F.count("*").alias("unlisted"))
    out = sums.crossJoin(real.agg(F.count("*").alias("real"))).crossJoin(joined).crossJoin(unlisted)  # one row each
    return out.withColumns({"pct_of_all": F.col("joined") * 100.0 / F.greatest(F.lit(1), "total"), "pct_of_real": F.col("joined") * 100.0 / F.greatest(F.lit(1), "real")})


def render(rows: DataFrame, top: int = 20) -> str:
    """The first rows of the ledger as a Markdown table; a report for people."""
    cols = ["label", "days", "times_seen", "records", "first_seen", "last_seen", "grade", "fix", "still_open"]
    out = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    out += ["| " + " | ".join(str(r[c]).replace("|", "\\|") for c in cols) + " |" for r in rows.orderBy(*ledger_order()).limit(max(0, top)).collect()]
    return "\n".join([*out, ""])
