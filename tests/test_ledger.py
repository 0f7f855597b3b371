import json

from conftest import rows
from pyspark.sql import functions as F

from rillstone.operators import ledger as G
from rillstone.sources import markdown as M


def items(spark, data):
    full = [tuple({**dict.fromkeys(G.ITEM_COLUMNS, ""), **d}[c] for c in G.ITEM_COLUMNS) for d in data]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in G.ITEM_COLUMNS))


def test_close_items(spark):
    cat = spark.createDataFrame([("close", "s1", "2026-07-01", "sl", "h.md", "p", "went well", json.dumps([{"goal": "g1", "verdict": "met"}, "g2", {"id": "7", "text": "g3", "outcome": "open"}]), json.dumps([{"what": "f1", "kind": "k", "ref": "r"}, "f2", {}])), ("backfill", "s2", "2026-07-01", "x", "", "", "no", None, None)], "entry_source string, session_id string, date string, slug string, handoff_path string, project string, outcome_summary string, goals string, friction string")
    got = sorted((r["lane"], r["text"], r["verdict"], r["ref"], r["kind"]) for r in G.close_items(cat).collect())
    assert got == [("close-friction", "f1", "", "r", "k"), ("close-friction", "f2", "", "", ""), ("close-goal", "g1", "met", "", ""), ("close-goal", "g2", "", "", ""), ("close-goal", "g3", "open", "7", ""), ("close-outcome", "went well", "", "", "")]


def test_precedence_and_echo(spark):
    a = items(spark, [{"session_id": "1", "text": "x"}, {"session_id": "2", "text": "x"}])
    assert [r["session_id"] for r in G.supersede(a, items(spark, [{"session_id": "1", "text": "x"}])).collect()] == ["2"]
    b = items(spark, [{"session_id": "2", "date": "2026-01-02", "text": "Same  Text"}, {"session_id": "1", "date": "2026-01-01", "text": "same text "}])
    assert [r["session_id"] for r in G.collapse_echo(b).collect()] == ["1"]


def test_summary(spark):
    data = [
        {"session_id": "1", "date": "2026-06-01", "lane": "prompt", "text": "a"}, {"session_id": "2", "date": "2026-07-02", "lane": "close-goal", "verdict": "met", "text": "b", "handoff": "h"},
        {"session_id": "3", "date": "2026-07-05", "lane": "close-goal", "verdict": "met", "text": "c"}, {"session_id": "3", "date": "2026-07-03", "lane": "close-friction", "ref": "cause", "text": "d"},
    ]
    r = G.summarise(items(spark, data).withColumn("cluster_id", F.lit(1)), "2026-07").head()
    assert (r["times_seen"], r["records"], r["days"], r["fix"], r["still_open"], r["grade"], r["root_caused"], r["spans_eras"]) == (3, 4, 4, "met 2026-07-02, recurred 2x after", "yes", "mixed", "cause", True)
    r = G.summarise(items(spark, data[1:2]).withColumn("cluster_id", F.lit(1)), "2026-07").head()
    assert (r["fix"], r["still_open"], r["grade"], r["root_caused"]) == ("met 2026-07-02, no recurrence since", "no", "close-row", "h")
    r = G.summarise(items(spark, [{"lane": "note-prompt", "text": "x"}]).withColumn("cluster_id", F.lit(1)), "2026-07").head()
    assert (r["times_seen"], r["fix"], r["grade"], r["days"]) == (1, "no verdict recorded", "prompts-only", 0)


def test_clusters_and_labels(spark):
    data = [{"session_id": str(i), "date": f"2026-0{i}-01", "lane": "prompt", "text": t} for i, t in enumerate(["please repair broken parser module quickly again", "repair broken parser module quickly", "repair the broken parser module, quickly now please tonight", "nothing alike here whatsoever friend"], 1)]
    m = G.cluster_items(items(spark, data))
    sizes = sorted(r["count"] for r in m.groupBy("cluster_id").count().collect())
    assert sizes == [1, 3]
    keys = {r["signature"]: (r["key"], r["label"]) for r in G.keys_and_labels(m).collect()}
    key, label = keys["broken module parser please quickly repair"]
    assert len(key) == 10 and label == "broken module parser quickly repair please"
    names = spark.createDataFrame([(key, "parser woes")], "key string, value string")
    assert "parser woes" in {r["label"] for r in G.keys_and_labels(m, names).collect()}
    assert G.exemplars(m).count() == 4
    ranked = G.summarise(m, "2026-02").join(G.keys_and_labels(m), "cluster_id")
    assert G.render(ranked, 1).count("\n") == 3


def test_citations(spark):
    notes = spark.createDataFrame([("rule_a", "body"), ("b-rule", "Text\nSUPERSEDED by c \nmore"), ("x.y", "z")], "stem string, text string")
    refs = spark.createDataFrame([("rule_a",), ("b-rule.md",), ("y_x",), ("none",), ("",)], "ref string")
    assert rows(G.citations(refs, notes)) == [("b-rule.md", "[S]", "SUPERSEDED by c"), ("none", "[?]", ""), ("rule_a", "", ""), ("y_x", "[!]", "x.y")]


def test_coverage_and_seeds(spark):
    u = "0123abcd-0000-0000-0000-00000000000"
    cat = spark.createDataFrame([("2026-05-01", f"c:/w/proj/{u}1.jsonl", ""), ("2026-06-01", f"c:/w/C--Users-x-AppData-Local-Temp/{u}2.jsonl", ""), ("2026-07-01", f"c:/w/p/{u}3.jsonl", "")], "date string, raw_jsonl_path string, transcript_md_path string")
    got = spark.createDataFrame([(u.upper() + "1",), (u + "9",)], "session_id string")
    assert tuple(G.coverage_numbers(got, cat, ["2026-05", "2026-06"]).head())[:5] == (2, 1, 1, 1, 1)
    seeds = spark.createDataFrame([("a", ["pars"]), ("b", ["zzz"]), ("c", [])], "name string, terms array<string>")
    assert rows(G.seeded_threads(items(spark, [{"lane": "close-goal", "text": "The PARSER", "session_id": "1", "date": "d"}, {"lane": "prompt", "text": "parser"}]), seeds)) == [("a", 1, 1, "d", "d"), ("b", 0, 0, None, None), ("c", 0, 0, None, None)]


def test_prompts_quotes_events(spark):
    p = spark.createDataFrame([("s", "2026-01-01T00", "hi", "C:/Work/main", "x"), ("s", "t", "ho", "D:/tmp", "x"), ("s", "t", "he", None, "x"), ("s", "t", " ", "", "x")], "session_id string, timestamp string, text string, cwd string, slug string")
    assert sorted(r["text"] for r in G.prompt_items(p, "\\work\\").collect()) == ["he", "hi"]
    q = spark.createDataFrame([("s", "d", "", "quote", "l"), ("s", "d", "claim", "quote", "l"), ("s", "d", None, None, "l")], "session_id string, date string, claim string, quote string, quote_locator string")
    assert sorted(r["text"] for r in G.quote_items(q).collect()) == ["claim", "quote"]
    e = spark.createDataFrame([("e", "s", "t", ["a", "b"]), ("f", "s", "t", [])], "event_id string, session_id string, timestamp string, text_blocks array<string>")
    assert [r["text"] for r in G.event_items(e).collect()] == ["a\nb"]


def test_markdown(spark, tmp_path):
    estate = "---\nsession_id: abc\n---\n> quoted one\n> more\n>\n> two\n\n## Session Prompts\n1. first\n   goes on\n2. second\n## Grill\n1. ignored\n# Other\n1. third\n2. \n"
    assert M.estate_prompts(estate, "stem") == ("abc", ["quoted one\nmore", "two", "first goes on", "second", "third"], 1)
    (tmp_path / "b.md").write_text(estate)
    assert M.prompts(M.markdown_files(spark, str(tmp_path))).filter("text IS NOT NULL").count() == 5
    uid = "0123abcd-0000-0000-0000-000000000001"
    legacy = f"id {uid}\n## Session goal\nFix the storage layout for good this time\n## What was pending\nnone\n## Open decisions\nshort\n## Elsewhere\nlong enough text that has no lane at all\n"
    assert M.legacy_items("2026-06-01-session.md", legacy) == [(uid, "2026-06-01", "legacy-goal", "Fix the storage layout for good this time")]
    assert M.legacy_items("nodate.md", legacy) is None
    note = f"---\nproject: main\ndate: 2026-06-02\n---\n{uid}\n> **Owner:** please look at the failing importer and\n> tell me why\nA reply of some length that is not quoted at all here.\n> stray quote\n> **Owner:** ok\n"
    assert M.note_items("n.md", note, "Owner", "main") == [(uid, "2026-06-02", "main", "please look at the failing importer and tell me why")]
    assert M.note_items("n.md", note, "Owner", "other") == []
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "2026-06-01-session.md").write_text(legacy + note)
    files = M.markdown_files(spark, str(tmp_path / "n"))
    assert M.legacy_close(files).count() == 1 and M.session_notes(files, "Owner").count() == 1


def test_members_are_worked_out_once(spark):
    """The ledger reads its members many times, so their plan must be a mere scan, not the lanes and the clustering over again."""
    same = "migrate archive pointers into ledger folder tonight"
    data = [(f"s{i}", "2026-01-01", "", "", "", same if i < 3 else f"unrelated topic number{'abcdef'[i]}", "prompt", "", "", "") for i in range(6)]
    m = G.cluster_items(spark.createDataFrame(data, ", ".join(f"{c} string" for c in G.ITEM_COLUMNS)))
    assert not {"Join", "Exchange", "Aggregate"} & {w for w in ("Join", "Exchange", "Aggregate") if w in m._jdf.queryExecution().executedPlan().toString()}
    big = m.groupBy("cluster_id").count().filter("count = 3").select("cluster_id")
    part = G.keys_and_labels(m.join(big, "cluster_id", "left_semi"), corpus=m)
    assert rows(part) == [r for r in rows(G.keys_and_labels(m)) if r[0] == big.head()[0]]
