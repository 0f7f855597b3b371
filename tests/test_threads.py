import json

from pyspark.sql import functions as F

from rillstone.operators import threads as H
from rillstone.sources import lines as L

ROWS = [
    {"slug": "s1", "session_id": "id1", "date": "2026-07-01", "goals": [{"goal": "Consolidate the storage rules", "verdict": "Met"}, {"goal": " "}, "bare goal"], "open_threads": 0},
    {"slug": "s2", "session_id": "id2", "date": "2026-07-02", "goals": "single", "open_threads": ["a", "b"], "open_text": "Consolidate storage rules again"},
    {"slug": "s3", "goals": None, "status_claimed": "x" * 200, "open_threads": "3"},
    {"slug": "s4", "goals": [], "open_threads": True}, {"slug": "s5", "goals": 7, "open_threads": 2.9}, {"slug": " ", "goals": "lost"},
]
SCHEMA = "slug string, session_id string, date string, goals string, open_threads string, open_text string, status_claimed string"


def catalog(spark):
    text = lambda r, k: json.dumps(r[k]) if k in r else None
    return spark.createDataFrame([(r.get("slug"), r.get("session_id"), r.get("date"), text(r, "goals"), text(r, "open_threads"), r.get("open_text"), r.get("status_claimed")) for r in ROWS * 2], SCHEMA)


def test_rows_and_conflicts(spark):
    t = H.thread_rows(catalog(spark))
    got = sorted((r["slug"], r["state"], r["goal"][:30], r["open_thread_count"]) for r in t.collect())
    assert got == [
        ("s1", "met", "Consolidate the storage rules", None), ("s1", "unknown", "bare goal", None), ("s2", "open", "Consolidate storage rules agai", 2), ("s2", "unknown", "single", None), ("s3", "open", "Open threads: 3", 3),
        ("s3", "unknown", "x" * 30, None), ("s4", "open", "Open threads: 1", 1), ("s5", "open", "Open threads: 2", 2),
    ]
    topics = spark.createDataFrame([("s1", "t1"), ("s1", "t2"), ("zz", "t3")], "slug string, topic string")
    ledger = H.with_conflicts(H.with_topics(t, topics))
    assert ledger.filter("state = 'conflict'").count() == 3 and ledger.filter("topic = 'untagged'").count() == 6
    assert ledger.filter("slug = 's2' AND state = 'conflict'").head()["status_sources"] == ["claimed-met@s1", "open-threads@s2"]
    assert "conflict (claimed-met@s1; open-threads@s2)" in H.render(ledger.withColumn("pointers", F.array(F.lit("p"))).withColumn("last_touched", F.col("date")))


def test_search(spark, tmp_path):
    data = [
        {"topic": "t", "goal": "Consolidate duplicate storage rules", "status": "a", "last_touched": "2026-07-16", "slug": "new"}, {"topic": "storage", "goal": "Consolidate old rules", "status": "b", "last_touched": "2026-07-01", "slug": "old"},
        {"topic": "t", "goal": "storage", "status": "c", "last_touched": "bad-date", "slug": "z"}, {"topic": "t", "goal": " "},
    ]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(map(json.dumps, data)) + "\nbroken\n[1]\n\n")
    t = L.threads_jsonl(spark, str(path))
    assert t.count() == 3 and L.tolerant_records(spark, str(path)).filter("reason IS NOT NULL").count() == 2
    assert [r["slug"] for r in H.search(t, "consolidate storage").collect()] == ["new", "old", "z"]
    assert H.search(t, "quantum banana").count() == 0 and H.search(t, "").count() == 0 and H.search(t, "storage", -1).count() == 0


def test_archive(spark):
    p = spark.createDataFrame([("x/a.md",), ("x/b.md",), ("x/c.md",), ("tmp/d.md",), ("tmp/e.md",), ("tmp/f.md",), ("tmp/g.md",)], "path string")
    files = spark.createDataFrame([("x/a.md", "1"), ("tmp/d.md", "2"), ("tmp/e.md", "3")], "path string, sha256 string")
    copies = spark.createDataFrame([("ar/2026-01-01/b.md", "2026-01-01", "9"), ("ar/2026-02-01/b.md", "2026-02-01", "9"), ("ar/2026-2-30/b.md", "2026-2-30", "9"), ("ar/2026-01-01/d.md", "2026-01-01", "2"), ("ar/2026-03-01/d.md", "2026-03-01", "7"), ("ar/2026-01-01/f.md", "2026-01-01", "5")], "path string, day string, sha256 string")
    got = {r["path"]: (r["resolved"], r["action"]) for r in H.resolve_pointers(p, files, copies, "tmp/").collect()}
    assert got == {
        "x/a.md": ("x/a.md", "none"), "x/b.md": ("ar/2026-02-01/b.md", "none"), "x/c.md": ("x/c.md", "none"), "tmp/d.md": ("ar/2026-01-01/d.md", "none"), "tmp/e.md": (None, "archive"), "tmp/f.md": ("ar/2026-01-01/f.md", "none"), "tmp/g.md": (None, "lost")
    }


def test_sidecars(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"assignments": {"k": {"slug": "s", "topic": "a", "extra_topics": ["b", ""]}, "e": {"slug": "", "topic": "x"}}, "meta": {}}))
    assert sorted(tuple(r) for r in L.topic_registry(spark, str(tmp_path / "r.json")).collect()) == [("s", "a"), ("s", "b")]
    (tmp_path / "s.json").write_text(json.dumps({"_readme": "x", "a": ["T ", ""], "b": "no"}))
    assert [tuple(r) for r in L.term_lists(spark, str(tmp_path / "s.json")).collect()] == [("a", ["t"])]
    (tmp_path / "n.json").write_text(json.dumps({"_readme": "x", "k": "label"}))
    assert [tuple(r) for r in L.string_map(spark, str(tmp_path / "n.json")).collect()] == [("k", "label")]
    for name, doc in (("c1", [{"a": 1}]), ("c2", {"conversations": [{"a": 1}]})):
        (tmp_path / name).write_text("\ufeff" + json.dumps(doc))
        assert L.conversations_document(spark, str(tmp_path / name)).count() == 1
