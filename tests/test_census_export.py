import json

from conftest import rows
from pyspark.sql import functions as F

from rillstone.operators import census as N
from rillstone.operators import export as X

RULES = [("alpha", "archive", "dest=x", 2), ("alpha/nested/", "keep-in-place", "", 3), ("lonely.txt", "gated", "", 4), ("", "gated", "", 5), ("a", "bad", "", 6), ("b", "move", "nowhere", 7), (".", "keep-in-place", "", 8)]


def test_census(spark, tmp_path):
    for name in ("alpha/a.txt", "alpha/nested/b.txt", "lonely.txt", "cache/hidden.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "cache" / "empty").mkdir()
    listed, warnings = N.list_tree(spark, str(tmp_path), ["cache"])
    rules, bad = N.load_rules(spark.createDataFrame(RULES, "pattern string, disposition string, reason string, line_no int"))
    assert sorted(r["warning"] for r in bad.collect()) == ["invalid-disposition", "missing-dest-in-reason", "missing-pattern"]
    done = N.flag_tracked(N.apply_rules(listed, rules), spark.createDataFrame([("lonely.txt",), ("alpha",)], "path string"))
    got = {r["path"]: (r["type"], r["disposition"], r["git_tracked"], r["child_count"]) for r in done.collect()}
    assert got == {
        ".": ("directory", "keep-in-place", 0, None), "alpha": ("directory", "archive", 0, None), "alpha/a.txt": ("file", "archive", 0, None), "alpha/nested": ("directory", "keep-in-place", 0, None),
        "alpha/nested/b.txt": ("file", "keep-in-place", 0, None), "lonely.txt": ("file", "gated", 1, None), "cache": ("excluded", "excluded-by-policy", 0, 2),
    }
    assert N.unassigned(done) == (0, []) and warnings.count() == 0
    few = N.apply_rules(listed, rules.filter("pattern = 'alpha' OR pattern = '.'"))
    assert N.unassigned(few) == (1, ["lonely.txt"])
    table = {r["top_level"]: r for r in N.crosstab(N.flag_tracked(few, spark.createDataFrame([], "path string"))).collect()}
    assert table["lonely.txt"]["UNASSIGNED"] == 1 and table["alpha"]["archive"] == 4
    files = listed.filter("type = 'file'").select("path")
    assert N.count_mismatches(files, files).count() == 0 and rows(N.count_mismatches(files, files.limit(0)))[0][1:] != (0, 0)
    assert N.tracked_files(spark, str(tmp_path / "alpha")).count() == 0


def test_later_line_wins_a_tie(spark):
    rules = spark.createDataFrame([("a", "archive", "1", 2), ("a", "gated", "2", 3)], "pattern string, disposition string, reason string, line_no int")
    assert N.apply_rules(spark.createDataFrame([("a/b", "file")], "path string, type string"), rules).head()["disposition"] == "gated"


def test_export(spark, tmp_path):
    human = lambda t, **k: {"sender": "Human", "text": t, **k}
    talks = [
        (1, "a/b", "2026-07-02T00:00", None, [human("one"), {"sender": "assistant", "text": "no"}, human(" ", content=[{"type": "text", "text": "x"}, {"type": "image"}, {"type": "text", "text": "y"}])]), (2, "a b", "2026-07-03", None, [human("again")]),
        (3, "c", "2026-06-01", None, [human("early")]), (4, "d", None, "2026-13-01", [human("when")]), (5, "..", "2026-07-02", None, [human("who")]), (6, "e", "", "2026-07-05", [{"sender": "tool", "text": "t"}, 5]), (7, "f", "2026-07-02", None, None),
    ]
    df = spark.createDataFrame([(i, u, up, cr, json.dumps(m) if m is not None else "{bad") for i, u, up, cr, m in talks], "k bigint, uuid string, updated_at string, created_at string, msgs string")
    got = {r["k"]: r["decision"] for r in X.decide(df, "k", "msgs", "2026-07-01").collect()}
    assert got == {1: "written", 2: "duplicate_uuid", 3: "before_min_date", 4: "date_unknown", 5: "missing_uuid", 6: "zero_human", 7: "zero_human"}
    docs = X.documents(df, "k", "msgs", "2026-07-01")
    assert docs.head()["document"] == "---\nsession_id: a_b\nprompts: 2\n---\n\n## Prompts\n\n1. one\n2. x\n   y\n"
    assert X.write_documents(docs, str(tmp_path / "out")).filter(F.col("written")).count() == 1
    assert (tmp_path / "out" / "a_b-prompts.md").read_text().startswith("---\nsession_id: a_b")
