from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.functions.noise import strip_noise, without_noise


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).head()[0]


def test_columns(spark):
    assert one(spark, "see D:/logs/run7.txt or \\\\host\\share for it", T.normalize_prompt) == "see or for it"
    assert one(spark, "the http:/odd file:///etc/x ../up ./here mid/way Budget-Review!", T.normalize_topic) == "htt mid budget review"
    assert one(spark, "trailing / slash c: https://", T.normalize_prompt) == "trailing slash c http"
    assert one(spark, "B-a b A1", T.tokens) == ["a", "a1", "b"] and one(spark, None, T.tokens) == []
    assert one(spark, " Met! (mostly) ", T.slug) == "met-mostly" and one(spark, "--", T.slug) == "unknown" and one(spark, None, T.slug) == "unknown"
    assert one(spark, "..a b/c__", T.safe_name) == "a_b_c" and one(spark, None, T.safe_name) == ""
    assert one(spark, ".\\a\\b\\", T.norm_path) == "a/b" and one(spark, "./", T.norm_path) == "."
    assert one(spark, "2026-01-01T00:00:00.1000+01:00", T.canonical_timestamp) == "2025-12-31T23:00:00.1Z"
    for bad in ("2026-02-30T00:00:00Z", "2026-01-01T00:00:00+24:00", "2026-01-01T24:00:00Z", "2026-W01-1T00:00:00Z", None, ""):
        assert one(spark, bad, T.canonical_timestamp) is None
    assert one(spark, "bad-date", T.epoch_seconds) == float("-inf") and one(spark, "2026-01-01", T.epoch_seconds) == 1767225600.0
    assert one(spark, "a\u00a0\u2003b\x1c", T.collapse_spaces) == "a b"


def test_sets(spark):
    df = spark.sql("select array('a','b') x, array('b') y, cast(array() as array<string>) e")
    r = df.select(T.jaccard(F.col("x"), F.col("y")), T.jaccard(F.col("e"), F.col("e")), T.overlap(F.col("x"), F.col("y")), T.coverage(F.col("x"), F.col("e"), F.col("y")), T.coverage(F.col("e"), F.col("x"))).head()
    assert tuple(r) == (0.5, 1.0, 1.0, 0.5, 0.0)


def test_noise(spark):
    cases = {
        "<note>seen</note>": "", " <NOTE>seen</NOTE>\n<result>1</result></usage> ship it": "ship it", "just a request": "just a request", "ask: All Rights Reserved by whom?": "", "<notes>kept</notes> as it is": "<notes>kept</notes> as it is",
        "see [image: original 20x30] there": "", "see [image: original size] there": "see [image: original size] there", "[SYSTEM NOTIFICATION - job 7] ended\nnow the next one": "now the next one", "[SYSTEM NOTIFICATION without end": "[SYSTEM NOTIFICATION without end",
        "Base directory for this skill: /x\nrun the checks": "run the checks", "  <command-args>y</command-args> text": "", "<status>open": "", "<status>open</status>": "", "<summary ref=1> a remainder that is long enough to be kept as an own message": "a remainder that is long enough to be kept as an own message",
        "<statuses>are many": "<statuses>are many", "a < b and c > d": "a < b and c > d", "</x> tail": "tail", "": "",
    }
    for text, want in cases.items():
        assert strip_noise(text) == want
    df = spark.createDataFrame([("plain",), (None,)], "x string")
    assert [r[0] for r in df.select(without_noise(F.col("x"))).collect()] == ["plain", ""]
