import itertools
import json
import random

from rillstone.operators import drift

OK = {"uuid": "u", "sender": "human", "created_at": "t", "text": "some words here", "content": [{"type": "text", "text": "block words"}]}


def report(spark, data):
    df = spark.createDataFrame(data, "file string, j string")
    return {(r["file"], r["path"], r["change"]): r["renamed_to"] for r in drift.drift_report(df, "file", "j", drift.message_shape()).collect()}


def test_changes(spark):
    named = {k: v for k, v in OK.items() if k != "text"} | {"message_text": "some words here"}
    data = [("a", json.dumps([OK, OK | {"text": None}])), ("b", json.dumps([named])), ("c", json.dumps([OK | {"text": 5, "content": [{"type": "text", "text": "x", "byte_count": 3, "lang": None, "extra": {"y": 1}}]}])), ("d", None), ("a", json.dumps([OK]))]
    got = report(spark, data)
    assert not [k for k in got if k[0] == "a"]
    assert got[("b", "message_text", "added")] == "text" and ("b", "text", "missing") in got
    assert {k[1:] for k in got if k[0] == "c"} == {("text", "retyped"), ("content.extra", "added"), ("content.extra.y", "added")}
    assert {k[1] for k in got if k[0] == "d"} == set(drift.message_shape().required)


def test_unify(spark):
    named = {k: v for k, v in OK.items() if k != "text"} | {"message_text": {"value": "deep"}, "content": "flat"}
    df = spark.createDataFrame([(1, "a", json.dumps([OK])), (2, "b", json.dumps([named, named | {"message_text": "plain"}, 7])), (3, "c", "broken")], "k bigint, file string, j string")
    rep = spark.createDataFrame([("b", "message_text", "text")], "file string, path string, renamed_to string")
    got = {(r["row_key"], r["position"]): (r["text"], [tuple(b) for b in r["content"]]) for r in drift.unify_messages(df, "k", "file", "j", rep).collect()}
    assert got == {(1, 0): ("some words here", [("text", "block words")]), (2, 0): ("deep", [("text", "flat")]), (2, 1): ("plain", [("text", "flat")])}


def test_unify_keeps_everything(spark):
    deep = {"type": "attachment", "body": {"value": "third", "lang": "en"}, "id": "a1", "name": "n.txt", "mime_type": "text/plain", "byte_count": 12, "content": [{"type": "text", "text": "fourth"}]}
    top = {"type": "text", "body": "first", "lang": None, "byte_count": "many", "content": [{"type": "text", "body": "second", "text": None, "content": [deep]}, "bare"]}
    message = {k: v for k, v in OK.items() if k not in ("text", "content")} | {"text": "t", "message_text": "other", "edited": True, "parts": [top, {"body": "x", "text": "y"}], "sender": ["a", "b"]}
    df = spark.createDataFrame([(1, "a", json.dumps([message])), (2, "b", json.dumps([OK | {"content": 5}]))], "k bigint, file string, j string")
    rep = spark.createDataFrame([("a", "message_text", "text"), ("a", "content.body", "content.text"), ("a", "parts", "content")], "file string, path string, renamed_to string")
    got = {r["row_key"]: r for r in drift.unify_messages(df, "k", "file", "j", rep).collect()}
    assert [tuple(b) for b in got[1]["blocks"]] == [
        ("0", "text", "first", None, None, None, None, {"lang": "null", "byte_count": '"many"'}), ("0.0", "text", "second", None, None, None, None, {}),
        ("0.0.0", "attachment", "third", "a1", "n.txt", "text/plain", 12, {"text": '{"value": "third", "lang": "en"}'}), ("0.0.0.0", "text", "fourth", None, None, None, None, {}),
        ("0.1", "text", "bare", None, None, None, None, {}), ("1", None, "y", None, None, None, None, {"body": '"x"'}),
    ]
    assert got[1]["extras"] == {"message_text": '"other"', "edited": "true", "sender": '["a", "b"]'} and got[1]["sender"] == "a\nb"
    assert [tuple(b) for b in got[1]["content"]] == [("text", "first"), (None, "y")]
    assert got[2]["blocks"] == [] and got[2]["extras"] == {"content": "5"}


def test_assignment_is_optimal():
    r = random.Random(4)
    for n, m in [(1, 1), (2, 3), (3, 3), (4, 5), (5, 5)]:
        for _ in range(20):
            cost = [[r.randint(0, 9) for _ in range(m)] for _ in range(n)]
            best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            got = drift.assign(cost)
            assert sorted(set(got)) == sorted(got) and sum(cost[i][j] for i, j in enumerate(got)) == best


def test_empty(spark):
    assert report(spark, []) == {}
