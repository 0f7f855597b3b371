import json

import pytest
from conftest import rows

from rillstone.functions.instants import canonical_instant
from rillstone.functions.strictjson import strict_loads
from rillstone.operators import rejects

GOOD = {"event_id": "e", "record_id": "r", "session_id": "s", "logical_seq": 1, "timestamp": "2026-01-01T00:00:00Z", "sender": "human", "record_type": "message", "text": "hi"}
FILE = {"type": "attachment", "id": "a", "name": "n", "mime_type": "m", "byte_count": 0, "sha256": "0" * 64}


def line(**change):
    return json.dumps({k: v for k, v in (GOOD | change).items() if v is not ...})


CASES = [
    (line(), None), ("", "MALFORMED_JSON"), (" ", "MALFORMED_JSON"), (None, "MALFORMED_JSON"), ('"x"', "NON_OBJECT_JSON"), ("[1]", "NON_OBJECT_JSON"), ("{broken", "MALFORMED_JSON"), ('{"a":NaN}', "MALFORMED_JSON"), ('{"a":1,"a":2}', "MALFORMED_JSON"),
    ('{"a":1e9999}', "MALFORMED_JSON"), (line() + " x", "MALFORMED_JSON"), (" " + line() + "\n", None), ("﻿" + line(), "MALFORMED_JSON"), (line(sender=...), "MISSING_ACTOR"), (line(sender="  "), "MISSING_ACTOR"), (line(sender=["human"]), "MISSING_ACTOR"),
    (line(record_type="malformed"), "MALFORMED_RECORD"), (line(record_type=" Malformed "), "INVALID_SHAPE"), (line(content={}), "INVALID_ATTACHMENT"), (line(content=[3]), "INVALID_ATTACHMENT"), (line(content=None), None),
    (line(content=[{"type": "text"}]), "INVALID_ATTACHMENT"), (line(content=[FILE]), None), (line(content=[FILE | {"sha256": "A" * 64}]), "INVALID_ATTACHMENT"), (line(content=[FILE | {"byte_count": True}]), "INVALID_ATTACHMENT"),
    (line(content=[FILE | {"x": 1}]), "INVALID_ATTACHMENT"), (line(sender="assistant", content=[3]), "INVALID_ATTACHMENT"), (line(sender="assistant", event_id=...), None), (line(event_id=""), "MISSING_REQUIRED_FIELD"), (line(event_id=5), "MISSING_REQUIRED_FIELD"),
    (line(logical_seq=True), "MISSING_REQUIRED_FIELD"), (line(logical_seq=1.0), "MISSING_REQUIRED_FIELD"), (line(logical_seq=0), "MISSING_REQUIRED_FIELD"), (line(resume_of=""), "MISSING_REQUIRED_FIELD"), (line(resume_of=None), None),
    (line(timestamp="2025-W06-7T21:30:54Z"), "INVALID_TIMESTAMP"), (line(timestamp="2026-01-01T00:00:60Z"), "INVALID_TIMESTAMP"), (line(timestamp="2026-01-01T00:00:00+24:00"), "INVALID_TIMESTAMP"), (line(timestamp="2026-01-01t00:00:00.1234567890z"), None),
    (line(text=..., content=[FILE]), None), (line(text=...), "INVALID_SHAPE"), (line(text="", resume_of="x", content=[FILE]), "INVALID_SHAPE"), (line(record_type="steering", text=...), "INVALID_SHAPE"), (line(record_type="note"), "INVALID_SHAPE"),
    (line(record_type="tool_call", event_id=...), None), (line(boundary="carried_history_echo", event_id=...), None), (line(sender=" Human ", record_type=" Message "), None),
]


def test_cases(spark):
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(CASES)], "k string, raw_text string")
    got = dict(rows(rejects.reject_lines(df, "raw_text", ["k"])))
    assert {str(i): r for i, (_, r) in enumerate(CASES) if r} == got


def test_split_keeps_every_row_and_clashing_columns(spark):
    df = spark.createDataFrame([(line(), "x", 1), (line(), "x", 1), ("{", "y", 2), (None, None, None)], "raw_text string, reason string, column int")
    good, bad = rejects.split_lines(df)
    assert good.count() == 2 and bad.count() == 2 and good.columns == df.columns
    assert set(bad.columns) == {*df.columns, "reject_reason"}


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "raw_text string, k string")
    assert rows(rejects.reject_lines(empty, "raw_text", ["k"])) == []
    long = spark.createDataFrame([("a", line(text="x" * 2_000_000)), ("b", "[" * 200_000)], "k string, raw_text string")
    assert [r[0] for r in rows(rejects.reject_lines(long, "raw_text", ["k"]))] == ["b"]


def test_shuffled_dictionary_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(CASES)], "k string, raw_text string")
    want = rows(rejects.reject_lines(df, "raw_text", ["k"]))
    monkeypatch.setattr(rejects, "DICTIONARY_BROADCAST_ROWS", 0)
    assert rows(rejects.reject_lines(df, "raw_text", ["k"])) == want


def test_strict_json():
    assert strict_loads('{"a":[1,{"b":null}]}') == {"a": [1, {"b": None}]}
    for bad in ("{'a':1}", "[1,]", "Infinity", '{"a":{"b":1,"b":1}}', "1 2", "", "9" * 5000):
        with pytest.raises(ValueError):
            strict_loads(bad)


def test_canonical_instant():
    assert canonical_instant("2026-01-01T00:00:00.1000+01:00") == "2025-12-31T23:00:00.1Z"
    assert canonical_instant("2026-02-30T00:00:00Z") is None and canonical_instant("0001-01-01T00:00:00+01:00") is None
