import hashlib
import json
import os

import pytest
from conftest import rows

from rillstone.operators import capture as C
from rillstone.sources import lines as L

BASE = {"event_id": "e1", "record_id": "r1", "session_id": "s", "logical_seq": 1, "timestamp": "2026-01-01T00:00:00Z", "sender": "human", "record_type": "message", "text": "hello"}
MIXED = [json.dumps(BASE), "", '"non-object"', "{broken", json.dumps(BASE | {"sender": "assistant"}), json.dumps(BASE | {"timestamp": "2026-W01-1T00:00:00Z"}), '{"value":NaN}', '{"a":1,"a":2}']


def lines(spark, texts, stream="s1"):
    data = [(f"{stream}-O{i:06d}", stream, f"cap/{stream}.jsonl#L{i}", i, hashlib.sha256(t.encode()).hexdigest(), t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(data, "occurrence_id string, stream_id string, source_locator string, line_number bigint, raw_line_sha256 string, raw_text string")


def test_mixed_fixture(spark):
    events, receipts = C.normalise(lines(spark, MIXED))
    got = [(r["disposition"], r["reason_code"]) for r in receipts.orderBy("occurrence_id").collect()]
    assert got == [
        ("EMITTED", "OWNER_EVENT_EMITTED"), ("REJECTED", "MALFORMED_JSON"), ("REJECTED", "NON_OBJECT_JSON"), ("REJECTED", "MALFORMED_JSON"), ("SUPPRESSED", "NON_OWNER_ACTOR"), ("REJECTED", "INVALID_TIMESTAMP"), ("REJECTED", "MALFORMED_JSON"), ("REJECTED", "MALFORMED_JSON")
    ]
    assert events.count() == 1 and C.event_violations(events).count() == 0 and C.receipt_violations(receipts).count() == 0
    assert C.packet_violations(lines(spark, MIXED), events, receipts).count() == 0
    counters = C.build_counters(events, receipts)
    assert counters == C.recount(events, receipts) and C.counter_violations(counters) == []
    assert C.counter_violations(counters | {"receipts": -1}) == ["total.receipts"] and C.counter_violations({}) != []
    assert counters["by_disposition"] == {"EMITTED": 1, "CONTRIBUTED": 0, "SUPPRESSED": 1, "DROPPED": 0, "REJECTED": 6}
    assert counters["by_event_class"]["ordinary_user_turn"] == {"semantic_events": 1, "emitted_events": 1, "contributing_occurrences": 1, "dropped_occurrences": 0}


def test_assembly(spark):
    second = BASE | {"record_id": "r2", "text": "world"}
    events, receipts = C.normalise(lines(spark, [json.dumps(BASE), json.dumps(second), json.dumps(BASE), json.dumps(BASE | {"event_id": "e2", "record_id": "r9", "record_type": "steering", "boundary": "interrupt"})]))
    assert [r["disposition"] for r in receipts.orderBy("occurrence_id").collect()] == ["EMITTED", "CONTRIBUTED", "DROPPED", "EMITTED"]
    e = {r["event_id"]: r for r in events.collect()}
    assert e["e1"]["text_blocks"] == ["hello", "world"] and e["e1"]["provenance"]["derivation"] == "MULTI_RECORD_ASSEMBLY" and e["e2"]["event_class"] == "steering_interruption"


@pytest.mark.parametrize(
    "change,said",
    [({"record_id": "r1", "text": "other"}, "conflicting durable id"), ({"record_id": "r2", "session_id": "t"}, "conflicting scalar"), ({"record_id": "r2", "timestamp": "2026-01-01T00:00:01Z"}, "conflicting scalar"), ({"record_id": "r2", "record_type": "close"}, "incompatible classes")],
)
def test_conflicts(spark, change, said):
    events, _ = C.normalise(lines(spark, [json.dumps(BASE), json.dumps(BASE | change)]))
    with pytest.raises(Exception, match=said):
        events.collect()


def test_bundle(spark, tmp_path):
    target = str(tmp_path / "bundle")
    one = C.publish_bundle(lines(spark, MIXED), target)
    assert sorted(os.listdir(target)) == ["counters.json", "events.jsonl", "manifest.json", "occurrences.jsonl", "receipts.jsonl"]
    assert one == C.publish_bundle(lines(spark, MIXED), str(tmp_path / "again"))
    with pytest.raises(FileExistsError):
        C.publish_bundle(lines(spark, MIXED), target)
    with pytest.raises(ValueError, match="changed"):
        C.publish_bundle(lines(spark, MIXED), str(tmp_path / "late"), lambda: False)
    no_boundary = json.dumps(BASE | {"record_type": "close"})
    with pytest.raises(ValueError, match="class:boundary"):
        C.publish_bundle(lines(spark, [no_boundary]), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="duplicate"):
        C.publish_bundle(lines(spark, MIXED).union(lines(spark, MIXED)), str(tmp_path / "dup"))
    assert sorted(os.listdir(tmp_path)) == ["again", "bundle"]


def test_raw_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"one\r\ntwo\rthree\n\n\xe2\x80\xa8x\n")
    files = L.capture_files(spark, str(tmp_path / "a.jsonl"))
    assert [r["raw_text"] for r in L.raw_lines(files, "s", "l/a").orderBy("line_number").collect()] == ["one", "two", "three", "", "\u2028x"]
    assert L.raw_lines(files, "s", "l/a").orderBy("line_number").head()["occurrence_id"] == "s-O000001"
    assert L.verify_unchanged(spark, str(tmp_path / "a.jsonl"), files).count() == 0
    for name, data in (("bom", b"\xef\xbb\xbfx"), ("bad", b"\xff")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="byte order mark|invalid UTF-8"):
            L.raw_lines(L.capture_files(spark, str(tmp_path / name)), "s", "l").collect()
    (tmp_path / "empty").write_bytes(b"")
    assert L.raw_lines(L.capture_files(spark, str(tmp_path / "empty")), "s", "l").count() == 0


def test_envelope_checks(spark):
    good = lines(spark, ["x"])
    assert C.occurrence_violations(good).count() == 0
    bad = spark.createDataFrame([("a", "s", "l#L2", 1, "h", "t"), ("b", "-s", "l#L1", 1, "h", "t"), ("c", "s", "../l#L1", 1, "h", "t"), ("d", "s", "l#L1", 1, "h", "t")], good.schema)
    assert dict((r[0], r[-1]) for r in C.occurrence_violations(bad).collect()) == {"a": "line_number:locator", "b": "stream_id:form", "c": "source_locator:form", "d": "raw_line_sha256:mismatch"}


def test_order_by_fraction(spark):
    make = lambda i, t: json.dumps(BASE | {"event_id": f"e{i}", "record_id": f"r{i}", "timestamp": t})
    events, _ = C.normalise(lines(spark, [make(1, "2026-01-01T00:00:00.1000Z"), make(2, "2026-01-01T01:00:00.01+01:00"), make(3, "2026-01-01T00:00:00Z")]))
    assert [r["event_id"] for r in C.event_order(events).collect()] == ["e3", "e2", "e1"]


def test_streaming(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from rillstone.streaming import ingest

    src = lines(spark, MIXED).withColumn("ingested_at", F.lit(dt.datetime(2026, 1, 1))).drop("raw_line_sha256")
    src.unionByName(src).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.classified_stream(ingest.line_stream(spark, str(tmp_path / "in")))
    ingest.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 8 and rows(out.groupBy("action").count()) == [("CAPTURE", 1), ("REJECTED", 6), ("SUPPRESSED", 1)]
