import datetime as dt

from conftest import rows

from rillstone.operators import orphans as O


def at(h):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)


def tables(spark, lines, events, receipts):
    l = spark.createDataFrame(lines, "occurrence_id string, ingested_at timestamp, deleted_at timestamp")
    e = spark.createDataFrame(events, "event_id string, delivery_id bigint, sources array<string>, delivered_at timestamp, k string")
    r = spark.createDataFrame(receipts, "receipt_id string, occurrence_id string, event_id string, ingested_at timestamp")
    targets = [O.Target("lines", l, "occurrence_id", "ingested_at", "deleted_at"), O.Target("events", e, "event_id", "delivered_at")]
    refs = [O.Reference("events", e, "delivery_id", "sources", "delivered_at", "lines", own_key="event_id"), O.Reference("receipts", r, "receipt_id", "event_id", "ingested_at", "events")]
    return refs, targets


def test_lives_at_the_time(spark):
    lines = [("A", at(1), at(3)), ("a ", at(2), at(5)), ("A", at(8), None), ("B", at(0), at(0)), (None, at(0), None), ("c", None, None), ("d", at(0), at(40)), ("d", at(30), at(60))]
    events = [(f"e{i}", i, s, at(t), "x") for i, (s, t) in enumerate([(["a"], 0), (["a"], 1), (["a"], 4), ([" A\t"], 5), (["a"], 7), (["a"], 8), (["b"], 1), ([None, "zz", "zz"], 1), (None, 1), ([], 1), (["c"], 9), (["d"], 50), (["d"], 60)])]
    refs, targets = tables(spark, lines, events, [])
    got = {(r["src_key"], r["ref_key"]) for r in O.direct_orphans(refs, targets).collect()}
    assert got == {("0", "a"), ("3", " A\t"), ("4", "a"), ("6", "b"), ("7", "zz"), ("10", "c"), ("12", "d")}


def test_brute_force(spark):
    import random

    r = random.Random(1)
    lines = [(r.choice("abc"), at(r.randint(0, 90)), r.choice([None, at(r.randint(0, 120)), at(r.randint(0, 120)), at(r.randint(0, 120))])) for _ in range(60)]
    lines = [x for x in lines if x[0] != "a" or x[2] is not None]
    events = [(f"e{i}", i, [r.choice("abcd")], at(r.randint(0, 120)), "") for i in range(200)]
    refs, targets = tables(spark, lines, events, [])
    want = {(str(i), s[0]) for _, i, s, t, _ in events if not any(k == s[0] and a <= t and (d is None or d > t) for k, a, d in lines)}
    assert {(x["src_key"], x["ref_key"]) for x in O.direct_orphans(refs, targets).collect()} == want


def test_cascade_and_report(spark):
    refs, targets = tables(spark, [("a", at(0), None)], [("e1", 1, ["zz"], at(1), ""), ("e2", 2, ["a"], at(1), "")], [("r1", None, "e1", at(2)), ("r2", None, "E2", at(2)), ("r3", None, "nope", at(2))])
    got = {(r["src_table"], r["src_key"], r["orphaned"]) for r in O.orphan_cascade(refs, targets).collect()}
    assert got == {("events", "1", "direct"), ("receipts", "r3", "direct"), ("receipts", "r1", "inherited")}
    report = rows(O.orphan_report(O.orphan_cascade(refs, targets)))
    assert ("receipts", "event_id", "2026-01-01", "inherited", 1, 1) in report


def test_cascade_by_reference(spark):
    """A row with one direct orphan still has its other reference, which is inherited, reported."""
    refs, targets = tables(spark, [("a", at(0), None)], [("e1", 1, ["zz"], at(1), ""), ("e2", 2, ["a"], at(1), "")], [("r1", "zz", "E1", at(2)), ("r2", "zz", "e2", at(2)), ("r3", "a", "e1", at(2))])
    refs.append(O.Reference("receipts", refs[1].rows, "receipt_id", "occurrence_id", "ingested_at", "lines"))
    got = rows(O.orphan_cascade(refs, targets).select("src_table", "src_key", "src_field", "ref_key", "orphaned"))
    assert got == [
        ("events", "1", "sources", "zz", "direct"), ("receipts", "r1", "event_id", "E1", "inherited"), ("receipts", "r1", "occurrence_id", "zz", "direct"),
        ("receipts", "r2", "occurrence_id", "zz", "direct"), ("receipts", "r3", "event_id", "e1", "inherited"),
    ]


def test_cascade_ends_on_cycles(spark):
    nodes = spark.createDataFrame([("a", "b", at(2)), ("b", "a", at(2)), ("b", "nope", at(2)), ("c", "b", at(2))], "id string, parent string, t timestamp")
    refs = [O.Reference("nodes", nodes, "id", "parent", "t", "nodes", own_key="id")]
    got = rows(O.orphan_cascade(refs, [O.Target("nodes", nodes, "id", "t")]).select("src_key", "ref_key", "orphaned"))
    assert got == [("a", "b", "inherited"), ("b", "a", "inherited"), ("b", "nope", "direct"), ("c", "b", "inherited")]


def test_empty(spark):
    refs, targets = tables(spark, [], [], [])
    assert O.orphan_cascade(refs, targets).count() == 0
