import datetime as dt
import random

from rillstone.operators import redelivery as R

SCHEMA = "delivery_id bigint, event_id string, source_record_ids array<string>, delivered_at timestamp, p string, period string, of_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, s, dt.datetime(2026, 1 + i % 5, 1) + dt.timedelta(minutes=i), "x", None, "y") for i, e, s in rows], SCHEMA)


def losers(rows):
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fold = lambda e: (e.strip().lower() or None) if e is not None else None
    for i, e, s in rows:
        for j, f, t in rows:
            same_set = s is not None and t is not None and set(s) == set(t)
            if (fold(e) and fold(e) == fold(f)) or ((not fold(e) or not fold(f)) and same_set):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i, _, _ in rows if find(i) != i}


def test_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "", " ", "A", "a ", "b", "c", "d", "e", "f"]), r.choice([None, [], ["1"], ["1", "1"], ["2", "1"], ["1", "2"], ["3"], ["4"], ["5"], ["6"]])) for i in range(60)]
    for cut in (0.6,):
        assert {x[0] for x in R.redelivered(frame(spark, rows), cut).collect()} == losers(rows)


def test_merge_touches_only_affected_partitions(spark):
    store = R.DeliveryStore(spark)
    assert store.winners() is None
    first = frame(spark, [(10, "a", ["1"]), (11, "b", ["2"]), (13, "c", ["3"])])
    store.merge(first)
    before = store.manifest()["partitions"]
    done = store.merge(frame(spark, [(1, " A", ["9"]), (22, "z", ["8"])]))
    after = store.manifest()["partitions"]
    assert {x["delivery_id"] for x in store.winners().collect()} == {1, 11, 13, 22}
    untouched = set(before) - set(done["affected"])
    assert untouched and all(before[p] == after[p] for p in untouched)
    again = store.merge(first)
    assert {x["delivery_id"] for x in store.winners().collect()} == {1, 11, 13, 22} and again["version"] == 3


def test_empty(spark):
    assert R.redelivered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain(spark):
    rows = []
    for i in range(12):
        rows += [(3 * i, f"e{i}", [str(i)]), (3 * i + 1, f"e{i}", [str(i + 1)]), (3 * i + 2, None, [str(i)])]
    assert {x[0] for x in R.redelivered(frame(spark, rows), 0.5).collect()} == losers(rows)


def test_chain_of_two_hundred(spark):
    rows = []
    for i in range(200):
        rows += [(3 * i, f"e{i}", [str(i)]), (3 * i + 1, f"e{i}", [str(i + 1)]), (3 * i + 2, None, [str(i)])]
    keys = R.message_keys(R.identify(frame(spark, rows)).select("delivery_id", "id_key", "set_key"))
    assert keys.select("message").distinct().count() == 1 and keys.count() == 600


def test_of_two_merges_at_once_none_is_lost(spark, monkeypatch):
    store = R.DeliveryStore(spark)
    store.merge(frame(spark, [(10, "a", ["1"])]))
    other, publish, done = R.DeliveryStore(spark, store.path), R.DeliveryStore._publish, []

    def late(self, manifest):
        if self is store and not done:  # another merge gets in between
            done.append(1)
            other.merge(frame(spark, [(5, "b", ["2"])]))
        publish(self, manifest)

    monkeypatch.setattr(R.DeliveryStore, "_publish", late)
    assert store.merge(frame(spark, [(3, "A", ["7"])]))["version"] == 3
    assert {x["delivery_id"] for x in store.winners().collect()} == {3, 5}


def test_index_is_compacted(spark, monkeypatch):
    monkeypatch.setattr(R, "INDEX_PARTS", 2)
    store = R.DeliveryStore(spark)
    for i in range(4):
        store.merge(frame(spark, [(10 - i, "a", [str(i)]), (20 + i, f"x{i}", None)]))
    assert len(store.manifest()["index"]) <= 2 and {x["delivery_id"] for x in store.winners().collect()} == {7, 20, 21, 22, 23}
