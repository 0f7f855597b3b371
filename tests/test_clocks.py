import datetime as dt
import zoneinfo

import pytest
from conftest import rows

from rillstone.functions.instants import read_time
from rillstone.operators import clocks
from rillstone.operators.clocks import normalise_times, year_segments, zone_intervals


@pytest.mark.parametrize(
    "text,want",
    [
        ("2026-01-01T00:00:00Z", ("utc", 1767225600000000)), ("  2026-01-01t00:00:00z", ("utc", 1767225600000000)), ("20260101T000000Z", ("utc", 1767225600000000)), ("1767225600", ("utc", 1767225600000000)), ("1767225600123", ("utc", 1767225600123000)),
        ("1767225600123456", ("utc", 1767225600123456)), ("2026-01-01 01:00:00 CET", ("utc", 1767225600000000)), ("Thu, 01 Jan 2026 05:30:00 +0530", ("utc", 1767225600000000)), ("2026-01-01T01:00+01:00", ("utc", 1767225600000000)),
        ("2026-01-01T00:00:00,1234569Z", ("utc", 1767225600123456)), ("01/02/2026 13:05", ("local", 1769951100000000)), ("Jan 1, 2026 12:00:00 AM", ("local", 1767225600000000)), ("Jan 1, 2026 12:00:00 PM", ("local", 1767268800000000)),
        ("2026-01-01T01:00:00+01:00[Europe/Berlin]", ("utc", 1767225600000000)), ("2026-01-01", None), ("2026-W01-1T00:00:00Z", None), ("2026-01-01T00:00:60Z", None), ("2026-01-01T24:00:00Z", None), ("31/11/2026 08:00:00", None), ("yesterday 02:02", None),
        ("", None), (None, None), ("2026-06-?? 19:11:30", None), ("x" * 100_000, None), ("Jan 1, 2026 13:00:00 PM", None),
    ],
)
def test_read_time(text, want):
    got = read_time(text)
    assert (got[:2] if got else None) == want


def test_states(spark):
    data = [(1, "2026-01-01T00:00:00Z", None), (2, "2026-10-25 02:30:00", "Europe/Berlin"), (3, "2026-03-29 02:30:00", "Europe/Berlin"), (4, "2026-07-01 12:00:00", "Europe/Berlin"), (5, "2026-07-01 12:00:00", None), (6, "2026-07-01 12:00:00", "Mars/Base"), (7, None, "UTC"), (8, "never", "UTC"), (9, "2026-01-01T00:00:00.50Z", "UTC"), (9, "2026-01-01T00:00:00.50Z", "UTC"), (10, "2026-07-01T12:00:00[Asia/Tokyo]", None)]
    got = {r["k"]: (r["status"], r["utc_us"], r["is_canonical"]) for r in normalise_times(spark.createDataFrame(data, "k int, zone string, status string").toDF("k", "v", "status"), ["k"], "v", "status").collect()}
    assert got[1] == ("instant", 1767225600000000, True) and got[4] == ("instant", 1782900000000000, False) and got[9] == ("instant", 1767225600500000, False) and got[10] == ("instant", 1782874800000000, False)
    assert [got[k][0] for k in (2, 3, 5, 6, 7, 8)] == ["ambiguous", "nonexistent", "no_zone", "no_zone", "no_instant", "no_instant"]
    assert len(got) == 10


def test_empty(spark):
    assert rows(normalise_times(spark.createDataFrame([], "k int, v string, z string"), ["k"], "v", "z")) == []


def test_intervals_touch_in_utc():
    spans = zone_intervals("America/New_York", 1704067200, 1798761600)
    assert len(spans) == 7 and all(a[1] - a[2] == b[0] - b[2] for a, b in zip(spans, spans[1:]))


def test_segments_are_disjoint():
    for zone in ("Europe/Berlin", "Australia/Lord_Howe", "UTC", "Pacific/Apia"):
        for year in (-50, 40, 41, 55, 56):
            found = year_segments(zone, year)
            assert found and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert any(o is None for _, _, o in year_segments("Europe/Berlin", 55))


def test_every_year_has_its_offset(spark):
    data = [(1, "1910-06-01 12:00:00", "Europe/Berlin"), (2, "2150-06-01 12:00:00", "Europe/Berlin"), (3, "0001-01-01 00:00:00", "UTC"), (4, "9999-12-31 23:59:59", "Asia/Tokyo"), (5, "1700-01-01 00:00:00", "Europe/Paris"), (6, "2150-03-29 02:30:00", "Europe/Berlin")]
    got = {r["k"]: (r["status"], r["utc_us"]) for r in normalise_times(spark.createDataFrame(data, "k int, v string, z string"), ["k"], "v", "z").collect()}
    of = lambda *at: int(dt.datetime(*at, tzinfo=zoneinfo.ZoneInfo("Europe/Berlin")).timestamp()) * 1_000_000
    assert got[1] == ("instant", of(1910, 6, 1, 12)) and got[2] == ("instant", of(2150, 6, 1, 12))
    assert got[3] == ("instant", -62135596800000000) and got[4] == ("instant", 253402268399000000) and got[5][0] == "instant" and got[6] == ("nonexistent", None)


def test_intervals_joined_by_shuffle_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(1, "2026-10-25 02:30:00", "Europe/Berlin"), (2, "2026-07-01 12:00:00", "Europe/Berlin")], "k int, v string, z string")
    want = rows(normalise_times(df, ["k"], "v", "z"))
    monkeypatch.setattr(clocks, "INTERVAL_BROADCAST_ROWS", 0)
    assert rows(normalise_times(df, ["k"], "v", "z")) == want
