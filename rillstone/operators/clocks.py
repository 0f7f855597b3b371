"""Mixed timestamp formats and time zones, normalised to UTC (problem 6)."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.functions.instants import CANONICAL, read_time
from rillstone.runtime import materialise

_DAY = 86_400
_YEAR = 31_556_952
_YEAR_US = _YEAR * 1_000_000
#: The seconds that have a calendar date, in the years 1 to 9999.
_CALENDAR = (-62_135_596_800, 253_402_300_799)
INTERVAL_BROADCAST_ROWS = 50_000


def _offset(zone: dt.tzinfo, second: int) -> int:
    return int(dt.datetime.fromtimestamp(second, zone).utcoffset().total_seconds())


def zone_intervals(zone: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """``(local start, local end, offset)`` in seconds of the zone's constant offsets between two instants; local intervals overlap where clocks go
    back. The first and the last reach beyond the calendar where the instants do."""
    z = zoneinfo.ZoneInfo(zone)
    low_end, high_end = max(start, _CALENDAR[0] + _DAY), min(end, _CALENDAR[1] - _DAY)
    out, at, offset = [], start, _offset(z, low_end)
    for day in [*range(low_end + _DAY, high_end, _DAY), high_end]:
        if (new := _offset(z, day)) != offset:
            low, high = max(low_end, day - _DAY), day
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if _offset(z, mid) == offset else (low, mid)
            out.append((at + offset, high + offset, offset))
            at, offset = high, new
    return [*out, (at + offset, end + offset, offset)]


def year_segments(zone: str, local_year: int) -> list[tuple[int, int, int | None]]:
    """``(local start, local end, offset)`` of a zone's local times of a year, as disjoint segments: where two intervals overlap the offset is None, where
    none is there is no segment."""
    low, high = local_year * _YEAR, (local_year + 1) * _YEAR
    clipped = [(max(a, low), min(b, high), o) for a, b, o in zone_intervals(zone, low - 2 * _DAY, high + 2 * _DAY)]
    clipped = [x for x in clipped if x[0] < x[1]]
    cuts = sorted({c for a, b, _ in clipped for c in (a, b)})
    out: list[tuple[int, int, int | None]] = []
    for a, b in zip(cuts, cuts[1:]):
        offsets = {o for x, y, o in clipped if x <= a and b <= y}
        if offsets:
            out.append((a, b, offsets.pop() if len(offsets) == 1 else None))
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us = 1_000_000
    for batch in batches:
        rows = [
            (zone, year, a * us, b * us, None if o is None else o * us, o is None)
            for zone, year in zip(*(c.to_pylist() for c in batch.columns)) for a, b, o in year_segments(zone, year)
        ]
        types = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], names=["zone", "local_year", "local_start", "local_end", "offset_us", "twice"])


def interval_table(years: DataFrame) -> DataFrame:
    """``zone, local_year, local_start, local_end, offset_us, twice`` of the given ``zone, local_year``: the zones' offset intervals exploded by year, cut
    where they overlap. Only years that occur are worked out, by the executors."""
    return years.mapInArrow(_segments, "zone string, local_year bigint, local_start bigint, local_end bigint, offset_us bigint, twice boolean")


def _reader(names: list[str], value_at: int, zone_at: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canonical, kinds, micros, zones = [], [], [], []
            for text, origin in zip(batch.column(value_at).to_pylist(), batch.column(zone_at).to_pylist()):
                got = read_time(text)
                canonical.append(text is not None and CANONICAL.fullmatch(text) is not None)
                kinds.append(got[0] if got else None)
                micros.append(got[1] if got else None)
                zones.append((got[2] or (origin.strip() if origin else None)) if got and got[0] == "local" else None)
            extra = [pa.array(canonical, pa.bool_()), pa.array(kinds, pa.string()), pa.array(micros, pa.int64()), pa.array(zones, pa.string())]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i not in (value_at, zone_at)), *extra], names=names)

    return read


def normalise_times(values: DataFrame, keys: list[str], value: str, zone: str) -> DataFrame:
    """``keys..., is_canonical, utc_us, status`` for each row: status is ``instant``, ``ambiguous``, ``nonexistent``, ``no_zone`` or ``no_instant``.

    Values that name a zone or offset are placed directly. Local times of any year take an as-of join with the exploded zone-offset intervals of
    their zone and year: a segment of one interval gives the offset, one of two means ambiguous, none nonexistent. Nulls, blanks and unreadable
    values are ``no_instant``, unknown zones ``no_zone``. Repeated rows stay repeated; an empty input gives no rows.
    """
    chosen = values.select(*keys, F.col(value).alias("__value"), F.col(zone).alias("__zone"))
    names = [*keys, "is_canonical", "__kind", "__us", "zone"]
    kept = {f.name: f.dataType.simpleString() for f in chosen.schema}
    schema = ", ".join([f"`{k}` {kept[k]}" for k in keys] + ["is_canonical boolean, __kind string, __us bigint, zone string"])
    read = chosen.mapInArrow(_reader(names, len(keys), len(keys) + 1), schema)
    local_year = F.when(F.col("__kind") == "local", F.floor(F.col("__us") / F.lit(_YEAR_US)))
    read = materialise(read.withColumn("local_year", local_year), "times")
    known = sorted(zoneinfo.available_timezones())
    named = F.col("zone").isin(known)
    intervals = materialise(interval_table(read.filter(named & F.col("local_year").isNotNull()).select("zone", "local_year").distinct()), "intervals")
    small = intervals.limit(INTERVAL_BROADCAST_ROWS + 1).count() <= INTERVAL_BROADCAST_ROWS
    left, right = read.alias("v"), (F.broadcast(intervals) if small else intervals).alias("i")
    match = left.join(right, F.expr("v.zone = i.zone AND v.local_year = i.local_year AND v.__us >= i.local_start AND v.__us < i.local_end"), "left")
    kind = F.col("v.__kind")
    status = (
        F.when(kind.isNull(), "no_instant").when(kind == "utc", "instant").when(F.col("i.offset_us").isNotNull(), "instant").when(F.col("i.twice"), "ambiguous")
        .when(F.coalesce(F.col("v.zone").isin(known), F.lit(False)), "nonexistent").otherwise("no_zone")
    )
    utc = F.when(status == "instant", F.col("v.__us") - F.when(kind == "local", F.col("i.offset_us")).otherwise(F.lit(0)))
    return match.select(*[F.col(f"v.{k}").alias(k) for k in keys], F.col("v.is_canonical").alias("is_canonical"), utc.alias("utc_us"), status.alias("status"))
