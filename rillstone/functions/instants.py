"""Reading of free-form timestamps."""

from __future__ import annotations

import datetime as dt
import re

_EPOCH = dt.datetime(1970, 1, 1)

PROFILE = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):([0-5]\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)", re.ASCII)
CANONICAL = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:[0-5]\d(\.\d*[1-9])?Z", re.ASCII)

# Offsets in minutes that zone abbreviations name.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "IST": 330, "JST": 540, "KST": 540, "SGT": 480, "HKT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_ZONE = r"(?:\s*(?P<zone>[Zz]|[+-]\d\d(?::?\d\d)?|[A-Za-z]{2,5}))?(?:\s*\[(?P<name>[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
_CLOCK = r"(?P<h>\d\d):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?"
_FORMS = [
    re.compile(p, re.ASCII)
    for p in (
        rf"(?P<y>\d{{4}})-(?P<mo>\d\d)-(?P<d>\d\d)(?:[Tt]|\s+){_CLOCK}{_ZONE}",
        rf"(?P<y>\d{{4}})(?P<mo>\d\d)(?P<d>\d\d)[Tt](?P<h>\d\d)(?P<mi>\d\d)(?:(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?{_ZONE}",
        rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<d>\d{{1,2}})[\s-](?P<mon>[A-Za-z]{{3,9}})[\s-](?P<y>\d{{4}}),?\s+(?P<h>\d{{1,2}}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?{_ZONE}",
        rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+(?:at\s+)?(?P<h>\d{{1,2}}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?{_ZONE}",
        rf"(?P<d>\d{{1,2}})/(?P<mo>\d{{1,2}})/(?P<y>\d{{4}}),?\s+(?P<h>\d{{1,2}}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?{_ZONE}",
        rf"(?P<y>\d{{4}})/(?P<mo>\d\d)/(?P<d>\d\d)\s+{_CLOCK}{_ZONE}",
    )
]
_NUMBER = re.compile(r"([+-]?)(\d{9,17})(?:\.(\d+))?", re.ASCII)
_BLANK = re.compile(r"[\s\u00a0\u202f]+")


def in_profile(value: object) -> bool:
    """Whether ``value`` is a string inside the strict RFC 3339 profile and in the calendar's range."""
    return isinstance(value, str) and canonical_instant(value) is not None


def canonical_instant(value: str) -> str | None:
    """Canonical UTC text of a profile timestamp, with all its digits, else None."""
    m = PROFILE.fullmatch(value)
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups()[:6])
    try:
        at = dt.datetime(y, mo, d, h, mi, s)
        z = m[8]
        if z not in "Zz":
            oh, om = int(z[1:3]), int(z[4:6])
            if oh > 23 or om > 59:
                return None
            shift = dt.timedelta(hours=oh, minutes=om)
            at = at - shift if z[0] == "+" else at + shift
    except (ValueError, OverflowError):
        return None
    frac = (m[7] or "")[1:].rstrip("0")
    return f"{at.year:04d}-{at.month:02d}-{at.day:02d}T{at.hour:02d}:{at.minute:02d}:{at.second:02d}{'.' + frac if frac else ''}Z"


def read_time(value: str | None) -> tuple[str, int, str | None] | None:
    """``("utc", microseconds, None)``, or ``("local", microseconds of the wall clock, zone name or None)``, or None.

    None stands for values that name no instant: dates alone, week dates, second 60, hour 24, impossible dates, words, blanks.
    """
    if value is None:
        return None
    text = value.strip(" \t\r\n\u00a0\u202f\u3000")
    if not text:
        return None
    if m := _NUMBER.fullmatch(text):
        n, frac = int(m[2]), (m[3] or "")
        power = 6 if n < 10**11 else 3 if n < 10**14 else 0
        us = n * 10**power + int((frac + "0" * 6)[:power] or 0)
        return ("utc", -us if m[1] == "-" else us, None)
    if not text.isascii():
        text = _BLANK.sub(" ", text)
    for form in _FORMS:
        m = form.fullmatch(text)
        if m:
            break
    else:
        return None
    g = m.groupdict()
    hour, minute, second = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"] in "Pp" else 0)
    month = int(g["mo"]) if g.get("mo") else _MONTHS.get(g["mon"][:3].lower())
    if month is None:
        return None
    try:
        at = dt.datetime(int(g["y"]), month, int(g["d"]), hour, minute, second)
    except ValueError:
        return None
    micros = (at - _EPOCH) // dt.timedelta(microseconds=1) + int(((g["f"] or "") + "000000")[:6])
    zone = g["zone"]
    if zone is None:
        return ("local", micros, g["name"])
    if zone[0] in "+-":
        digits = zone[1:].replace(":", "")
        oh, om = int(digits[:2]), int(digits[2:] or 0)
        if oh > 23 or om > 59:
            return None
        minutes = (oh * 60 + om) * (1 if zone[0] == "+" else -1)
    else:
        minutes = ABBREVIATIONS.get(zone.upper())
        if minutes is None:
            return None
    return ("utc", micros - minutes * 60_000_000, None)
