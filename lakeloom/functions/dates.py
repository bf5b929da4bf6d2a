"""Date and time functions with PostgreSQL semantics. Timestamps are without zone unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC (the session zone)."""
    return F.unix_micros(t.cast("timestamp"))


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n).cast(NTZ)


def date_trunc(field: str, t: Column) -> Column:
    """Also decade, century and millennium; the last two begin with the years xx01 and x001."""
    field = field.lower()
    if field in ("microseconds", "microsecond"):
        return t.cast(NTZ)
    span = {"decade": 10, "century": 100, "millennium": 1000}.get(field)
    if span is None:
        return F.date_trunc({"milliseconds": "millisecond"}.get(field, field), t).cast(NTZ)
    y, start = F.year(t), 0 if span == 10 else 1
    return F.make_timestamp_ntz((F.floor((y - start) / span) * span + start).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def date_bin(stride_micros: int, t: Column, origin: Column) -> Column:
    """The start of the bin of the given width, counted from ``origin``, that holds t."""
    if stride_micros <= 0:
        raise ValueError("stride must be greater than zero")
    o = micros(origin)
    return from_micros(o + F.floor((micros(t) - o) / F.lit(stride_micros)).cast("bigint") * F.lit(stride_micros))


def extract(field: str, t: Column) -> Column:
    """``EXTRACT(field FROM t)`` of a date or timestamp, as a double."""
    f = field.lower()
    y, us = F.year(t), micros(t)
    out = {
        "year": lambda: y, "month": lambda: F.month(t), "day": lambda: F.dayofmonth(t), "hour": lambda: F.hour(t), "minute": lambda: F.minute(t),
        "quarter": lambda: F.quarter(t), "week": lambda: F.weekofyear(t), "doy": lambda: F.dayofyear(t), "dow": lambda: F.dayofweek(t) - 1, "isodow": lambda: F.weekday(t) + 1,
        "isoyear": lambda: F.date_part(F.lit("YEAROFWEEK"), t), "decade": lambda: F.floor(y / 10), "century": lambda: F.ceil(y / 100), "millennium": lambda: F.ceil(y / 1000),
        "epoch": lambda: us / 1e6, "second": lambda: F.pmod(us, F.lit(60_000_000)) / 1e6, "milliseconds": lambda: F.pmod(us, F.lit(60_000_000)) / 1e3, "microseconds": lambda: F.pmod(us, F.lit(60_000_000)),
        "julian": lambda: us / 86_400e6 + 2_440_588,
    }
    return out[f]().cast("double")


def to_date_epoch(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(days).cast("int"))


def to_timestamp_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def generate_series(start: Column, stop: Column, step: Column | None = None) -> Column:
    """One row per step; no row, not an error, where the step leads away from ``stop``. A zero step raises."""
    if step is None:
        return F.explode(F.when(start <= stop, F.sequence(start, stop)).otherwise(F.slice(F.sequence(start, start), 1, 0)))
    fits = ((step > 0) & (start <= stop)) | ((step < 0) & (start >= stop))
    seq = F.when(fits, F.sequence(start, stop, F.when(fits, step).otherwise(F.lit(1)))).otherwise(F.slice(F.sequence(start, start), 1, 0))
    return F.explode(F.when(step == 0, F.raise_error(F.lit("step size cannot equal zero"))).otherwise(seq))


def generate_series_ts(start: Column, stop: Column, months: int = 0, days: int = 0, us: int = 0) -> Column:
    """A series of timestamps by a constant interval."""
    step = F.expr(f"make_interval(0, {months}, 0, {days}, 0, 0, {us / 1e6:f})") if months or (days and us) else F.expr(f"make_dt_interval({days}, 0, 0, {us / 1e6:f})")
    forward = months * 30 * 86_400e6 + days * 86_400e6 + us > 0
    return F.explode(F.when((start <= stop) if forward else (start >= stop), F.sequence(start, stop, step)).otherwise(F.slice(F.array(start), 1, 0)))


def interval(months: Column | int = 0, days: Column | int = 0, us: Column | int = 0) -> Column:
    """An interval as it is stored: struct of months, days and microseconds."""
    lit = lambda x, t: (F.lit(x) if isinstance(x, int) else x).cast(t)
    return F.struct(lit(months, "int").alias("months"), lit(days, "int").alias("days"), lit(us, "bigint").alias("microseconds"))


def interval_key(i: Column) -> Column:
    """A number that orders intervals: a month has 30 days, a day 24 hours."""
    return (i["months"].cast("decimal(38,0)") * 30 + i["days"]) * F.lit(86_400_000_000) + i["microseconds"]


def add_interval(t: Column, i: Column) -> Column:
    """Timestamp plus interval: months first, clamped to the month's end, then days, then the rest."""
    moved = F.make_timestamp_ntz(F.year(s := F.add_months(t, i["months"])), F.month(s), F.dayofmonth(s), F.hour(t), F.minute(t), F.second(t))
    rest = F.pmod(micros(t), F.lit(1_000_000))
    return from_micros(micros(moved) + rest + i["days"].cast("bigint") * 86_400_000_000 + i["microseconds"])


def subtract_timestamps(a: Column, b: Column) -> Column:
    """Timestamp minus timestamp: days and microseconds, no months."""
    d = micros(a) - micros(b)
    days = F.when(d >= 0, F.floor(d / 86_400_000_000)).otherwise(F.ceil(d / 86_400_000_000))
    return interval(0, days, d - days.cast("bigint") * 86_400_000_000)


def extract_interval(field: str, i: Column) -> Column:
    """``EXTRACT(field FROM interval)``; a year has 365.25 days in ``epoch``, a month beyond whole years 30."""
    m, d, us = i["months"], i["days"], i["microseconds"]
    part = lambda x, y: F.when(x >= 0, F.floor(x / y)).otherwise(F.ceil(x / y))
    out = {
        "millennium": lambda: part(m, 12_000), "century": lambda: part(m, 1_200), "decade": lambda: part(m, 120), "year": lambda: part(m, 12), "month": lambda: m % 12, "quarter": lambda: part(m % 12, 3) + 1, "day": lambda: d,
        "hour": lambda: part(us, 3_600_000_000), "minute": lambda: part(us % 3_600_000_000, 60_000_000), "second": lambda: us % 60_000_000 / 1e6, "milliseconds": lambda: us % 60_000_000 / 1e3, "microseconds": lambda: us % 60_000_000,
        "epoch": lambda: part(m, 12) * 31_557_600 + (m % 12) * 2_592_000 + d * 86_400 + us / 1e6,
    }
    return out[field.lower()]().cast("double")


def date_trunc_interval(field: str, i: Column) -> Column:
    """``date_trunc(field, interval)``: smaller parts become zero."""
    m, d, us = i["months"], i["days"], i["microseconds"]
    f = field.lower()
    months = {"millennium": 12_000, "century": 1_200, "decade": 120, "year": 12, "quarter": 3, "month": 1}
    if f in months:
        return interval(m - m % months[f], 0, 0)
    small = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "milliseconds": 1_000, "microseconds": 1}
    return interval(m, d, 0) if f == "day" else interval(m, d, us - us % small[f])


def time_of_day(t: Column) -> Column:
    """The time of a timestamp as text with microseconds; times with a zone are kept in UTC, the session's zone."""
    return F.date_format(t, "HH:mm:ss.SSSSSS")


def time_in_utc(local: Column, offset_minutes: Column) -> Column:
    """A time with a zone (text and minutes east of UTC) as the UTC time of day."""
    us = F.unix_micros(F.to_timestamp(F.concat(F.lit("1970-01-01 "), local))) - offset_minutes.cast("bigint") * 60_000_000
    return time_of_day(F.timestamp_micros(F.pmod(us, F.lit(86_400_000_000))))


# to_char ---------------------------------------------------------------------------

# Template patterns, longest first where one begins another.
_PATTERNS = (
    "Y,YYY", "HH24", "HH12", "IYYY", "SSSSS", "SSSS", "YYYY", "MONTH", "Month", "month", "A.M.", "P.M.", "a.m.", "p.m.", "B.C.", "A.D.", "b.c.", "a.d.",
    "FF1", "FF2", "FF3", "FF4", "FF5", "FF6", "YYY", "IYY", "DDD", "DAY", "Day", "day", "MON", "Mon", "mon", "TZH", "TZM", "HH", "MI", "SS", "MS", "US",
    "AM", "PM", "am", "pm", "YY", "IY", "MM", "DD", "DY", "Dy", "dy", "ID", "IW", "WW", "CC", "BC", "AD", "bc", "ad", "OF", "Y", "I", "D", "W", "Q",
)
_UNSUPPORTED = ("IDDD", "J", "RM", "rm", "TZ", "tz", "FX", "TM", "SP")


def _padded(n: Column, width: int, fill: bool) -> Column:
    s = n.cast("bigint").cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s) if fill else s


def _suffix(n: Column, upper: bool) -> Column:
    """st, nd, rd or th; 11 to 13 take th, larger numbers that end so do not."""
    n = n.cast("bigint")
    s = F.when(n.between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.upper(s) if upper else s


def _half(t: Column, am: str, pm: str) -> Column:
    return F.when(F.hour(t) < 12, am).otherwise(pm)


def _name(t: Column, pattern: str, key: str, width: int, fill: bool) -> Column:
    s = F.date_format(t, pattern)
    s = F.upper(s) if key.isupper() else F.lower(s) if key.islower() else s
    return F.rpad(s, width, " ") if fill and width else s


def _field(t: Column, key: str, fill: bool) -> tuple[Column, Column | None]:
    """Text of one pattern, and its number where a suffix may follow."""
    ex = lambda f: extract(f, t).cast("bigint")
    rest = F.pmod(micros(t), F.lit(1_000_000))
    numbers = {
        "HH24": (F.hour(t), 2), "HH12": ((F.hour(t) + 11) % 12 + 1, 2), "HH": ((F.hour(t) + 11) % 12 + 1, 2), "MI": (F.minute(t), 2), "SS": (F.second(t), 2),
        "MS": (F.floor(rest / 1000), 3), "US": (rest, 6), "SSSSS": (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t), 1), "SSSS": (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t), 1),
        "YYYY": (F.year(t), 4), "YYY": (F.year(t) % 1000, 3), "YY": (F.year(t) % 100, 2), "Y": (F.year(t) % 10, 1),
        "IYYY": (ex("isoyear"), 4), "IYY": (ex("isoyear") % 1000, 3), "IY": (ex("isoyear") % 100, 2), "I": (ex("isoyear") % 10, 1),
        "MM": (F.month(t), 2), "DDD": (F.dayofyear(t), 3), "DD": (F.dayofmonth(t), 2), "D": (F.dayofweek(t), 1), "ID": (F.weekday(t) + 1, 1),
        "IW": (F.weekofyear(t), 2), "WW": (F.floor((F.dayofyear(t) - 1) / 7) + 1, 2), "W": (F.floor((F.dayofmonth(t) - 1) / 7) + 1, 1), "Q": (F.quarter(t), 1), "CC": (ex("century"), 2),
    } | {f"FF{n}": (F.floor(rest / 10 ** (6 - n)), n) for n in range(1, 7)}
    if key in numbers:
        n, width = numbers[key]
        fixed = key in ("MS", "US") or key.startswith("FF")
        return _padded(n, width, fill or fixed), n
    if key == "Y,YYY":
        return F.concat(F.floor(F.year(t) / 1000).cast("string"), F.lit(","), F.lpad((F.year(t) % 1000).cast("string"), 3, "0")), F.year(t)
    if key.upper() == "MONTH":
        return _name(t, "MMMM", key, 9, fill), None
    if key.upper() == "DAY":
        return _name(t, "EEEE", key, 9, fill), None
    if key.upper() == "MON":
        return _name(t, "MMM", key, 0, fill), None
    if key.upper() == "DY":
        return _name(t, "EEE", key, 0, fill), None
    if key in ("AM", "PM", "am", "pm", "A.M.", "P.M.", "a.m.", "p.m."):
        am, pm = ("A.M.", "P.M.") if "." in key else ("AM", "PM")
        return _half(t, *((am, pm) if key.isupper() else (am.lower(), pm.lower()))), None
    if key.upper().replace(".", "") in ("BC", "AD"):
        ad, bc = ("A.D.", "B.C.") if "." in key else ("AD", "BC")
        return F.when(F.year(t) > 0, ad if key.isupper() else ad.lower()).otherwise(bc if key.isupper() else bc.lower()), None
    zone = {"TZH": "+00", "TZM": "00", "OF": "+00"}  # the session runs in UTC
    return F.lit(zone[key]), None


def to_char(t: Column, template: str) -> Column:
    """``to_char(timestamp, template)``; text in double quotes is literal, FM drops padding, TH and th add an ordinal suffix."""
    out: list[Column] = []
    i, fill = 0, True
    while i < len(template):
        if template[i] == '"':
            end = template.find('"', i + 1)
            end = len(template) if end < 0 else end
            out.append(F.lit(template[i + 1 : end]))
            i = end + 1
            continue
        if template.startswith("FM", i) or template.startswith("fm", i):
            fill, i = False, i + 2
            continue
        if bad := next((p for p in _UNSUPPORTED if template.startswith(p, i) and not template.startswith(("TZH", "TZM"), i)), None):
            raise NotImplementedError(f"to_char pattern {bad}")
        key = next((p for p in _PATTERNS if template.startswith(p, i)), None)
        if key is None and re.match("[a-z]", template[i]):  # numeric patterns work in lower case, too
            key = next((p for p in _PATTERNS if template[i:].upper().startswith(p) and p.isupper()), None)
        if key is None:
            out.append(F.lit(template[i]))
            i += 1
            continue
        text, number = _field(t, key, fill)
        out.append(text)
        i, fill = i + len(key), True
        if number is not None and template[i : i + 2] in ("TH", "th"):
            out.append(_suffix(number, template[i] == "T"))
            i += 2
    return F.concat(*out) if out else F.lit("")
