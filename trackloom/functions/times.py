"""Time texts of many spellings, as column expressions; results are naive UTC timestamps.

Accepted after normalisation: Unix seconds, milliseconds or microseconds (not of 8, 12 or 14 digits); ``yyyyMMdd[T -]HHmmss[.f][+hh:mm]``; ISO dates and
times to seconds or fractions, with or without an offset; the same without seconds. Text without an offset is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let
from .text import narrow

#: Fixed names of fields that hold a time, a date, or a time of day.
TIME_FIELDS = (
    "time", "timestamp", "datetime", "date_time", "gps_time", "gpstime", "utc_time", "utctime", "utc", "jst", "recorded_at", "created_at", "capture_time",
    "日時", "日付時刻", "撮影日時",
)
DATE_FIELDS = ("date", "gps_date", "gpsdate", "day", "ymd", "capture_date", "日付", "撮影日")
CLOCK_FIELDS = ("time", "clock", "hms", "gps_time", "gpstime", "capture_clock", "時刻", "撮影時刻")
EPOCH_MICROS, EPOCH_MILLIS = 1e13, 1e10
#: The grammar of a time text, in pieces. Both spellings have a group for each of PARTS; ``between`` is what is between day and clock, ``blanks`` what is before the zone.
QUOTES, FRACTION, ZONE = "[\"']*", r"(?:[.,](\d+))?", r"(\s*)(Z|(?i:JST|UTC|GMT)|[+-]\d{2}(?::?\d{2})?)?"
SPELT_DAY = r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?"
SPELT_CLOCK = rf"([T\s_]*)(\d{{1,2}})[:時](\d{{1,2}})(?:[:分](?:(\d{{1,2}}){FRACTION}秒?)?)?"
SPELT = rf"^{QUOTES}{SPELT_DAY}(?:{SPELT_CLOCK})?{ZONE}{QUOTES}$"
CLOSE = rf"^{QUOTES}(\d{{4}})(\d{{2}})(\d{{2}})([T\s_-]?)(\d{{2}})(\d{{2}})(\d{{2}}){FRACTION}{ZONE}{QUOTES}$"
PARTS = ("year", "month", "day", "between", "hour", "minute", "second", "fraction", "blanks", "zone")
#: What a text needs to be worth reading: a day with separators anywhere in it, or nothing but a day, a day and a clock, or an epoch in seconds or milliseconds.
LIKELY = r"\d{4}(?:[-/]\d{1,2}){2}|^(?:\d{8}(?:[T _-]?\d{6}(?:\.\d+)?)?|\d{10}(?:\d{3})?)$"


def clean(x: Column) -> Column:
    return F.nullif(F.trim(narrow(x)), F.lit(""))


def bare(text: Column) -> Column:
    """A text without quotes around it and with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"^{QUOTES}|{QUOTES}$", ""), r"\s+", " "))


def parts(text: Column) -> Column:
    """PARTS and text: the groups of whichever spelling fits; null where neither does or a group is empty."""
    group = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(text, grammar, k), F.lit("")) for grammar in (SPELT, CLOSE)])
    return F.struct(*[group(k).alias(name) for k, name in enumerate(PARTS, start=1)], text.alias("text"))


def offset(zone: Column) -> Column:
    """A zone as +hh:mm; null without one."""
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    written = F.concat(F.left(zone, F.lit(1)), F.left(digits, F.lit(2)), F.lit(":"), F.right(digits, F.lit(2)))
    return F.when(F.upper(zone) == "JST", "+09:00").when(F.upper(zone).isin("Z", "UTC", "GMT"), "+00:00").otherwise(written)


def normalize(x: Column) -> Column:
    """A time text spelt as y-m-d h:m:s.f +hh:mm, as far as it says so, its numbers and its T or blank as they were; any other text without quotes and repeated blanks."""

    def spelt(p: Column) -> Column:
        between = F.when(p["hour"].isNull(), "").when(F.contains(p["between"], F.lit("T")), "T").otherwise(" ")
        zone = F.concat(F.when(p["blanks"].isNotNull(), " ").otherwise(""), offset(p["zone"]))
        said = [F.concat_ws("-", p["year"], p["month"], p["day"]), between, F.concat_ws(":", p["hour"], p["minute"], p["second"]), F.concat(F.lit("."), p["fraction"]), zone]
        return F.when(p["year"].isNotNull(), F.concat(*[F.coalesce(c, F.lit("")) for c in said])).otherwise(bare(p["text"]))

    return let(clean(x), lambda text: let(parts(text), spelt))


def parse_epoch(text: Column) -> Column:
    """A number of seconds, or of milliseconds or microseconds by its size."""
    number = F.when(text.rlike(r"^\d+(\.\d+)?$") & ~text.rlike(r"^(\d{8}|\d{12}|\d{14})$"), text.try_cast("double"))
    seconds = F.when(number > EPOCH_MICROS, number / 1e6).when(number > EPOCH_MILLIS, number / 1e3).otherwise(number)
    return F.when(seconds < 253_402_300_800.0, F.timestamp_micros(F.rint(seconds * 1e6).cast("bigint")).cast("timestamp_ntz"))


def parse(x: Column) -> Column:
    """The time that a text tells, as timestamp_ntz in UTC; null if none."""
    zero = F.lit("0")

    def minutes(zone: Column) -> Column:
        size = F.substring(zone, 2, 2).cast("bigint") * 60 + F.substring(zone, 5, 2).cast("bigint")
        return F.when(zone.isNull(), 0).when(F.left(zone, F.lit(1)) == "-", -size).otherwise(size)

    def told(p: Column) -> Column:
        whole = F.concat(F.concat_ws("-", p["year"], p["month"], p["day"]), F.lit(" "), F.concat_ws(":", *[F.coalesce(p[k], zero) for k in ("hour", "minute", "second")]))
        micros = F.rpad(F.left(F.coalesce(p["fraction"], zero), F.lit(6)), 6, "0").cast("bigint")
        base = F.unix_micros(F.try_to_timestamp(F.when(p["year"].isNotNull(), whole), F.lit("y-M-d H:m:s")))
        time = F.timestamp_micros(base + micros - let(offset(p["zone"]), minutes) * 60_000_000).cast("timestamp_ntz")
        return F.coalesce(let(bare(p["text"]), parse_epoch), time)

    return let(clean(x), lambda text: let(parts(text), told))


def looks_like(x: Column) -> Column:
    return F.coalesce(clean(x).rlike(LIKELY), F.lit(False))


def to_layer(ts: Column) -> Column:
    """A time as tables keep it: whole milliseconds, without a zone."""
    return F.date_trunc("MILLISECOND", ts).cast("timestamp_ntz")
