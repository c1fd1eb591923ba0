"""Calendar expressions. Weeks begin on Monday; a null date gives the stated default, else null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weekday names from Monday on, and the text for no date.
WEEKDAYS = ["星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日"]
UNKNOWN_WEEKDAY = "未知"
DAY, SECOND = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"
#: The written forms. The last is the time at UTC+8 with a Z that is only a letter.
FORMATS = {
    "date": DAY,
    "hour": "yyyy-MM-dd HH",
    "minute": "yyyy-MM-dd HH:mm",
    "second": SECOND,
    "millisecond": "yyyy-MM-dd HH:mm:ss:SSS",
    "no_date": "yyyyMMdd",
    "no_hour": "yyyyMMddHH",
    "no_minute": "yyyyMMddHHmm",
    "no_second": "yyyyMMddHHmmss",
    "no_millisecond": "yyyyMMddHHmmssSSS",
    "utc": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
}
UNITS = {"year": "years", "month": "months", "week": "weeks", "day": "days", "hour": "hours", "minute": "mins", "second": "secs"}


def int_day(t: Column) -> Column:
    """yyyyMMdd as a number, 0 for null."""
    return F.coalesce(F.date_format(t, "yyyyMMdd").cast("int"), F.lit(0))


def long_second(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "yyyyMMddHHmmss").cast("bigint"), F.lit(0))


def long_milli(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "yyyyMMddHHmmssSSS").cast("bigint"), F.lit(0))


def day_start(t: Column) -> Column:
    return F.date_trunc("day", t)


def day_end(t: Column) -> Column:
    """The last millisecond of the day."""
    return F.date_trunc("day", t) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 0.001 SECOND")


def weekday_no(t: Column) -> Column:
    """1 for Monday to 7 for Sunday, 0 for null."""
    return F.coalesce(F.weekday(t) + 1, F.lit(0))


def weekday_name(t: Column) -> Column:
    return F.coalesce(F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(t) + 1), F.lit(UNKNOWN_WEEKDAY))


def week_of_year(t: Column) -> Column:
    """The how-many-eth seven days of the year, not the ISO week; -1 for null."""
    return F.coalesce(F.ceil(F.dayofyear(t) / 7).cast("int"), F.lit(-1))


def full_week_of_year(t: Column) -> Column:
    """The same less one, unless the year begins on a Monday."""
    monday = F.weekday(F.trunc(t, "year")) == 0
    return F.coalesce(F.ceil(F.dayofyear(t) / 7).cast("int") - F.when(monday, 0).otherwise(1), F.lit(-1))


def weekday_of_same_week(t: Column, n: Column) -> Column:
    """The n-th day of the week t is in; null unless n is 1 to 7."""
    return F.when(n.between(1, 7), F.date_add(t.cast("date"), n - F.weekday(t) - 1))


def week_end(t: Column) -> Column:
    """The Sunday of the week."""
    return F.date_add(t.cast("date"), 6 - F.weekday(t))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds between two times whatever their order, -1 if one is null."""
    millis = F.abs(F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp")))
    return F.coalesce(F.floor(millis / 1000).cast("bigint"), F.lit(-1).cast("bigint"))


def days_between(a: Column, b: Column) -> Column:
    """All days from the first to the second. With both ends on one day that day stands twice, once for each end."""
    return F.when(a == b, F.array(a, b)).when(a < b, F.sequence(a, b)).otherwise(F.array().cast("array<date>"))


def lenient_time(text: Column) -> Column:
    """Epoch milliseconds or one of five written forms; blank and anything else gives null."""
    t = F.trim(text)
    forms = [(r"^\d{4}-\d{1,2}$", "yyyy-M"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"), (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"), (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy/M/d H:m:s")]
    out = F.when(t.rlike(r"^-?\d{5,18}$"), F.timestamp_millis(F.expr("try_cast(0 as bigint)") + t.try_cast("bigint")))
    for pattern, form in forms:
        out = out.when(t.rlike(pattern), F.try_to_timestamp(t, F.lit(form)))
    return out


def utc_plus_8(t: Column) -> Column:
    return F.from_utc_timestamp(t, "GMT+8")


def formatted(t: Column, style: str) -> Column:
    """A time in one of FORMATS; empty for null."""
    return F.coalesce(F.date_format(utc_plus_8(t) if style == "utc" else t, FORMATS[style]), F.lit(""))


def node(t: Column) -> Column:
    """A time and its parts as one struct; null for null."""
    millis = F.unix_millis(t)
    parts = {
        "time": formatted(t, "millisecond"), "year": F.year(t), "month": F.month(t), "day": F.day(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t), "millisecond": F.pmod(millis, F.lit(1000)).cast("int"),
        "week": weekday_name(t), "day_of_year": F.dayofyear(t), "week_of_year": week_of_year(t), "week_of_year_ignore_last_year": full_week_of_year(t), "millisecond_stamp": millis, "second_stamp": F.floor(millis / 1000).cast("bigint"),
    }
    return F.when(t.isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))


def added(t: Column, unit: str, n: int) -> Column:
    """The time moved by n years, months, weeks, days, hours, minutes, seconds or milliseconds; a day that a month lacks
    becomes its last."""
    if unit == "millisecond":
        return t + F.make_interval(secs=F.lit(n / 1000))
    return t + F.make_interval(**{UNITS[unit]: F.lit(n)})


def by_pattern(text: Column, pattern: str, default: str = "1970-01-01") -> Column:
    """The time a text gives by a pattern; the default day for no text."""
    return F.coalesce(F.to_timestamp(text, pattern), F.when(text.isNull(), F.to_timestamp(F.lit(default), DAY)))
