"""Week ids, half-hour slots and month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
SLOTS = 7 * 48


def iso_year(ts: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), ts).cast("int")


def week_id(ts: Column) -> Column:
    """ISO week as YYYY-WW; the year is the week's own (30 December 2024 is in 2025-01)."""
    return F.format_string("%04d-%02d", iso_year(ts), F.weekofyear(ts))


def monday_of(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def monday_of_week(week: Column) -> Column:
    """The Monday of a YYYY-WW week: 4 January is always in week 1."""
    year, number = F.split_part(week, F.lit("-"), F.lit(1)).cast("int"), F.split_part(week, F.lit("-"), F.lit(2)).cast("int")
    return F.date_add(monday_of(F.make_date(year, F.lit(1), F.lit(4))), (number - 1) * 7)


def week_distance(a: Column, b: Column) -> Column:
    return F.abs(F.date_diff(monday_of_week(a), monday_of_week(b)) / 7).cast("int")


def week_expiry(week: Column) -> Column:
    """The last millisecond of the week's Sunday."""
    return monday_of_week(week).cast("timestamp") + F.expr("INTERVAL '6 23:59:59.999' DAY TO SECOND")


def slot_number(ts: Column) -> Column:
    """Half hours since Monday 00:00."""
    return (F.weekday(ts) * 48 + F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)).cast("int")


def slot_id(number: Column) -> Column:
    """ddd_HHMM of a slot number; null outside the week."""
    day = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.floor(number / 48).cast("int") + 1)
    half = F.pmod(number, F.lit(48))
    return F.when(number.between(0, SLOTS - 1), F.format_string("%s_%02d%02d", day, F.floor(half / 2).cast("int"), (half % 2 * 30).cast("int")))


def slot_number_of(slot: Column) -> Column:
    """The number of a ddd_HHMM slot; null if it isn't one."""
    valid = slot.rlike(f"^({'|'.join(DAYS)})_([01][0-9]|2[0-3])(00|30)$")
    day = F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.substring(slot, 1, 3)) - 1
    time = day * 48 + F.substring(slot, 5, 2).try_cast("int") * 2 + F.floor(F.substring(slot, 7, 2).try_cast("int") / 30)
    return F.when(valid, time.cast("int"))


def neighbours(number: Column) -> Column:
    """The slot with the one before and the one after; no wrap over the ends of the week."""
    return F.filter(F.array(number - 1, number, number + 1), lambda n: (n >= 0) & (n < SLOTS))


def shifted(number: Column, hours: float) -> Column:
    """The slot a fixed number of hours later, wrapping round the week."""
    return F.pmod(number + int(hours * 2), F.lit(SLOTS))


def zoned(ts: Column, zone: str) -> Column:
    """Wall time in a zone with its daylight saving, of a UTC time."""
    return F.from_utc_timestamp(ts, zone)


def months_before(ts: Column, months: int) -> Column:
    """The same day some months earlier, overflowing into the next month where that has no such day (31 May - 3 is 3 March)."""
    first = F.add_months(F.trunc(ts, "MM"), -months)
    return F.date_add(first, F.dayofmonth(ts) - 1)


def instant_of(week: Column, slot: Column) -> Column:
    """The UTC time of a ddd_HHMM slot in a YYYY-WW week."""
    return F.timestamp_seconds(F.unix_timestamp(monday_of_week(week).cast("timestamp")) + slot_number_of(slot) * 1800)


def with_offset(text: Column) -> Column:
    """The time of ``yyyy-MM-dd HH:mm:ss +hhmm``; null if it isn't one."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z"))


def duration_or(seconds: Column, default: float) -> Column:
    """seconds, or the default where they are missing or not positive."""
    return F.when(seconds > 0, seconds).otherwise(F.lit(default))


def visible(base: Column, hidden: Column, extra: Column) -> Column:
    """Slot numbers without the hidden and with the extra ones, in order."""
    return F.array_sort(F.array_union(F.array_except(base, hidden), extra))
