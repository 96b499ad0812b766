"""Clock arithmetic on zone-free timestamps (exchange wall clock)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SessionSpec
from .columns import col


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


def second_of_day(ts: Column | str) -> Column:
    """Seconds since midnight with the fractional part, so inclusive limits are exact."""
    return minute_of_day(ts) * 60 + F.extract(F.lit("SECOND"), col(ts))


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of the wall clock, whatever the session zone is."""
    days = F.date_diff(F.to_date(col(ts)), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + minute_of_day(ts) * 60 + F.second(col(ts))


def in_order(ts: Column | str, sequence: Column | str) -> Column:
    """One number that orders rows by time, then by ``sequence`` (an integer; missing is first).

    A decimal has a fixed width, so ``min_by`` and ``max_by`` over it stay hash aggregates, which
    a struct of both columns would not.
    """
    micros = epoch_seconds(ts).cast("decimal(12,0)") * F.lit(10**6).cast("decimal(7,0)") + (
        F.extract(F.lit("SECOND"), col(ts)) % 1 * 10**6
    ).cast("decimal(7,0)")
    number = F.coalesce(col(sequence).cast("bigint"), F.lit(-(2**63))).cast("decimal(19,0)")
    return (micros.cast("decimal(18,0)") * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + number).cast("decimal(38,0)")


def bar_floor(ts: Column | str, width: str) -> Column:
    return F.window(col(ts), width).getField("start")


def session_open(ts: Column | str, spec: SessionSpec) -> Column:
    """Opening time of the session on the day of ``ts``."""
    midnight = F.to_date(col(ts)).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(mins=F.lit(spec.open_minute))


def minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def in_session(ts: Column | str, spec: SessionSpec) -> Column:
    """Inside the daily gate, both ends included; a missing time is outside."""
    s = second_of_day(ts)
    inside = (s >= F.lit(spec.gate_open * 60)) & (s <= F.lit(spec.gate_close * 60))
    return F.coalesce(inside, F.lit(False))


def wall_clock(ts: Column | str, zone: str, source_zone: str = "UTC") -> Column:
    """Zone-free time in ``zone`` for a zone-free time given in ``source_zone``."""
    return F.convert_timezone(F.lit(source_zone), F.lit(zone), col(ts))


def drop_zone(ts: Column | str, zone: str) -> Column:
    """Exchange wall clock of an instant (TIMESTAMP), without a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), col(ts).cast("timestamp_ntz"))


def parse_time(text: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.to_timestamp_ntz(col(text), F.lit(pattern))
