"""Time snapping, cycles, leads, calendar features, moon, model names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def snap_hour(ts: Column) -> Column:
    """Nearest hour; the half hour rounds up."""
    return F.date_trunc("hour", ts + F.expr("INTERVAL 30 MINUTES"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, ISO_Z)


def parse_iso(text: Column) -> Column:
    """Any ISO-8601 spelling (Z, offset, microseconds or none) to an instant.

    A spelling without an offset is read in the session zone, which is UTC.
    """
    return F.try_to_timestamp(F.trim(text))


def local_to_utc(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts, zone)


def cycle_of(ts: Column, step_hours: int = 12) -> Column:
    """Start of the latest model cycle at or before an instant."""
    day = F.date_trunc("day", ts)
    hours = F.floor(F.hour(ts) / F.lit(step_hours)) * step_hours
    return F.timestamp_seconds(F.unix_timestamp(day) + hours * 3600)


def cycle_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HH'Z'")


def parse_cycle_id(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HH'Z'"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def lead_hours(valid: Column, cycle: Column) -> Column:
    return F.rint(hours_between(valid, cycle)).cast("int")


def doy_sin(ts: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * F.dayofyear(ts) / F.lit(365.0))


def doy_cos(ts: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * F.dayofyear(ts) / F.lit(365.0))


def clock_label(ts: Column) -> Column:
    """12-hour label such as 5:49am."""
    return F.lower(F.date_format(ts, "h:mma"))


# Mean lunation in days and the epoch second of a new moon.
SYNODIC_DAYS = 29.530588853
NEW_MOON_EPOCH = 947182440.0
# Upper phase bound of each named phase, in order.
MOON_STEPS = ((0.03, "New"), (0.22, "Waxing crescent"), (0.28, "First quarter"),
              (0.47, "Waxing gibbous"), (0.53, "Full"), (0.72, "Waning gibbous"),
              (0.78, "Last quarter"))


def moon_phase(epoch_s: Column) -> Column:
    days = (epoch_s - F.lit(NEW_MOON_EPOCH)) / 86400.0
    return F.pmod(days, F.lit(SYNODIC_DAYS)) / SYNODIC_DAYS


def moon_label(phase: Column) -> Column:
    out = F.when(phase > 0.97, F.lit("New"))
    for bound, name in MOON_STEPS:
        out = out.when(phase < bound, F.lit(name))
    return out.otherwise(F.lit("Waning crescent"))


def is_spring_tide(phase: Column) -> Column:
    return (phase < 0.10) | (phase > 0.90) | ((phase > 0.40) & (phase < 0.60))


def model_name(arch: Column, trained: Column, coverage: Column, version: Column, prefix: str) -> Column:
    return F.format_string(f"{prefix}+%s_%s_%.2f_v%d", arch, F.date_format(trained, "yyMMdd"),
                           coverage, version)


def parse_model_name(name: Column, prefix: str) -> dict[str, Column]:
    """arch, training date, coverage and version; empty string where absent."""
    head = "^" + prefix + r"\+"
    return {
        "arch": F.when(name.rlike(head), F.regexp_extract(name, head + "([A-Za-z]+)", 1)).otherwise("?"),
        "date_yymmdd": F.regexp_extract(name, r"^[^_]*_(\d{6})(?:_|$)", 1),
        "coverage": F.regexp_extract(name, r"^[^_]*_\d{6}_([0-9.]+)", 1).try_cast("double"),
        "version": F.regexp_extract(name, r"_(v\d+)$", 1),
    }


# Limits of the look-back and look-ahead windows, in days.
DAYS_LIMIT = (1, 45)
PAST_DAYS_LIMIT = (0, 30)
MAX_SPAN_DAYS = 14


def clamp(c: Column, limits: tuple[int, int]) -> Column:
    lo, hi = limits
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def clamp_range(start: Column, end: Column, max_days: int = MAX_SPAN_DAYS) -> tuple[Column, Column]:
    """Dates in order and at most max_days apart."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    return lo, F.least(hi, F.date_add(lo, max_days))
