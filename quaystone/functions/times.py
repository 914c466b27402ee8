"""Spans, expiry and dates. Times are TIMESTAMP_NTZ in UTC; unset is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# Seconds of the span units.
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": DAY, "w": 7 * DAY}


def span_seconds(text: Column) -> Column:
    """Seconds of ``72h``, ``1h30m``, ``7d`` or ``2w``; null if malformed or not above zero.

    Compound spans take h, m, s and ms with fractions; d and w stand alone with a whole number, and so do
    upper-case units.
    """
    compound = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)(ms|h|m|s)"), F.lit(0))
    unit = lambda p: F.regexp_extract(p, "[a-z]+$", 0)
    seconds = F.aggregate(
        compound,
        F.lit(0.0),
        lambda a, p: a + F.regexp_extract(p, "^[0-9.]+", 0).cast("double") * F.when(unit(p) == "h", 3600.0).when(unit(p) == "m", 60.0).when(unit(p) == "s", 1.0).otherwise(0.001),
    )
    n = F.regexp_extract(text, "^[0-9]+", 0).try_cast("double")
    last = F.lower(F.substring(text, -1, 1))
    single = n * F.when(last == "m", 60.0).when(last == "h", 3600.0).when(last == "d", float(DAY)).when(last == "w", 7.0 * DAY)
    out = F.when(text.rlike(r"^([0-9]+(\.[0-9]+)?(ms|h|m|s))+$"), seconds).when(text.rlike("^[0-9]+[mMhHdDwW]$"), single)
    return F.when(out > 0, out)


def parse_time(text: Column) -> Column:
    """RFC 3339, RFC 1123 or the compact form of signed requests; null for anything else."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "EEE, dd MMM yyyy HH:mm:ss z", "yyyyMMdd'T'HHmmss'Z'")
    shapes = (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}(Z|[+-]\d\d:\d\d)$", r"^[A-Z][a-z]{2}, \d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [A-Z]{3}$", r"^\d{8}T\d{6}Z$")
    # the weekday is redundant and strict parsers reject it
    bare = F.regexp_replace(text, "^[A-Z][a-z]{2}, ", "")
    tries = [F.when(text.rlike(s), F.try_to_timestamp(bare if f.startswith("EEE") else text, F.lit(f.removeprefix("EEE, ")))) for f, s in zip(formats, shapes, strict=True)]
    return F.coalesce(*tries).cast("timestamp_ntz")


def expiry_from(absolute: Column, relative: Column, now: Column) -> Column:
    """The expiry of an upload: an absolute directive wins even when it is malformed (then there is none)."""
    later = F.timestamp_add("SECOND", span_seconds(relative).cast("bigint"), now).cast("timestamp_ntz")
    return F.when(F.length(F.coalesce(absolute, F.lit(""))) > 0, parse_time(absolute)).otherwise(later)


def expired(expiry: Column, now: Column) -> Column:
    """Strictly past; unset never expires."""
    return F.coalesce(now > expiry, F.lit(False))


def age_seconds(at: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", at, now)


def due(at: Column, days: Column, date: Column, now: Column) -> Column:
    """A lifecycle rule's time: its date is strictly past, or the age is its days or more."""
    by_date = F.coalesce(now > date, F.lit(False))
    by_age = F.coalesce((days > 0) & (F.timestamp_diff("MICROSECOND", at, now) >= days.cast("bigint") * DAY * 1_000_000), F.lit(False))
    return by_date | by_age


def default_retention(days: Column, years: Column, now: Column) -> Column:
    """Retention end by a bucket's default; years have 365 days."""
    total = F.coalesce(days, F.lit(0)) + F.coalesce(years, F.lit(0)) * 365
    return F.when(total > 0, F.timestamp_add("DAY", total, now).cast("timestamp_ntz"))


def relative_time(at: Column, now: Column) -> Column:
    """How long ago, in words."""
    s = age_seconds(at, now)
    say = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "just now").when(s < 3600, say(60, " min ago")).when(s < DAY, say(3600, " h ago")).otherwise(say(DAY, " d ago"))
