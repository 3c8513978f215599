"""Times, durations and ranges given as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(text: Column) -> Column:
    """seconds of [H]H:MM:SS with an optional fraction of three digits behind a dot or comma; null if malformed."""
    pattern = r"^(?:(\d+):)?([0-5]\d):([0-5]\d)[.,](\d{3})$"
    whole = r"^(\d+):([0-5]\d):([0-5]\d)$"
    part = lambda p, i: F.coalesce(F.nullif(F.regexp_extract(text, p, i), F.lit("")).cast("long"), F.lit(0))
    millis = (part(pattern, 1) * 3600 + part(pattern, 2) * 60 + part(pattern, 3)) * 1000 + part(pattern, 4)
    return F.when(text.rlike(pattern), millis / F.lit(1000.0)).when(text.rlike(whole), (part(whole, 1) * 3600 + part(whole, 2) * 60 + part(whole, 3)).cast("double"))


def format_timestamp(seconds: Column, mark: str = ",", digits: int = 3) -> Column:
    """HH:MM:SS with a fraction, rounded half up to its last digit."""
    units = F.floor(seconds * 10**digits + 0.5).cast("long")
    s = F.floor(units / 10**digits).cast("long")
    pad = lambda c, n: F.when(F.length(c.cast("string")) >= n, c.cast("string")).otherwise(F.lpad(c.cast("string"), n, "0"))
    return F.concat(pad(F.floor(s / 3600).cast("long"), 2), F.lit(":"), pad(F.floor(s / 60).cast("long") % 60, 2), F.lit(":"), pad(s % 60, 2), F.lit(mark), pad(units % 10**digits, digits))


# Units of a period in seconds, and what a field between colons may hold.
UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0}
PERIOD = re.compile(r"(?:\d+(?:\.\d+)?[hms])+", re.IGNORECASE)
FIELD = re.compile(r"\d*(?:\.\d{1,3})?")


def duration(text: str) -> float:
    """seconds of a clock (90, 1:30, 1:, 1::5) or a period (1h30m5s, 1.5h, in any order).

    The last field of several must be below 60, as must the minutes between hours and seconds. Digits behind a point: at most three.

    >>> duration("1:30"), duration("1::5"), duration("1m30s"), duration("1.5H"), duration("30m1h")
    (90.0, 3605.0, 90.0, 5400.0, 5400.0)
    """
    text = text.strip()
    if PERIOD.fullmatch(text):
        return float(sum(float(n) * UNITS[unit.lower()] for n, unit in re.findall(r"(\d+(?:\.\d+)?)([hms])", text, re.IGNORECASE)))
    fields = text.split(":")
    if not re.search(r"\d", text) or len(fields) > 3 or not all(FIELD.fullmatch(x) for x in fields):
        raise ValueError(f"not a duration: {text!r}")
    values = [float(x) if x else 0.0 for x in fields]
    if (len(values) > 1 and values[-1] >= 60) or (len(values) == 3 and values[1] >= 60):
        raise ValueError(f"not a duration: {text!r}")
    return float(sum(x * 60**i for i, x in enumerate(reversed(values))))


def section(start: str | None = None, to: str | None = None, length: str | None = None) -> tuple[float, float | None, float | None]:
    """start, finish and length of a cut; an end and a length together are an error."""
    if to and length:
        raise ValueError("a length can't be combined with an end")
    begin = duration(start) if start else 0.0
    lasts = duration(length) if length else None
    return begin, duration(to) if to else (begin + lasts if lasts is not None else None), lasts


def duration_column(text: Column) -> Column:
    """F62 as an expression; null where `duration` raises."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    amounts, units = (F.regexp_extract_all(trimmed, F.lit(r"(?i)([0-9]+(?:\.[0-9]+)?)([hms])"), g) for g in (1, 2))
    period = F.aggregate(F.zip_with(amounts, units, lambda n, u: n.cast("double") * F.when(F.lower(u) == "h", 3600.0).when(F.lower(u) == "m", 60.0).otherwise(1.0)), F.lit(0.0), lambda s, x: s + x)
    fields = F.transform(F.split(trimmed, ":", -1), lambda x: F.when(x == "", F.lit(0.0)).otherwise(x.try_cast("double")))
    n = F.size(fields)
    last, middle = F.get(fields, n - 1), F.get(fields, F.lit(1))
    well = trimmed.rlike(r"[0-9]") & trimmed.rlike(r"^(?:[0-9]*(?:\.[0-9]{1,3})?:){0,2}[0-9]*(?:\.[0-9]{1,3})?$") & ~((n > 1) & (last >= 60)) & ~((n == 3) & (middle >= 60))
    clock = F.aggregate(fields, F.lit(0.0), lambda s, x: s * 60 + x)
    return F.when(trimmed.rlike(r"(?i)^(?:[0-9]+(?:\.[0-9]+)?[hms])+$"), period).when(well, clock)


def time_ranges(text: str) -> list[tuple[float, float]]:
    """W5 with F62: the merged ranges of a list such as 1:30-2:00.5, 10-20."""
    spans = []
    for part in text.split(","):
        ends = [duration(x) for x in part.split("-")]
        if len(ends) != 2 or ends[1] <= ends[0]:
            raise ValueError(f"not a range: {part!r}")
        spans.append((ends[0], ends[1]))
    merged: list[tuple[float, float]] = []
    for start, finish in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(finish, merged[-1][1]))
        else:
            merged.append((start, finish))
    return merged


def range_list(text: Column) -> Column:
    """pairs (first, last) of a list such as 6,1,3-5, in the order given; a malformed or falling range is an error."""

    def pair(part: Column) -> Column:
        ends = F.split(F.btrim(part), "-")
        first, last = ends[0].try_cast("int"), F.element_at(ends, -1).try_cast("int")
        good = F.btrim(part).rlike(r"^\d+(-\d+)?$") & (first <= last)
        return F.when(good, F.struct(first.alias("first"), last.alias("last"))).otherwise(F.raise_error(F.concat(F.lit("not a range: "), part)).cast("struct<first:int,last:int>"))

    return F.transform(F.split(text, ","), pair)


def range_values(ranges: Column, most: int = 10_000) -> Column:
    """The distinct numbers of a range list in order; more than `most` is an error."""
    size = F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    values = F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["first"], r["last"])))))
    return F.when(size <= most, values).otherwise(F.raise_error(F.lit("too many numbers")).cast("array<int>"))
