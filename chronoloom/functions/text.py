"""Positions, channel lists and number formats."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

# Seconds per unit of a position, and binary byte units.
UNIT_SECONDS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
BYTE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB")

_FRAME = r"^#(-?\d+)$"
_CLOCK = r"^(\d+):(\d+(?:\.\d+)?)$"
_AMOUNT = r"^(-?(?:\d+\.?\d*|\.\d+))\s*(ms|s|m|h)?$"


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def frame_at(seconds: Column, rate: float, how: str = "round") -> Column:
    """The frame of a time: the nearest (round, halves up), the one that is due (floor), or without its fraction (truncate)."""
    x = seconds.cast("double") * F.lit(float(rate))
    if how not in ("round", "floor", "truncate"):
        raise ValueError(f"{how!r} is none of round, floor, truncate")
    return {"round": half_up(x), "floor": F.floor(x), "truncate": F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))}[how].cast("long")


def position(text: Column, rate: float) -> Column:
    """The frame that a position names: '#n', 'm:ss.f', or a number with ms, s, m or h (seconds if none).

    Null and empty text give null; anything else raises an error.
    """
    t, rate = F.trim(text), float(rate)
    clock = F.regexp_extract(t, _CLOCK, 1).cast("double") * 60.0 + F.regexp_extract(t, _CLOCK, 2).cast("double")
    unit = F.regexp_extract(t, _AMOUNT, 2)
    scale = F.lit(UNIT_SECONDS["s"])
    for name, seconds in UNIT_SECONDS.items():
        scale = F.when(unit == name, F.lit(seconds)).otherwise(scale)
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("long"))
        .when(t.rlike(_FRAME), F.regexp_extract(t, _FRAME, 1).cast("long"))
        .when(t.rlike(_CLOCK), half_up(clock * F.lit(rate)))
        .when(t.rlike(_AMOUNT), half_up(F.regexp_extract(t, _AMOUNT, 1).cast("double") * scale * F.lit(rate)))
        .otherwise(F.raise_error(F.concat(F.lit("not a position: "), t)).cast("long"))
    )


def frame_of(text: str | None, rate: float) -> int | None:
    """position() for one text on the driver."""
    t = (text or "").strip()
    if not t:
        return None
    if m := re.match(_FRAME, t):
        return int(m[1])
    if m := re.match(_CLOCK, t):
        seconds = int(m[1]) * 60.0 + float(m[2])
    elif m := re.match(_AMOUNT, t):
        seconds = float(m[1]) * UNIT_SECONDS[m[2] or "s"]
    else:
        raise ValueError(f"not a position: {t}")
    return int(np.floor(seconds * rate + 0.5))


def channel_list(spec: Column, channels: int) -> Column:
    """Ascending distinct channels of 'all', 'even', 'odd' or a list of numbers and ranges; null means all."""
    everything = F.sequence(F.lit(0), F.lit(channels - 1))
    part = F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.trim(p))
    spans = F.flatten(F.transform(part, lambda p: F.when(p.rlike(r"^\d+-\d+$"), F.when(F.split(p, "-")[0].cast("int") <= F.split(p, "-")[1].cast("int"), F.sequence(F.split(p, "-")[0].cast("int"), F.split(p, "-")[1].cast("int"))).otherwise(F.array().cast("array<int>"))).otherwise(F.array(p.try_cast("int")))))
    return (
        F.when(spec.isNull() | (spec == "all"), everything)
        .when(spec == "even", F.filter(everything, lambda c: c % 2 == 0))
        .when(spec == "odd", F.filter(everything, lambda c: c % 2 == 1))
        .otherwise(F.array_sort(F.array_distinct(spans)))
    )


def channels_of(spec: str | list[int] | None, channels: int) -> list[int]:
    """channel_list() for one specification on the driver; channels out of range raise ValueError."""
    if spec is None or spec == "all":
        return list(range(channels))
    if spec in ("even", "odd"):
        return list(range(spec == "odd", channels, 2))
    found: set[int] = set()
    for p in spec.split(",") if isinstance(spec, str) else map(str, spec):
        a, _, b = p.strip().partition("-")
        found.update(range(int(a), int(b or a) + 1))
    if bad := [c for c in sorted(found) if not 0 <= c < channels]:
        raise ValueError(f"channels {bad} are outside 0..{channels - 1}")
    return sorted(found)


def channels_for_download(requested: list[int], channels: int) -> list[int]:
    """Ascending distinct channels; those out of range are left out."""
    return sorted({c for c in requested if 0 <= c < channels})


def integer(x: Column) -> Column:
    """With thousands separators."""
    return F.format_number(x.cast("decimal(38,0)"), 0)


def bytes_text(x: Column) -> Column:
    """Binary units with four decimals, rounded from the double's exact value, halves to even; plain bytes without."""
    n = F.least(x.cast("long"), F.lit(2**63 - 1024)).cast("double").cast("long")  # beyond that a double has no long
    out = None
    for k in reversed(range(1, len(BYTE_UNITS))):
        # format_string rounds the shortest decimal text of a double, so ten-thousandths are counted in integers.
        low = n.bitwiseAND(F.lit(2 ** (10 * k) - 1)) * 10_000
        odd = F.shiftright(low, 10 * k).bitwiseAND(F.lit(1))
        parts = F.shiftright(n, 10 * k) * 10_000 + F.shiftright(low + (2 ** (10 * k - 1) - 1) + odd, 10 * k)
        own = F.format_string(f"%d.%04d {BYTE_UNITS[k]}", F.call_function("div", parts, F.lit(10_000)), parts % 10_000)
        out = own if out is None else F.when(x < 1024 ** (k + 1), own).otherwise(out)
    return F.when(x < 1024, F.format_string("%d B", x)).when(x.isNotNull(), out)


def duration(seconds: Column) -> Column:
    """hh:mm:ss.mmm"""
    part = lambda n: F.floor(seconds / n)
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%06.3f", part(3600), part(60) % 60, seconds.cast("double") % 60.0))


def iso_time(nanos: Column) -> Column:
    """UTC time to the millisecond, from nanoseconds since 1970 (session time zone UTC)."""
    return F.date_format(F.timestamp_millis(F.call_function("div", nanos, F.lit(1_000_000))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def fixed(x: Column, digits: int) -> Column:
    """A decimal with so many places, halves away from zero."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def widened(x: Column) -> Column:
    """A FLOAT as the shortest text of its double value."""
    return x.cast("double").cast("string")


def nine_digits(x: float) -> str:
    """A number to nine significant digits, without trailing zeros or exponent noise."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    d = Decimal(float(x))
    places = 8 - d.adjusted()
    d = d.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
    text = format(d.normalize(), "f") if -7 < d.adjusted() < 21 else _exponent(d)
    return text


def _exponent(d: Decimal) -> str:
    n = d.normalize()
    digits = "".join(map(str, n.as_tuple().digits))
    return ("-" if n < 0 else "") + digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if n.adjusted() > 0 else '-'}{abs(n.adjusted())}"


@arrow_udf(StringType())
def nine_digits_udf(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else nine_digits(float(np.float32(v))) for v in x.to_pylist()], pa.string())


def tick_step(span_seconds: float, steps=(0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10, 15, 30, 60), most: int = 10) -> float:
    """The first step that divides a span into at most so many parts."""
    return next((s for s in steps if span_seconds / s <= most), steps[-1])


def csv_size_estimate(seconds: Column, rate: Column, channels: Column) -> Column:
    """Bytes of a CSV of so many seconds: 22 a row and 12 a channel."""
    return half_up(seconds * rate * (F.lit(22) + F.lit(12) * channels)).cast("long")
