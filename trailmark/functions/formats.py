"""Numbers, instants and spans as text, and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS = {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
UNKNOWN = "unknown"


def format_count(x: Column) -> Column:
    return F.when(x.isNull() | (x < 0), F.lit(UNKNOWN)).otherwise(F.format_number(x, 0))


def _utc(ms: Column, pattern: str) -> Column:
    return F.when(ms.isNull() | (ms <= 0), F.lit(UNKNOWN)).otherwise(F.date_format(F.timestamp_millis(ms), pattern))


def format_instant(ms: Column) -> Column:
    """Minute precision; the session's time zone is expected to be UTC."""
    return F.when(ms.isNull() | (ms <= 0), F.lit(UNKNOWN)).otherwise(F.concat(_utc(ms, "yyyy-MM-dd HH:mm"), F.lit(" UTC")))


def format_day(ms: Column) -> Column:
    return _utc(ms, "yyyy-MM-dd")


def span_unit(ms: Column) -> Column:
    """The largest unit that a span fills: day, hour or minute."""
    size = F.abs(ms)
    return F.when(size >= MS["day"], "day").when(size >= MS["hour"], "hour").otherwise("minute")


def span_amount(ms: Column) -> Column:
    """A span in its unit, to one decimal; minutes are whole."""
    unit = span_unit(ms)
    return F.when(unit == "day", F.round(ms / MS["day"], 1)).when(unit == "hour", F.round(ms / MS["hour"], 1)).otherwise(F.round(ms / MS["minute"], 0))


def format_span(ms: Column) -> Column:
    amount, unit = span_amount(ms), span_unit(ms)
    shown = F.when(amount == F.floor(amount), amount.cast("long").cast("string")).otherwise(amount.cast("string"))
    return F.when(ms.isNull(), F.lit(UNKNOWN)).otherwise(F.concat(shown, F.lit(" "), unit, F.when(F.abs(amount) == 1, "").otherwise("s")))


def format_latency(ms: Column) -> Column:
    """Milliseconds below a second, else seconds to one decimal."""
    return F.when(ms.isNull() | (ms < 0), F.lit(UNKNOWN)).when(ms < 1000, F.concat(F.round(ms, 0).cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(F.round(ms / 1000, 1).cast("string"), F.lit(" s")))


def redact(text: Column) -> Column:
    """Hide what looks like a credential or an absolute path."""
    hidden = F.regexp_replace(text, r"(?i)\b(bearer|token|secret|password|api[_-]?key)\b(\s*[:=]?\s*)\S+", "$1$2[redacted]")
    return F.regexp_replace(hidden, r"(?<![\w:/])/(?:[\w.@+-]+/)+[\w.@+-]*", "[path]")


def collapse(text: Column, limit: int, marker: str = "...") -> Column:
    """White space runs as one space, cut to ``limit`` characters plus a mark."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(marker))).otherwise(flat)
