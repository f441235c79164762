"""Nanosecond times as text, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegrid.errors import RequestError

NS = 1_000_000_000


def timestamp_iso(ns: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.nnnnnnnnn in UTC, whatever the session's time zone."""
    seconds, part = F.floor(ns / NS), F.pmod(ns, F.lit(NS))
    # floor(ns / NS) as a double loses nanoseconds, so the whole seconds come from the exact remainder
    seconds = (ns - part).cast("decimal(20,0)") / F.lit(NS)
    day = F.floor(seconds / 86_400)
    rest = (seconds - day * 86_400).cast("int")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), two(F.pmod(rest, F.lit(60))))
    return F.when(ns.isNotNull(), F.concat(date, F.lit("T"), clock, F.lit("."), F.lpad(part.cast("string"), 9, "0")))


def timedelta_iso(ns: Column) -> Column:
    """ISO-8601 duration: sign, days, then hours, minutes and seconds where not zero; fractions without closing zeros.

    `ns` is a LONG, or a decimal without fraction where durations pass 2^63 ns (292 years); whole seconds must fit a LONG.
    """
    whole = lambda x, n: F.call_function("div", x, F.lit(n))
    piece = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")

    def split(n: Column) -> Column:
        a = F.abs(n)
        return F.struct((n < 0).alias("below"), whole(a, NS).alias("total"), F.pmod(a, F.lit(NS)).cast("int").alias("part"))

    def text(s: Column) -> Column:
        total, part = s["total"], s["part"]
        rest = F.pmod(total, F.lit(86_400))
        days, hours, minutes, seconds = whole(total, 86_400), whole(rest, 3600), whole(F.pmod(rest, F.lit(3600)), 60), F.pmod(rest, F.lit(60))
        fraction = F.when(part > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(part.cast("string"), 9, "0"), "0+$", ""))).otherwise("")
        secs = F.when((seconds > 0) | (part > 0), F.concat(seconds.cast("string"), fraction, F.lit("S"))).otherwise("")
        clock = F.concat(piece(hours, "H"), piece(minutes, "M"), secs)
        body = F.concat(piece(days, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
        return F.when((total == 0) & (part == 0), F.lit("PT0S")).otherwise(F.concat(F.when(s["below"], "-").otherwise(""), F.lit("P"), body))

    # arrays of one element, so that each step is evaluated once and not again for each piece; in decimals, as the least LONG has no positive counterpart
    return F.transform(F.transform(F.array(ns.cast("decimal(38,0)")), split), text)[0]


def format_ns(ns: Column, logical: str, temporal_format: str = "iso") -> Column:
    if temporal_format not in ("iso", "raw_ns"):
        raise RequestError(f"unknown temporal format {temporal_format!r}")
    if temporal_format == "raw_ns":
        return ns
    return timestamp_iso(ns) if logical == "timestamp_ns" else timedelta_iso(ns)


def format_ns_array(a: Column, logical: str, temporal_format: str = "iso") -> Column:
    """format_ns for each element. The lambda takes one argument only: a second one would be given the element's place."""
    return F.transform(a, lambda ns: format_ns(ns, logical, temporal_format))


def interval_to_ns(interval: Column) -> Column:
    """A day-time interval (microseconds) as LONG nanoseconds."""
    part = lambda unit: F.extract(F.lit(unit), interval)
    whole = part("DAY").cast("long") * 86_400 + part("HOUR") * 3600 + part("MINUTE") * 60
    return whole * NS + (part("SECOND") * 1_000_000).cast("long") * 1000


def to_ns(ts: Column) -> Column:
    """A timestamp (microseconds) as LONG nanoseconds."""
    return F.unix_micros(ts) * 1000


def ntz_to_ns(ts: Column) -> Column:
    """A timestamp without time zone as LONG nanoseconds, from its fields: the session's time zone has no say."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * NS + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long") * 1000
