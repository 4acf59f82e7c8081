"""Periods of a timestamp, in epoch milliseconds, both ends inclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period(ts: Column, unit: str) -> Column:
    """struct(start_ms, end_ms) of the hour, day, month or year a timestamp without zone lies in."""
    start = F.date_trunc(unit, ts)
    end = {"hour": F.expr("interval 1 hour"), "day": F.expr("interval 1 day"), "month": F.expr("interval 1 month"), "year": F.expr("interval 1 year")}[unit]
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ms = lambda c: F.timestamp_diff("MILLISECOND", zero, c.cast("timestamp_ntz"))
    return F.struct(ms(start).alias("start_ms"), (ms(start + end) - 1).alias("end_ms"))


def orientation(a: Column, b: Column) -> Column:
    """Of two periods: full (b within a), up or down (b follows or precedes a directly), else ignore."""
    return F.when((b["start_ms"] >= a["start_ms"]) & (b["end_ms"] <= a["end_ms"]), "full").when(b["start_ms"] == a["end_ms"] + 1, "up").when(b["end_ms"] == a["start_ms"] - 1, "down").otherwise("ignore")


def combined(spatial: Column, temporal: Column) -> Column:
    """spatial-temporal; ignore-ignore where the periods do not meet, wherever the cells lie."""
    return F.when(temporal == "ignore", "ignore-ignore").otherwise(F.concat_ws("-", spatial, temporal))
