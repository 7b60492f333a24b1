"""The query surface of lists: case-blind filters, free-text search, whitelisted order, pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(column: str, value: str) -> Column:
    """Equality that ignores case."""
    return F.lower(column) == F.lower(F.lit(value))


def on_day(column: str, day: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Dates of a timestamp as half-open ranges of instants, so that files and row groups can be skipped."""
    start = lambda d, n=0: F.date_add(F.to_date(F.lit(d)), n).cast("timestamp_ntz")
    at, out = F.col(column), F.lit(True)
    if day:
        out = out & (at >= start(day)) & (at < start(day, 1))
    if since:
        out = out & (at >= start(since))
    if until:
        out = out & (at < start(until, 1))
    return out


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows in which each term, split at white space and commas, stands in some column, whatever its case."""
    terms = [t for t in re.split(r"[\s,]+", text.lower()) if t]
    holds = lambda term: reduce(Column.__or__, (F.contains(F.lower(F.col(c)), F.lit(term)) for c in columns))
    return df.where(reduce(Column.__and__, map(holds, terms), F.lit(True)))


def order(keys: list[str], allowed: set[str]) -> list[Column]:
    """Sort columns of keys such as 'name' or '-date'; keys that are not allowed are ignored."""
    return [F.desc(k[1:]) if k[0] == "-" else F.asc(k) for k in keys if k.lstrip("-") in allowed]


def page(df: DataFrame, keys: list[str], number: int, size: int, allowed: set[str]) -> DataFrame:
    """One page of an ordered list, counted from 1."""
    return df.orderBy(*order(keys, allowed)).offset((max(1, number) - 1) * size).limit(size)


def lookback(text: str | None, default: int = 10, most: int = 50) -> int:
    """A number of games between 1 and ``most``; anything but digits is the default."""
    return min(max(int(text), 1), most) if text and text.isascii() and text.isdigit() else default


def positive(text: str | None, default: float) -> float:
    """A positive number, else the default."""
    try:
        value = float(text or "")
    except ValueError:
        return default
    return value if 0 < value < float("inf") else default


def one_of(column: str, value: str, allowed: set[str]) -> Column:
    """Equality with one of the allowed values; any other value is an error."""
    if value not in allowed:
        raise ValueError(f"{column} must be one of {', '.join(sorted(allowed))}")
    return F.col(column) == value


def season(column: str, text: str | None) -> Column:
    """A season of digits; other text filters nothing."""
    return F.col(column) == int(text) if text and text.isascii() and text.isdigit() else F.lit(True)


def lookup(df: DataFrame, column: str, value: str, order_by: str) -> DataFrame:
    """The first row of a natural key, or none."""
    return df.where(F.col(column) == value).orderBy(order_by).limit(1)


def selected(events: DataFrame, n: int, at: str = "kickoff", key: str = "match_id") -> DataFrame:
    """The next ``n`` scheduled events; only where nothing is scheduled the latest ``n`` of all.

    One pass: each row is sorted by whether it is scheduled first, and ``n`` rows are looked at.
    """
    coming = F.col("status") == "scheduled"
    ranked = events.orderBy(F.desc(coming), F.when(coming, F.col(at)).asc_nulls_last(), F.col(at).desc(), key).limit(n)
    return ranked.withColumn("_any", F.max(coming).over(Window.partitionBy(F.lit(1)))).where(coming | ~F.col("_any")).drop("_any")
