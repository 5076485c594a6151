"""Bi-temporal predicates over half-open intervals; a null end is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = int | Column
OPEN = (1 << 63) - 1


def _at(x: Moment) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def _end(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(OPEN))


def is_valid_at(ts: Moment, start: str = "valid_from", end: str = "valid_until") -> Column:
    return (F.col(start) <= _at(ts)) & (_at(ts) < _end(end))


def is_current_at(ts: Moment) -> Column:
    return is_valid_at(ts, "tx_from", "tx_until")


def is_active() -> Column:
    return F.col("valid_until").isNull() & F.col("tx_until").isNull()


def is_valid_during(start: Moment, end: Moment, low: str = "valid_from", high: str = "valid_until") -> Column:
    """Overlap of two non-empty intervals."""
    return (_at(start) < _at(end)) & (F.col(low) < _end(high)) & (F.col(low) < _at(end)) & (_end(high) > _at(start))


def was_current_during(start: Moment, end: Moment) -> Column:
    return is_valid_during(start, end, "tx_from", "tx_until")


def closed_at(name: str, at: Moment) -> Column:
    """The end column closed at a moment, unless it is closed earlier."""
    return F.least(F.col(name), _at(at))
