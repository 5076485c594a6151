"""Decay of a score with age in milliseconds; a moment that isn't past doesn't decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _aged(score: Column, ts: Column, now: int, decayed) -> Column:
    age = (F.lit(now) - ts).cast("double")
    return F.when(F.lit(now) <= ts, score).otherwise(decayed(age))


def exponential(score: Column, ts: Column, now: int, half_life: int) -> Column:
    return _aged(score, ts, now, lambda age: score * F.pow(F.lit(0.5), age / float(half_life)) if half_life else F.lit(0.0))


def linear(score: Column, ts: Column, now: int, max_age: int) -> Column:
    return _aged(score, ts, now, lambda age: score * F.greatest(F.lit(0.0), 1 - age / float(max_age)) if max_age else F.lit(0.0))


def step(score: Column, ts: Column, now: int, cutoff: int) -> Column:
    return _aged(score, ts, now, lambda age: F.when(age < cutoff, score).otherwise(F.lit(0.0)))


def custom(score: Column, ts: Column, now: int, points: list[tuple[int, float]]) -> Column:
    """Piecewise linear from (0, 1) through points (age, factor); beyond the last its factor."""

    def decayed(age: Column) -> Column:
        factor = F.lit(points[-1][1])
        spans = list(zip([(0, 1.0), *points], points))
        for (x0, y0), (x1, y1) in reversed(spans):
            inside = F.lit(y1) if x1 == x0 else y0 + (y1 - y0) * (age - x0) / float(x1 - x0)
            factor = F.when(age <= x1, inside).otherwise(factor)
        return score * factor

    return _aged(score, ts, now, decayed) if points else score


def apply(kind: str | None, score: Column, ts: Column, now: int, parameter=None) -> Column:
    """Decay by name: none, exponential, linear, step or custom."""
    kinds = {"exponential": exponential, "linear": linear, "step": step, "custom": custom}
    return kinds[kind](score, ts, now, parameter) if kind and kind != "none" else score
