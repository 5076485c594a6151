"""Distances between ARRAY columns, and scores from distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, 1 - dot(a, b) / length).otherwise(F.lit(1.0))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def inner_product_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


METRICS = {"cosine": cosine_distance, "l2": l2_squared, "ip": inner_product_distance}


def score(distance: Column) -> Column:
    return 1 / (1 + distance)


def similarity(distance: Column) -> Column:
    return 1 - distance
