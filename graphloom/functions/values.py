"""Dynamic values: typed reading of CSV cells and JSON, stringification, sizes, scopes, hashes."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_type(cell: Column) -> Column:
    """int, float, bool or string; null for an empty cell, which is an absent property."""
    return (
        F.when(cell.isNull() | (cell == ""), F.lit(None).cast("string"))
        .when(cell.try_cast("long").isNotNull() & cell.rlike(r"^[+-]?\d+$"), "int")
        .when(cell.try_cast("double").isNotNull() & ~cell.rlike("[dDfF]$"), "float")
        .when(F.lower(cell).isin("true", "false"), "bool")
        .otherwise("string")
    )


def json_type(value: object) -> str:
    """The value type of a parsed JSON value; numeric lists, the empty one too, are vectors."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "int" if float(value).is_integer() and isinstance(value, int) else "float"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        return "vector" if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value) else "list"
    return "map"


def to_text(value: object) -> str | None:
    """How a value is kept in a property map."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (list, dict)) else repr(value) if isinstance(value, float) else str(value)


def number(value: Column) -> Column:
    return value.try_cast("double")


def node_tokens(props: Column) -> Column:
    """A quarter of the characters of all keys' values, rounded down."""
    sizes = F.transform(F.map_values(props), lambda v: F.coalesce(F.length(v), F.lit(4)))
    return F.floor(F.aggregate(sizes, F.lit(0), lambda s, x: s + x) / 4).cast("long")


def scope(workspace: str, user: str | None = None, agent: str | None = None, session: str | None = None) -> str:
    """The graph name of a scope; each level needs the one above it."""
    parts = [("ws", workspace), ("user", user), ("agent", agent), ("session", session)]
    given = [v is not None for _, v in parts]
    if given != sorted(given, reverse=True) or not workspace:
        raise ValueError("a scope level requires its parent")
    return ":".join(f"{k}:{v}" for k, v in parts if v is not None)


_MASK = (1 << 64) - 1


def xorshift64(state: int) -> int:
    state ^= (state << 13) & _MASK
    state ^= state >> 7
    return (state ^ (state << 17)) & _MASK


def split_mix(x: int) -> int:
    x = (x * 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def importance(degree: Column, max_degree: Column, created_at: Column, accessed_at: Column, now: int) -> Column:
    """0.4 degree share + 0.3 recency (a week) + 0.3 access (a day), between 0 and 1."""

    def hours(ts: Column) -> Column:
        return F.greatest(F.lit(now) - ts, F.lit(0)).cast("double") / 3_600_000.0

    structural = F.when(max_degree > 0, degree / max_degree).otherwise(F.lit(0.0))
    recency = F.exp(-hours(F.coalesce(created_at, F.lit(0))) / 168.0)
    access = F.when(accessed_at > 0, F.exp(-hours(accessed_at) / 24.0)).otherwise(F.lit(0.0))
    return F.least(F.greatest(0.4 * structural + 0.3 * recency + 0.3 * access, F.lit(0.0)), F.lit(1.0))


def glob(pattern: str) -> str:
    """A regular expression for a glob of * and ?."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def permission(graph: Column, rules: list[tuple[str, str]]) -> Column:
    """The permission that the first matching rule (glob, permission) gives; without rules readwrite."""
    if not rules:
        return F.lit("readwrite")
    found = F.lit(None).cast("string")
    for pattern, what in reversed(rules):
        found = F.when(graph.rlike(glob(pattern)), what).otherwise(found)
    return found
