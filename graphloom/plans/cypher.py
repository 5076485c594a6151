"""A pattern-matching query subset, compiled to DataFrame plans.

MATCH (n:Label {key: value}) or (a:L)-[r:T]->(b:M), WHERE with AND and OR, RETURN of
variables, properties or aggregates, ORDER BY, SKIP, LIMIT; and CREATE (n:Label {...}).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..model import Graph
from ..operators.aggregates import aggregate
from ..operators.filters import visible
from ..operators.joins import pattern

_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<op><>|<=|>=|->|<-|[=<>(){}\[\]:,.*-])|(?P<word>\w+))""")
_COMPARE = {"=", "<>", "<", "<=", ">", ">="}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidQuery(f"can't read {text[at:at + 20]!r}")
        kind = m.lastgroup
        value = m.group(kind)
        out.append((kind, re.sub(r"\\(.)", r"\1", value[1:-1]) if kind == "string" else value))
        at = m.end()
    return out


@dataclass
class Item:
    """A RETURN item: a variable, a property or an aggregate of one."""

    variable: str
    key: str | None = None
    function: str | None = None
    distinct: bool = False
    alias: str | None = None


class Parser:
    def __init__(self, text: str):
        self.t, self.at = tokens(text), 0

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.t[self.at + n] if self.at + n < len(self.t) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.t[self.at - 1] if self.at <= len(self.t) else ("end", "")

    def word(self, *words: str) -> bool:
        """Take these words, if they come next."""
        if all(self.peek(i)[0] == "word" and self.peek(i)[1].upper() == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def op(self, op: str) -> bool:
        if self.peek() == ("op", op):
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.op(op):
            raise InvalidQuery(f"expected {op!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.take()
        if kind != "word":
            raise InvalidQuery(f"expected a name, found {value!r}")
        return value

    def literal(self) -> str:
        kind, value = self.take()
        if kind not in ("string", "number", "word"):
            raise InvalidQuery(f"expected a value, found {value!r}")
        return value

    def properties(self) -> dict[str, str]:
        out: dict[str, str] = {}
        if self.op("{"):
            while not self.op("}"):
                key = self.take()[1]
                self.need(":")
                out[key] = self.literal()
                self.op(",")
        return out

    def node(self) -> tuple[str, str | None, dict[str, str]]:
        self.need("(")
        variable = self.name() if self.peek()[0] == "word" else ""
        label = self.name() if self.op(":") else None
        props = self.properties()
        self.need(")")
        return variable, label, props

    def where(self, columns) -> Column:
        parts = [self.conjunction(columns)]
        while self.word("OR"):
            parts.append(self.conjunction(columns))
        return reduce(lambda a, b: a | b, parts)

    def conjunction(self, columns) -> Column:
        parts = [self.predicate(columns)]
        while self.word("AND"):
            parts.append(self.predicate(columns))
        return reduce(lambda a, b: a & b, parts)

    def predicate(self, columns) -> Column:
        if self.peek()[1].lower() == "id" and self.peek(1) == ("op", "("):
            self.take()
            self.need("(")
            variable = self.name()
            self.need(")")
            self.need("=")
            return columns(variable, None) == int(self.literal())
        variable = self.name()
        self.need(".")
        value = columns(variable, self.name())
        if self.word("IS", "NOT", "NULL"):
            return value.isNotNull()
        if self.word("IS", "NULL"):
            return value.isNull()
        for words, test in ((("CONTAINS",), F.contains), (("STARTS", "WITH"), F.startswith), (("ENDS", "WITH"), F.endswith)):
            if self.word(*words):
                return F.coalesce(test(value, F.lit(self.literal())), F.lit(False))
        op = self.take()[1]
        if op not in _COMPARE:
            raise InvalidQuery(f"no comparison {op!r}")
        return compare(value, op, self.literal())

    def items(self) -> list[Item]:
        out = []
        while True:
            first = self.take()[1]
            if self.op("("):
                distinct = self.word("DISTINCT")
                item = Item("*" if self.op("*") else self.name(), function=first.lower(), distinct=distinct)
                if self.op("."):
                    item.key = self.name()
                self.need(")")
            else:
                item = Item(first, self.name() if self.op(".") else None)
            if self.word("AS"):
                item.alias = self.name()
            out.append(item)
            if not self.op(","):
                return out


def compare(value: Column, op: str, literal: str) -> Column:
    """A comparison with a literal; false for a missing property; order is numeric if both are numbers."""
    if op == "=":
        return F.coalesce(value == literal, F.lit(False))
    if op == "<>":
        return F.coalesce(value != literal, F.lit(False))
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    try:
        number = F.lit(float(literal))
        out = F.when(value.try_cast("double").isNotNull(), test(value.try_cast("double"), number)).otherwise(test(value, F.lit(literal)))
    except ValueError:
        out = test(value, F.lit(literal))
    return F.coalesce(out, F.lit(False))


def _check_label(graph: Graph, label: str | None) -> None:
    if label is not None and graph.nodes.where(F.col("label") == label).isEmpty():
        raise InvalidQuery(f"no nodes of label {label}")


def run(graph: Graph, text: str, check_labels: bool = False) -> DataFrame:
    """The result of a MATCH query.

    Of one node: node_id, label, properties, or the returned properties, or one row of aggregates; of a pattern the
    returned properties, or a_id, edge_id, label, weight, b_id.
    """
    p = Parser(text)
    if not p.word("MATCH"):
        raise InvalidQuery("a query begins with MATCH")
    left = p.node()
    edge, right = None, None
    if p.op("-"):
        p.need("[")
        edge = (p.name() if p.peek()[0] == "word" else "", p.name() if p.op(":") else None)
        p.need("]")
        p.need("->")
        right = p.node()
    if check_labels:
        for side in (left, right):
            if side:
                _check_label(graph, side[1])
    if edge is None:
        rows = graph.nodes if left[1] is None else graph.nodes.where(F.col("label") == left[1])
        rows = rows.withColumn("n", F.struct("node_id", "label", "entity_key", "props"))
        places = {left[0]: "n"}
    else:
        rows = pattern(graph, left[1], edge[1], right[1])
        places = {left[0]: "a", edge[0]: "r", right[0]: "b"}

    def column(variable: str, key: str | None) -> Column:
        at = places.get(variable)
        if at is None:
            raise InvalidQuery(f"no variable {variable}")
        if key is None:
            return F.col(f"{at}.edge_id" if at == "r" else f"{at}.node_id")
        if key == "entity_key" and at != "r":
            return F.col(f"{at}.entity_key")
        if at == "r" and key == "weight":
            return F.col("r.weight").cast("string")
        return F.col(f"{at}.props")[key]

    for side in (left, right):
        for key, value in (side[2] if side else {}).items():
            rows = rows.where(compare(column(side[0], key), "=", value))
    if p.word("WHERE"):
        rows = rows.where(p.where(column))
    items = p.items() if p.word("RETURN") else []
    order = None
    if p.word("ORDER", "BY"):
        variable = p.name()
        p.need(".")
        order = (variable, p.name(), False)
        if p.word("DESC"):
            order = (*order[:2], True)
        else:
            p.word("ASC")
    skip = int(p.literal()) if p.word("SKIP") else 0
    limit = int(p.literal()) if p.word("LIMIT") else None
    if p.peek()[0] != "end":
        raise InvalidQuery(f"can't use {p.peek()[1]!r} here")
    if any(i.function for i in items):
        rows = rows.withColumn("node_id", column(left[0], None))
        aggs = [i for i in items if i.function]
        values = [aggregate(i.function, column(i.variable, i.key) if i.variable != "*" and i.key else None if i.function == "count" else column(i.variable, i.key), i.distinct).alias(i.alias or f"agg_{k}") for k, i in enumerate(aggs)]
        return rows.agg(*values)
    tie = [column(v, None) for v in places]
    if order:
        value = column(*order[:2])
        number = value.try_cast("double")
        keys = [value.isNull().desc(), number.desc_nulls_last(), value.desc(), *[t.desc() for t in tie]] if order[2] else [value.isNull().asc(), number.asc_nulls_last(), value.asc(), *[t.asc() for t in tie]]
        rows = rows.orderBy(*keys)
    elif skip or limit is not None:
        rows = rows.orderBy(*tie)
    rows = rows.offset(skip) if skip else rows
    rows = rows.limit(limit) if limit is not None else rows
    wanted = [i for i in items if i.key is not None]
    if wanted:
        return rows.select(*[column(i.variable, i.key).alias(i.alias or f"{i.variable}.{i.key}") for i in wanted])
    if edge is None:
        return rows.select("node_id", "label", visible(F.coalesce("props", F.create_map().cast("map<string,string>"))).alias("properties"))
    return rows.select(F.col("a.node_id").alias("a_id"), F.col("r.edge_id").alias("edge_id"), F.col("r.label").alias("label"), F.col("r.weight").alias("weight"), F.col("b.node_id").alias("b_id"))


def created(text: str) -> tuple[str, dict[str, str]]:
    """(label, properties) of a CREATE."""
    p = Parser(text)
    if not p.word("CREATE"):
        raise InvalidQuery("expected CREATE")
    _, label, props = p.node()
    if label is None:
        raise InvalidQuery("a node needs a label")
    return label, props
