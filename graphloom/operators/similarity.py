"""Neighbourhood similarity and link prediction, by common neighbours.

Pairs are found a node at a time from neighbour lists in the tasks, so that each leaves as it is found; graphs that are too
large for that are joined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..runtime import cut
from . import compact
from .joins import common_neighbors, open_pairs


def _degrees(graph: Graph) -> DataFrame:
    return graph.simple().groupBy("a").agg(F.count("*").alias("k"))


def _with_degrees(graph: Graph, pairs: DataFrame) -> DataFrame:
    k = _degrees(graph)
    return pairs.join(k.select("a", F.col("k").alias("ka")), "a").join(k.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")


def _lists(graph: Graph) -> compact.Packed | None:
    """Lists of the simple graph, if tasks may hold that many."""
    simple = cut(graph.simple())
    return compact.pack(simple, graph.nodes) if simple.count() <= compact.MOST_ENTRIES else None


METRICS = {
    "jaccard": lambda p: p["n"] / (p["ka"] + p["kb"] - p["n"]),
    "cosine": lambda p: p["n"] / np.sqrt(p["ka"] * p["kb"]),
    "overlap": lambda p: p["n"] / np.minimum(p["ka"], p["kb"]),
}


def common_counts(graph: Graph) -> DataFrame:
    """(a, b, n) with a < b: how many neighbours each pair shares that shares one."""
    if packed := _lists(graph):
        return compact.pairs(packed, graph.nodes, lambda p: [p["a"], p["b"], p["n"]], "a long, b long, n long")
    return common_neighbors(graph).groupBy("a", "b").agg(F.count("*").alias("n"))


def similarity(graph: Graph, metric: str = "jaccard") -> DataFrame:
    """(a, b, score) of all pairs with a common neighbour, by jaccard, cosine or overlap of neighbour sets."""
    of = METRICS[metric]
    if packed := _lists(graph):
        return compact.pairs(packed, graph.nodes, lambda p: [p["a"], p["b"], of(p)], "a long, b long, score double")
    pairs = _with_degrees(graph, common_neighbors(graph).groupBy("a", "b").agg(F.count("*").alias("n")))
    n, ka, kb = F.col("n"), F.col("ka"), F.col("kb")
    score = {"jaccard": n / (ka + kb - n), "cosine": n / F.sqrt(ka * kb), "overlap": n / F.least(ka, kb)}[metric]
    return pairs.select("a", "b", score.alias("score"))


def similarities(graph: Graph) -> DataFrame:
    """(a, b, jaccard, cosine, overlap): all three from one pass over the pairs."""
    if packed := _lists(graph):
        return compact.pairs(packed, graph.nodes, lambda p: [p["a"], p["b"], *(of(p) for of in METRICS.values())], "a long, b long, jaccard double, cosine double, overlap double")
    pairs = _with_degrees(graph, common_neighbors(graph).groupBy("a", "b").agg(F.count("*").alias("n")))
    n, ka, kb = F.col("n"), F.col("ka"), F.col("kb")
    return pairs.select("a", "b", (n / (ka + kb - n)).alias("jaccard"), (n / F.sqrt(ka * kb)).alias("cosine"), (n / F.least(ka, kb)).alias("overlap"))


def top_similar(graph: Graph, metric: str = "jaccard", k: int = 10) -> DataFrame:
    """The k best pairs; of the pairs that are found together a task passes on k."""
    of = METRICS[metric]

    def best(p: dict[str, np.ndarray]) -> list[np.ndarray]:
        x = of(p)
        first = np.lexsort((p["b"], p["a"], -x))[:k] if len(x) <= 4 * k else None
        if first is None:
            some = np.flatnonzero(x >= np.partition(x, len(x) - k)[len(x) - k])
            first = some[np.lexsort((p["b"][some], p["a"][some], -x[some]))[:k]]
        return [p["a"][first], p["b"][first], x[first]]

    if k > 0 and (packed := _lists(graph)):
        return compact.pairs(packed, graph.nodes, best, "a long, b long, score double").orderBy(F.desc("score"), "a", "b").limit(k)
    return similarity(graph, metric).where("score > 0").orderBy(F.desc("score"), "a", "b").limit(k)


def link_scores(graph: Graph, metric: str = "adamic_adar") -> DataFrame:
    """(a, b, score) of pairs that aren't neighbours, by adamic_adar, common_neighbors, resource_allocation or preferential_attachment.

    The first three need a common neighbour; preferential attachment scores all pairs of linked nodes, a product that
    grows with the square of the nodes.
    """
    if metric == "preferential_attachment":
        k = _degrees(graph)
        pairs = k.select("a", F.col("k").alias("ka")).join(k.select(F.col("a").alias("b"), F.col("k").alias("kb")), F.col("a") < F.col("b"))
        return pairs.join(graph.simple(), ["a", "b"], "left_anti").select("a", "b", (F.col("ka") * F.col("kb")).cast("double").alias("score"))
    if packed := _lists(graph):
        return _open(packed, graph, metric).where("score > 0")
    k = _degrees(graph).withColumnRenamed("a", "c")
    part = {"adamic_adar": F.when(F.col("k") > 1, 1 / F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0)), "common_neighbors": F.lit(1.0), "resource_allocation": 1 / F.col("k")}[metric]
    return open_pairs(graph).join(k, "c").groupBy("a", "b").agg(F.sum(part).alias("score")).where("score > 0")


def _open(packed: compact.Packed, graph: Graph, *metrics: str) -> DataFrame:
    """(a, b, a score a metric), named score if it is one, of pairs with common neighbours that aren't neighbours."""
    of = {"adamic_adar": lambda p: p["adamic_adar"], "common_neighbors": lambda p: p["n"].astype(np.float64), "resource_allocation": lambda p: p["resource"]}

    def kept(p: dict[str, np.ndarray]) -> list[np.ndarray]:
        free = ~p["linked"]
        return [p["a"][free], p["b"][free], *(of[m](p)[free] for m in metrics)]

    names = ["score"] if len(metrics) == 1 else metrics
    return compact.pairs(packed, graph.nodes, kept, "a long, b long, " + ", ".join(f"{n} double" for n in names), True)


def all_link_scores(graph: Graph) -> DataFrame:
    """(a, b, adamic_adar, common_neighbors, resource_allocation): the three link_scores that need a common neighbour, from one pass."""
    metrics = ("adamic_adar", "common_neighbors", "resource_allocation")
    if packed := _lists(graph):
        return _open(packed, graph, *metrics)
    one, two, three = (link_scores(graph, m).withColumnRenamed("score", m) for m in metrics)
    return one.join(two, ["a", "b"]).join(three, ["a", "b"])


def predict_links(graph: Graph, metric: str = "adamic_adar", k: int = 10) -> DataFrame:
    """The k best of link_scores.  Preferential attachment pairs only the nodes of the largest degrees, more of them until no other pair can be among the best."""
    if metric != "preferential_attachment":
        return link_scores(graph, metric).orderBy(F.desc("score"), "a", "b").limit(k)
    simple = cut(graph.simple())
    degree = cut(simple.groupBy("a").agg(F.count("*").alias("k")))
    n, most = degree.agg(F.count("*"), F.coalesce(F.max("k"), F.lit(0))).first()
    m = 4 * k + 16
    while True:
        first = degree.orderBy(F.desc("k"), "a").limit(m)
        least = cut(first.agg(F.min("k"))).first()[0] or 0
        # all nodes of the last degree too, as ties go by id
        some = cut(degree.where(F.col("k") >= least))
        pairs = some.select("a", F.col("k").alias("ka")).join(some.select(F.col("a").alias("b"), F.col("k").alias("kb")), F.col("a") < F.col("b"))
        found = cut(pairs.join(simple, ["a", "b"], "left_anti").select("a", "b", (F.col("ka") * F.col("kb")).cast("double").alias("score")).orderBy(F.desc("score"), "a", "b").limit(k))
        worst = found.agg(F.count("*"), F.min("score")).first()
        # any other pair has a node of less degree than `least`
        if m >= n or (worst[0] == k and worst[1] > most * (least - 1)):
            return found
        m *= 4
