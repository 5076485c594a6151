"""Packing chunks into a token budget.

Input: node_id, label, score, tokens and anything else; output: the chunks that are
included.  Greedy packing is a sequential fold; it runs as a JVM-side higher-order
function over (density, id, tokens) of the candidates, which a context query limits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import in_one_task

PRESETS = {"small": 4096, "4k": 4096, "medium": 8192, "8k": 8192, "large": 16384, "16k": 16384, "xl": 32768, "32k": 32768, "xxl": 131072, "128k": 131072}
STRATEGIES = {"mmr": 0.7, "submodular": 0.5, "proportional": (0.4, 0.3, 0.2, 0.1)}


@dataclass(frozen=True)
class Budget:
    tokens: int
    allocation: str = "auto"  # auto, priority, proportional, mmr or submodular
    parameter: object = None

    @classmethod
    def preset(cls, name: str, allocation: str = "auto") -> Budget:
        return cls(PRESETS[name], allocation)


def _density() -> Column:
    return F.when(F.col("tokens") > 0, F.col("score") / F.col("tokens")).otherwise(F.lit(float("inf")))


def _fitting(items: Column, most: Column) -> Column:
    """Ids that a greedy pass over items (struct of order, id, tokens, sorted) takes."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))
    step = lambda s, x: F.when(s["used"] + x["t"] <= most, F.struct((s["used"] + x["t"]).alias("used"), F.concat(s["ids"], F.array(x["id"])).alias("ids"))).otherwise(s)
    return F.aggregate(items, start, step)["ids"]


def _items() -> Column:
    return F.array_sort(F.collect_list(F.struct((-_density()).alias("d"), F.col("node_id").alias("id"), F.col("tokens").cast("long").alias("t"))))


def _first(kind: np.ndarray, tokens: np.ndarray, score: np.ndarray, node: np.ndarray, most: int) -> np.ndarray:
    """Indices of the rows that a pass by (score falling, id) over each kind could take: of a size, as many as fit."""
    order = np.lexsort((node, -score, tokens, kind))
    new = np.ones(len(order), bool)
    new[1:] = (kind[order][1:] != kind[order][:-1]) | (tokens[order][1:] != tokens[order][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < most // np.maximum(tokens[order], 1)]


def candidates(chunks: DataFrame, tokens: int, kind: Column | None = None) -> DataFrame:
    """(kind, node_id, score, tokens): what a greedy pass over each kind can take at all.

    Of chunks of one size the better come first, and once one doesn't fit no later one does: at most
    tokens / size of each size can be taken.  Tasks keep just these before anything is shuffled, so what is
    gathered is bounded by the budget and not by the table.  Chunks of no tokens always fit and are left out.
    """

    def prune(batches):
        held = None
        for batch in batches:
            t = batch.to_pandas()
            t = t[t["tokens"] <= tokens]
            held = t if held is None else pd.concat([held, t], ignore_index=True)
            if len(held) > 500_000:
                held = held.iloc[_first(*(held[c].to_numpy() for c in ("kind", "tokens", "score", "node_id")), tokens)].reset_index(drop=True)
        if held is not None and len(held):
            held = held.iloc[_first(*(held[c].to_numpy() for c in ("kind", "tokens", "score", "node_id")), tokens)]
            yield pa.RecordBatch.from_pandas(held, preserve_index=False)

    schema = "kind long, node_id long, score double, tokens long"
    rows = chunks.where("tokens > 0").select((F.lit(0) if kind is None else kind).cast("long").alias("kind"), "node_id", F.col("score").cast("double").alias("score"), F.col("tokens").cast("long").alias("tokens"))
    rank = F.row_number().over(Window.partitionBy("kind", "tokens").orderBy(F.desc("score"), "node_id"))
    return rows.mapInArrow(prune, schema).withColumn("_r", rank).where(F.col("_r") <= F.floor(F.lit(tokens) / F.col("tokens"))).drop("_r")


def _taken(chunks: DataFrame, picked: DataFrame) -> DataFrame:
    """Chunks that were picked, at most a budget's tokens of them, and those without tokens."""
    return chunks.where("tokens > 0").join(F.broadcast(picked), "node_id", "left_semi").unionByName(chunks.where("tokens <= 0"))


def greedy(chunks: DataFrame, tokens: int) -> DataFrame:
    """By score per token, then id; a chunk that doesn't fit is passed over."""
    picked = candidates(chunks, tokens).agg(_items().alias("items")).select(F.explode(_fitting(F.col("items"), F.lit(tokens).cast("long"))).alias("node_id"))
    return _taken(chunks, picked)


def pool(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.isin("relationship", "edge", "relation"), 1).when(low.isin("text", "chunk", "text_chunk", "document"), 2).when(low.isin("metadata", "meta", "config"), 3).otherwise(0)


def proportional(chunks: DataFrame, tokens: int, shares: tuple[float, float, float, float] = STRATEGIES["proportional"]) -> DataFrame:
    """Greedy within four pools: entities, relationships, text and metadata."""
    most = F.lit(0).cast("long")
    for i, share in enumerate(shares):
        most = F.when(F.col("pool") == i, F.lit(int(tokens * share)).cast("long")).otherwise(most)
    packed = candidates(chunks, tokens, pool(F.col("label"))).withColumnRenamed("kind", "pool").groupBy("pool").agg(_items().alias("items"))
    picked = packed.select(F.explode(_fitting(F.col("items"), most)).alias("node_id"))
    return _taken(chunks, picked)


def _relevance(scores: np.ndarray) -> np.ndarray:
    low, high = scores.min(), scores.max()
    return (scores - low) / (high - low) if high - low > 1.1920929e-07 else np.ones(len(scores))


def _arrays(labels: list, scores: list[float], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label numbers, relevance and sizes."""
    return pd.factorize(np.array(labels, object), use_na_sentinel=False)[0], _relevance(np.array(scores, np.float64)), np.array(sizes, np.int64)


def pick_mmr(labels: list, scores: list[float], sizes: list[int], tokens: int, lam: float) -> list[int]:
    """Indices in order of maximal marginal relevance, where chunks of a label are alike."""
    if not len(scores):
        return []
    lam = min(max(lam, 0.0), 1.0)
    label, rel, size = _arrays(labels, scores, sizes)
    value, left, n, used, taken, seen = lam * rel, np.arange(len(rel)), len(rel), 0, [], set()
    while n:
        fit = (size[:n] <= 0) | (used + size[:n] <= tokens)
        if not fit.any():
            break
        at = int(np.where(fit, value[:n], -np.inf).argmax())
        i, own = int(left[at]), int(label[at])
        taken.append(i)
        used += int(size[at])
        n -= 1
        for x in (left, label, size, value):
            x[at] = x[n]
        if own not in seen:
            seen.add(own)
            value[:n][label[:n] == own] -= 1 - lam
    return taken


def pick_submodular(labels: list, scores: list[float], sizes: list[int], tokens: int, alpha: float) -> list[int]:
    """Indices in order of gain alpha * relevance + (1 - alpha) * chunks newly covered by their label."""
    if not len(scores):
        return []
    alpha = min(max(alpha, 0.0), 1.0)
    label, rel, size = _arrays(labels, scores, sizes)
    gain, covered = alpha * rel + (1 - alpha) * np.bincount(label)[label], set()
    open_, used, taken = np.ones(len(rel), bool), 0, []
    while True:
        fit = open_ & ((size <= 0) | (used + size <= tokens))
        if not fit.any():
            return taken
        i = int(np.where(fit, gain, -np.inf).argmax())
        open_[i] = False
        taken.append(i)
        used += int(size[i])
        if (own := int(label[i])) not in covered:
            covered.add(own)
            gain[label == own] = alpha * rel[label == own]


def _sequential(chunks: DataFrame, pick) -> DataFrame:
    def step(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["score", "node_id"], ascending=[False, True], kind="stable")
        chosen = pick(t["label"].tolist(), t["score"].tolist(), t["tokens"].tolist()) if len(t) else []
        return pd.DataFrame({"node_id": t["node_id"].iloc[chosen].astype("int64"), "pick": range(1, len(chosen) + 1)})

    # only these columns go to the one task; what they are made of is read in parallel
    picked = in_one_task(chunks.select("node_id", "label", "score", "tokens").repartition(1), step, "node_id long, pick int")
    return chunks.join(picked, "node_id")


def mmr(chunks: DataFrame, tokens: int, lam: float = STRATEGIES["mmr"]) -> DataFrame:
    return _sequential(chunks, lambda labels, scores, sizes: pick_mmr(labels, scores, sizes, tokens, lam)).drop("pick")


def submodular(chunks: DataFrame, tokens: int, alpha: float = STRATEGIES["submodular"]) -> DataFrame:
    return _sequential(chunks, lambda labels, scores, sizes: pick_submodular(labels, scores, sizes, tokens, alpha)).drop("pick")


def enforce(chunks: DataFrame, budget: Budget) -> DataFrame:
    """Chunks within the budget by its allocation; none if it is 0."""
    if budget.tokens <= 0:
        return chunks.where(F.lit(False))
    kind, more = budget.allocation, () if budget.parameter is None else (budget.parameter,)
    kinds = {"auto": greedy, "priority": greedy, "proportional": proportional, "mmr": mmr, "submodular": submodular}
    return kinds[kind](chunks, budget.tokens, *(() if kind in ("auto", "priority") else more))
