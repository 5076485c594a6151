"""Centralities, triangles and cores.

Which view of the multigraph an operator counts: PageRank, HITS and betweenness
count parallel edges; eigenvector, Katz, simple degree, triangles and cores count
unique neighbours.  Fixed-round algorithms cut lineage every CUT rounds.
"""

from __future__ import annotations

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph
from ..runtime import cut, new_path
from . import compact

CUT = 4


def _rounds(start: DataFrame, step, rounds: int, tolerance: float | None, change: Column | None) -> DataFrame:
    """step applied to a table up to `rounds` times; stops when the aggregate `change` of old and x is under the tolerance."""
    now = start
    for i in range(rounds):
        new = step(now)
        if tolerance is None:
            now = cut(new) if i % CUT == CUT - 1 else new
            continue
        new = cut(new)
        moved = new.join(now.withColumnsRenamed({"x": "_old"}).select("node_id", "_old"), "node_id").agg(change).first()[0]
        now = new
        if moved is not None and moved < tolerance:
            break
    return now


def _into(graph: Graph) -> DataFrame:
    """(a, b): for each edge its target and its source."""
    return graph.out().select(F.col("b").alias("a"), F.col("a").alias("b"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum()) or 1)


def _furthest(new: np.ndarray, old: np.ndarray) -> float:
    return np.abs(new - old).max(initial=0)


def _by_lists(spark: SparkSession, packed: compact.Packed, rounds: int, tolerance: float | None, start, next_, change, share=None, first=None, last=None) -> DataFrame:
    """(node_id, score): rounds over neighbour lists. next_(lists, get, sums of share(x, deg) over the lists, x) gives x; ends that are no nodes keep 0.

    deg: how often a node is in the lists, which is its out-degree where they hold what leads to a node.  Like _rounds else.
    """
    vectors = compact.Vectors.of(spark)

    def begin(lists: compact.Lists, get) -> tuple[dict[str, np.ndarray], float]:
        found, x = {} if first is None else first(lists, get)[0], start(lists).astype(np.float64)
        if share is not None:
            deg = np.zeros(len(lists.ids))
            for i in range(0, len(lists.to), 1 << 22):
                np.add.at(deg, lists.to[i : i + (1 << 22)], 1.0)
            found |= {"deg": deg, "z-0": share(x, deg)}
        return found | {"x-0": x}, 0.0

    vectors.alone(packed, begin)
    done = 0
    for i in range(1, rounds + 1):
        vectors.sums(packed, f"{'x' if share is None else 'z'}-{i - 1}", f"s-{i}")

        def step(lists: compact.Lists, get, i=i) -> tuple[dict[str, np.ndarray], float]:
            x = get(f"x-{i - 1}")
            new = next_(lists, get, get(f"s-{i}"), x) * lists.own
            return {f"x-{i}": new} | ({} if share is None else {f"z-{i}": share(new, get("deg"))}), change(new, x)

        moved = vectors.alone(packed, step)
        vectors.drop(f"s-{i}", f"x-{i - 1}", f"z-{i - 1}")
        done = i
        if tolerance is not None and moved < tolerance:
            break
    if last is not None:
        vectors.alone(packed, lambda lists, get: ({"last": last(get(f"x-{done}"))}, 0.0))
    return vectors.table(packed, score="last" if last is not None else f"x-{done}")


def personalized_pagerank(graph: Graph, seeds: DataFrame | None = None, alpha: float = 0.15, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """(node_id, score): alpha is the share that returns to the seeds, by default all nodes; dangling mass goes to the seeds too."""
    nodes = graph.nodes.select("node_id")
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    targets = nodes if seeds is None else seeds.select("node_id").distinct().join(nodes, "node_id", "left_semi")
    k = targets.count()
    if not k:
        return nodes.where(F.lit(False)).withColumn("score", F.lit(0.0))
    if packed := compact.pack(_into(graph), nodes, most=compact.MOST_ONCE):
        named = None if seeds is None else new_path(graph.spark, "seeds")
        if named:
            targets.write.parquet(named)

        def first(lists: compact.Lists, get) -> tuple[dict[str, np.ndarray], float]:
            t = lists.own / k
            if named:
                t = np.zeros(len(lists.ids))
                for b in compact._read(*fs.FileSystem.from_uri(named)):
                    t[lists.at(b.column(0).to_numpy())] = 1 / k
            return {"t": t}, 0.0

        def next_(lists: compact.Lists, get, s: np.ndarray, x: np.ndarray) -> np.ndarray:
            t = get("t")
            return alpha * t + (1 - alpha) * (s + x[lists.own & (get("deg") == 0)].sum() * t)

        return _by_lists(graph.spark, packed, rounds, tolerance, lambda lists: lists.own / n, next_, lambda new, old: np.abs(new - old).sum(), lambda x, deg: np.divide(x, deg, out=np.zeros(len(x)), where=deg > 0), first)
    teleport = targets.withColumn("t", F.lit(1.0 / k))
    degree = graph.out().groupBy("a").agg(F.count("*").alias("deg"))
    links = cut(graph.out().groupBy("a", "b").agg(F.count("*").alias("m")).join(degree, "a"))
    frame = cut(nodes.join(teleport, "node_id", "left").join(degree.withColumnRenamed("a", "node_id"), "node_id", "left").select("node_id", F.coalesce("t", F.lit(0.0)).alias("t"), "deg"))

    def step(x: DataFrame) -> DataFrame:
        into = links.join(x.select(F.col("node_id").alias("a"), "x"), "a").groupBy(F.col("b").alias("node_id")).agg(F.sum(F.col("x") * F.col("m") / F.col("deg")).alias("s"))
        lost = frame.where("deg IS NULL").join(x, "node_id").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("lost"))
        new = frame.join(into, "node_id", "left").crossJoin(F.broadcast(lost))
        return new.select("node_id", (alpha * F.col("t") + (1 - alpha) * (F.coalesce("s", F.lit(0.0)) + F.col("lost") * F.col("t"))).alias("x"))

    out = _rounds(nodes.withColumn("x", F.lit(1.0 / n)), step, rounds, tolerance, F.sum(F.abs(F.col("x") - F.col("_old"))))
    return out.select("node_id", F.col("x").alias("score"))


def pagerank(graph: Graph, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None, reference_compat: bool = False, label: str | None = None) -> DataFrame:
    """Conventional damping; reference_compat takes damping as the share that returns."""
    seeds = None if label is None else graph.nodes.where(F.col("label") == label)
    return personalized_pagerank(graph, seeds, damping if reference_compat else 1 - damping, rounds, tolerance)


def article_rank(graph: Graph, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """(node_id, score): PageRank with out-degree + average out-degree as divisor, without redistribution."""
    nodes = cut(graph.nodes.select("node_id"))
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    average = graph.edges.count() / n
    if packed := compact.pack(_into(graph), nodes, most=compact.MOST_ONCE):
        return _by_lists(graph.spark, packed, rounds, tolerance, lambda lists: lists.own / n, lambda lists, get, s, x: (1 - damping) / n + damping * s, _furthest, lambda x, deg: np.divide(x, deg + average, out=np.zeros(len(x)), where=deg > 0))
    degree = graph.out().groupBy("a").agg(F.count("*").alias("deg"))
    links = cut(graph.out().groupBy("a", "b").agg(F.count("*").alias("m")).join(degree, "a"))

    def step(x: DataFrame) -> DataFrame:
        into = links.join(x.select(F.col("node_id").alias("a"), "x"), "a").groupBy(F.col("b").alias("node_id")).agg(F.sum(F.col("x") * F.col("m") / (F.col("deg") + average)).alias("s"))
        return nodes.join(into, "node_id", "left").select("node_id", ((1 - damping) / n + damping * F.coalesce("s", F.lit(0.0))).alias("x"))

    out = _rounds(nodes.withColumn("x", F.lit(1.0 / n)), step, rounds, tolerance, F.max(F.abs(F.col("x") - F.col("_old"))))
    return out.select("node_id", F.col("x").alias("score"))


def _over(x: DataFrame, by: Column) -> DataFrame:
    """x divided by an aggregate of x, if that is positive."""
    total = x.agg(by.alias("_by"))
    return x.crossJoin(F.broadcast(total)).select("node_id", F.when(F.col("_by") > 0, F.col("x") / F.col("_by")).otherwise(F.col("x")).alias("x"))


def eigenvector(graph: Graph, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(node_id, score): over unique undirected neighbours, largest score 1."""
    if packed := compact.pack(graph.simple(), graph.nodes, mutual=True, most=compact.MOST_ONCE):
        return _by_lists(graph.spark, packed, rounds, tolerance, lambda lists: lists.own / max(1, lists.own.sum()) ** 0.5, lambda lists, get, s, x: s * lists.own / (s[lists.own].max(initial=0) or 1), _furthest)
    nodes, links = cut(graph.nodes.select("node_id")), cut(graph.simple())
    n = nodes.count()

    def step(x: DataFrame) -> DataFrame:
        into = links.join(x.select(F.col("node_id").alias("a"), "x"), "a").groupBy(F.col("b").alias("node_id")).agg(F.sum("x").alias("s"))
        return _over(nodes.join(into, "node_id", "left").select("node_id", F.coalesce("s", F.lit(0.0)).alias("x")), F.max("x"))

    out = _rounds(nodes.withColumn("x", F.lit(1.0 / max(1, n) ** 0.5)), step, rounds, tolerance, F.max(F.abs(F.col("x") - F.col("_old"))))
    return out.select("node_id", F.col("x").alias("score"))


def katz(graph: Graph, alpha: float = 0.1, beta: float = 1.0, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(node_id, score): x = alpha A x + beta over unique undirected neighbours, self-loops counted, at last of length 1."""
    if packed := compact.pack(graph.both().select("a", "b").distinct(), graph.nodes, mutual=True, most=compact.MOST_ONCE):
        return _by_lists(graph.spark, packed, rounds, tolerance, lambda lists: np.zeros(len(lists.ids)), lambda lists, get, s, x: alpha * s + beta, _furthest, last=lambda x: x / (np.sqrt((x * x).sum()) or 1))
    nodes, links = cut(graph.nodes.select("node_id")), cut(graph.both().select("a", "b").distinct())

    def step(x: DataFrame) -> DataFrame:
        into = links.join(x.select(F.col("node_id").alias("a"), "x"), "a").groupBy(F.col("b").alias("node_id")).agg(F.sum("x").alias("s"))
        return nodes.join(into, "node_id", "left").select("node_id", (alpha * F.coalesce("s", F.lit(0.0)) + beta).alias("x"))

    out = _rounds(nodes.withColumn("x", F.lit(0.0)), step, rounds, tolerance, F.max(F.abs(F.col("x") - F.col("_old"))))
    return _over(out, F.sqrt(F.sum(F.col("x") * F.col("x")))).select("node_id", F.col("x").alias("score"))


def hits(graph: Graph, rounds: int = 20) -> DataFrame:
    """(node_id, hub, authority): parallel edges count; each of length 1 after each round."""
    out = compact.pack(graph.out().select("a", "b"), graph.nodes, most=compact.MOST_ONCE)
    if out and (into := compact.pack(_into(graph), graph.nodes)):
        vectors, names = compact.Vectors.of(graph.spark), ("hub-0", "hub-0")
        vectors.alone(out, lambda lists, get: ({"hub-0": lists.own.astype(np.float64)}, 0.0))
        for i in range(1, rounds + 1):
            for packed, of, name in ((into, f"hub-{i - 1}", f"authority-{i}"), (out, f"authority-{i}", f"hub-{i}")):
                vectors.sums(packed, of, f"s-{name}")
                vectors.alone(packed, lambda lists, get, name=name: ({name: _unit(get(f"s-{name}") * lists.own)}, 0.0))
                vectors.drop(f"s-{name}")
            vectors.drop(*names)
            names = (f"hub-{i}", f"authority-{i}")
        return vectors.table(out, hub=names[0], authority=names[1])
    nodes = cut(graph.nodes.select("node_id"))
    links = cut(graph.out().groupBy("a", "b").agg(F.count("*").cast("double").alias("m")))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")))

    def through(x: DataFrame, near: str, far: str) -> DataFrame:
        s = links.join(x.select(F.col("node_id").alias(near), "x"), near).groupBy(F.col(far).alias("node_id")).agg(F.sum(F.col("x") * F.col("m")).alias("s"))
        return _over(nodes.join(s, "node_id", "left").select("node_id", F.coalesce("s", F.lit(0.0)).alias("x")), length)

    hub = nodes.withColumn("x", F.lit(1.0))
    authority = hub
    for i in range(rounds):
        authority = through(hub, "a", "b")
        hub = through(authority, "b", "a")
        if i % 2:
            hub, authority = cut(hub), cut(authority)
    return hub.withColumnRenamed("x", "hub").join(authority.withColumnRenamed("x", "authority"), "node_id")


def simple_degree(graph: Graph) -> DataFrame:
    """(node_id, score): unique neighbours besides itself over n - 1."""
    return _degree(graph, graph.simple())


def degree(graph: Graph) -> DataFrame:
    """(node_id, score): incident edges, parallel ones and both ends of self-loops counted, over n - 1."""
    return _degree(graph, graph.both())


def _degree(graph: Graph, links: DataFrame) -> DataFrame:
    n = graph.nodes.count()
    found = links.groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("d"))
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", (F.coalesce("d", F.lit(0)) / F.lit(float(max(1, n - 1)))).alias("score"))


def distances(graph: Graph, sources: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(source, node_id, dist, sigma): undirected hops between all pairs reached, and shortest paths counted with parallel edges.

    Quadratic in what is reached: for graphs of some thousand nodes, or for given sources.
    """
    links = cut(graph.both().where("a <> b").groupBy("a", "b").agg(F.count("*").cast("double").alias("m")))
    start = (graph.nodes if sources is None else sources).select("node_id").distinct()
    found = cut(start.select(F.col("node_id").alias("source"), "node_id", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    frontier, depth = found, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("source", F.col("node_id").alias("a"), "sigma").join(links, "a").groupBy("source", F.col("b").alias("node_id")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        frontier = cut(step.join(found.select("source", "node_id"), ["source", "node_id"], "left_anti").select("source", "node_id", F.lit(depth).alias("dist"), "sigma"))
        if frontier.isEmpty():
            break
        found = found.unionAll(frontier)
    return found


def _packed(graph: Graph, counted: bool = False) -> compact.Packed | None:
    """Lists of the unique neighbours, counted with how many edges link them, if tasks may hold that many."""
    links = cut(graph.both().where("a <> b").groupBy("a", "b").agg(F.count("*").alias("m")) if counted else graph.simple())
    return compact.pack(links, graph.nodes, "m" if counted else None) if links.count() <= compact.MOST_ENTRIES else None


def closeness(graph: Graph, table: DataFrame | None = None) -> DataFrame:
    """(node_id, score): nodes reached over the sum of their distances."""
    if table is None and (packed := _packed(graph)):
        return compact.hop_sums(packed, graph.nodes).select("node_id", F.when(F.col("reached") > 0, F.col("reached") / F.col("total")).otherwise(F.lit(0.0)).alias("score"))
    d = distances(graph) if table is None else table
    found = d.where("dist > 0").groupBy(F.col("source").alias("node_id")).agg((F.count("*") / F.sum("dist")).alias("score"))
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def harmonic(graph: Graph, table: DataFrame | None = None) -> DataFrame:
    """(node_id, score): the sum of reciprocal distances over n - 1."""
    n = graph.nodes.count()
    if table is None and (packed := _packed(graph)):
        return compact.hop_sums(packed, graph.nodes).select("node_id", (F.col("inverse") / F.lit(float(max(1, n - 1)))).alias("score"))
    d = distances(graph) if table is None else table
    found = d.where("dist > 0").groupBy(F.col("source").alias("node_id")).agg((F.sum(1 / F.col("dist")) / F.lit(float(max(1, n - 1)))).alias("score"))
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def betweenness(graph: Graph, table: DataFrame | None = None) -> DataFrame:
    """(node_id, score): Brandes' dependencies, level by level from the farthest, halved as paths go both ways."""
    if table is None and (packed := _packed(graph, counted=True)):
        found = compact.dependencies(packed, graph.nodes).where("x <> 0").groupBy("node_id").agg((F.sum("x") / 2).alias("score"))
        return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    d = cut(distances(graph) if table is None else table)
    links = cut(graph.both().where("a <> b").groupBy("a", "b").agg(F.count("*").cast("double").alias("m")))
    farthest = d.agg(F.max("dist")).first()[0] or 0
    delta = None
    parts = []
    for level in range(farthest, 0, -1):
        here = d.where(F.col("dist") == level).select("source", F.col("node_id").alias("b"), F.col("sigma").alias("sb"))
        here = here.withColumn("db", F.lit(0.0)) if delta is None else here.join(delta.select("source", F.col("node_id").alias("b"), F.col("x").alias("db")), ["source", "b"], "left").fillna(0.0, ["db"])
        above = d.where(F.col("dist") == level - 1).select("source", F.col("node_id").alias("a"), F.col("sigma").alias("sa"))
        delta = cut(here.join(links, "b").join(above, ["source", "a"]).groupBy("source", F.col("a").alias("node_id")).agg(F.sum(F.col("m") * F.col("sa") / F.col("sb") * (1 + F.col("db"))).alias("x")))
        parts.append(delta.where("source <> node_id"))
    nodes = graph.nodes.select("node_id")
    if not parts:
        return nodes.withColumn("score", F.lit(0.0))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    found = every.groupBy("node_id").agg((F.sum("x") / 2).alias("score"))
    return nodes.join(found, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def triangles(graph: Graph) -> DataFrame:
    """(node_id, triangles, neighbors, clustering): of the simple undirected graph.

    Counted in neighbour lists; larger graphs are joined.  Each edge is directed from its end of lower (degree, id), which bounds what
    one node fans out to on skewed graphs.
    """
    k = F.col("neighbors")
    clustering = F.when(k > 1, 2 * F.col("triangles") / (k * (k - 1))).otherwise(F.lit(0.0))
    links = graph.both().where("a <> b").select("a", "b")
    if packed := compact.pack(links, graph.nodes, mutual=True, most=compact.MOST_ONCE, once=True):
        return compact.triangles(packed, graph.spark).withColumn("clustering", clustering)
    simple = cut(graph.simple())
    deg = simple.groupBy("a").agg(F.count("*").alias("k"))
    ranked = simple.join(deg.select("a", F.col("k").alias("ka")), "a").join(deg.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")
    up = cut(ranked.where((F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))).select("a", "b"))
    wedge = up.select("a", F.col("b").alias("x")).join(up.select("a", F.col("b").alias("y")), "a").where("x < y")
    closing = up.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    found = wedge.join(closing, ["x", "y"]).select(F.explode(F.array("a", "x", "y")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("t"))
    out = graph.nodes.select("node_id").join(found, "node_id", "left").join(deg.select(F.col("a").alias("node_id"), "k"), "node_id", "left")
    out = out.select("node_id", F.coalesce("t", F.lit(0)).alias("triangles"), F.coalesce("k", F.lit(0)).alias("neighbors"))
    return out.withColumn("clustering", clustering)


def triangle_count(graph: Graph) -> DataFrame:
    return triangles(graph).agg((F.sum("triangles") / 3).cast("long").alias("triangles"))


def local_clustering(graph: Graph) -> DataFrame:
    return triangles(graph).select("node_id", F.col("clustering").alias("score"))


def _peeled(lists: compact.Lists) -> np.ndarray:
    """Core numbers by position: what has the fewest neighbours left goes first; each list is gone through once."""
    left, core, there = np.diff(lists.start).astype(np.int32), np.zeros(len(lists.ids), np.int64), np.ones(len(lists.ids), bool)
    rest, k = np.arange(len(lists.ids)), 0
    while len(rest := rest[there[rest]]):
        k = max(k, int(left[rest].min()))
        front = rest[left[rest] <= k]
        while len(front):
            core[front], there[front] = k, False
            fresh = [np.zeros(0, np.int32)]
            for _, entry, _ in compact.entries_of(lists, front, 1 << 20):
                to = lists.to[entry]
                to = to[there[to]]
                np.subtract.at(left, to, 1)
                fresh.append(to[left[to] <= k])
            front = np.unique(np.concatenate(fresh))
    return core


def core_numbers(graph: Graph) -> DataFrame:
    """(node_id, core): nodes are peeled by degree; larger graphs take the fixpoint of each node's h-index over its neighbours' values."""
    if packed := compact.pack(graph.simple(), graph.nodes, mutual=True, most=compact.MOST_ONCE):
        return compact.alone(packed, lambda lists: [lists.ids[lists.own], _peeled(lists)[lists.own]], "node_id long, core long", graph.spark)
    simple = cut(graph.simple())
    core = cut(simple.groupBy("a").agg(F.count("*").alias("c")).withColumnRenamed("a", "node_id"))
    while True:
        values = simple.join(core.select(F.col("node_id").alias("b"), "c"), "b").groupBy(F.col("a").alias("node_id"), "c").agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("node_id").orderBy(F.desc("c")))
        h = values.withColumn("h", F.least(F.col("c"), above)).groupBy("node_id").agg(F.max("h").alias("h"))
        new = cut(core.join(h, "node_id").select("node_id", F.least("c", "h").alias("c"), F.col("c").alias("old")))
        same = new.where("c <> old").isEmpty()
        core = new.select("node_id", "c")
        if same:
            break
    return graph.nodes.select("node_id").join(core, "node_id", "left").select("node_id", F.coalesce("c", F.lit(0)).cast("long").alias("core"))
