"""MinHash near-dedup by an LSH forest.

A text is the set of its runs of three words; 128 minima of that set under
random linear functions are its signature.  The signature is cut to 16 trees of
8 labels.  In each tree the documents are sorted by their label sequence, as one
shuffle on the first labels and a sort within; documents that share a prefix are
a region of the tree.  Depth adapts by region: a region of up to LEAF documents
at the least depth is compared as it is, a larger one is taken apart by the next
label, and so on down to the last label.  Longest-common-prefix neighbours in these
leaves are the candidates; a pair counts if the share of equal minima, estimated
from 4 bits of each of the 128, reaches the threshold.  Groups are the connected
components of those pairs; texts of equal signatures (64 bits of which stand for
them), exact copies among them, are one node from the start.

A leaf has no size limit, and its components are those of all its pairs.  Up to LEAF
documents all pairs are compared.  Beyond that each document joins the first pivot that
it resembles or becomes one; members of different pivots are then compared wherever the
triangle inequality of the distances doesn't rule a link out.  Leaves of more than BLOCK
documents are met block by block, blocks wait in the shared folder.  Regions that a bounded
sample proves to be larger than LEAF are shuffled by more labels, which spreads them over
tasks and changes no result, since they are taken apart by these labels anyway.

Defined results: a text without words (null, empty, only signs) is its own
group; a text of one or two words is one shingle; very long texts are taken whole;
of a group the row with the least doc_id (nulls last), then the least text hash, stays,
and of ties and rows that are repeated whole exactly one; an empty table gives an empty
result; further columns pass through, whatever they are called.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import cut, file_key, keep_one, shared_folder, text_key

SHINGLE = 3
TREES, DEPTH = 16, 8
LEAST_DEPTH = 3
LEAF = 48
THRESHOLD = 0.6
#: Records of one leaf or region that a worker holds at once.
BLOCK = 1 << 17
#: Nodes whose labels are counted on the driver to find large regions, about; without influence on results.
REGION_SAMPLE = 1 << 14
_K = TREES * DEPTH
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 1 << 63, _K, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, _K, dtype=np.int64).astype(np.uint64)


def signature_matrix(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(uint32 signatures, one row a text; which texts have words)."""
    sigs, some = [], []
    for _, run in T.chunks(texts):
        w = T.split_words(run)
        count = w.count()
        hashes, at = w.windows(SHINGLE)
        doc = w.doc[at].astype(np.int64)
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            extra = [T.mix(np.array([np.sum(w.hashes[w.first[d] : w.first[d + 1]] * np.array([3, 5], np.uint64)[: count[d]], dtype=np.uint64)]))[0] for d in short]
            hashes, doc = np.concatenate((hashes, np.array(extra, np.uint64))), np.concatenate((doc, short))
            order = np.argsort(doc, kind="stable")
            hashes, doc = hashes[order], doc[order]
        first = np.searchsorted(doc, np.arange(len(run) + 1))
        sig = np.zeros((len(run), _K), np.uint32)
        live = np.flatnonzero(first[1:] > first[:-1])
        if len(live):
            starts = first[:-1][live]
            buffer = np.empty_like(hashes)
            for k in range(_K):
                np.multiply(hashes, _A[k], out=buffer)
                np.add(buffer, _B[k], out=buffer)
                sig[live, k] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
        sigs.append(sig)
        some.append(count > 0)
    if not sigs:
        return np.zeros((0, _K), np.uint32), np.zeros(0, bool)
    return np.concatenate(sigs), np.concatenate(some)


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a byte matrix."""
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width // np.dtype(dtype).itemsize), dtype)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * width].view(dtype).reshape(len(column), -1)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th: 64 bits of the text, file, sig: 512 bytes, null without words) for each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, some = signature_matrix(batch.column(3).to_pylist())
            packed = _fixed(sig.view(np.uint8).reshape(len(sig), -1)) if len(sig) else pa.array([], pa.binary())
            packed = pa.array([None] * len(sig), pa.binary()) if not some.any() else packed if some.all() else pc.if_else(pa.array(some), packed, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["doc_id", "th", "file", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), file_key().alias("file"), "text")
    return rows.mapInArrow(make, "doc_id long, th long, file long, sig binary")


def _prefixes(labels: np.ndarray, tree: int, upto: int = LEAST_DEPTH) -> np.ndarray:
    """64 bits of the first `upto` labels of a tree."""
    key = np.full(len(labels), tree + 1, np.uint64)
    for d in range(upto):
        key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + labels[:, d])
    return key


def large_prefixes(sigs: DataFrame, n: int, sample: int = REGION_SAMPLE, leaf: int = LEAF) -> np.ndarray:
    """Sorted 64 bits of prefixes of which more than LEAF records are in a sample: these regions are surely larger than LEAF."""
    share = min(1.0, sample / max(1, n))
    drawn = sigs.where("sig IS NOT NULL").where(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("node", "sig").dropDuplicates(["node"]).toArrow()
    if not drawn.num_rows:
        return np.zeros(0, np.uint64)
    sig, out = _matrix(drawn["sig"].combine_chunks(), 4 * _K, np.uint32), []
    for t in range(TREES):
        for depth in range(LEAST_DEPTH, DEPTH):
            key, count = np.unique(_prefixes(sig[:, t * DEPTH : (t + 1) * DEPTH], t, depth), return_counts=True)
            out.append(key[count > leaf])
    return np.sort(np.concatenate(out))


def forest_records(nodes: DataFrame, large: np.ndarray | None = None) -> DataFrame:
    """A record for each node (node, sig) and tree: region (64 bits of so many labels), label sequence, sketch of the whole signature.

    A region has the least depth, or, where prefixes are known to be large, one label more than the longest large one.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if large is None else large)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                node = part.column(0).to_numpy(zero_copy_only=False)
                sig = _matrix(part.column(1), 4 * _K, np.uint32)
                low = (sig & np.uint32(15)).astype(np.uint8)
                sketch = _fixed(low[:, 0::2] | (low[:, 1::2] << np.uint8(4)))
                for t in range(TREES):
                    labels = np.ascontiguousarray(sig[:, t * DEPTH : (t + 1) * DEPTH])
                    key = _prefixes(labels, t)
                    depth = np.full(len(node), LEAST_DEPTH, np.int8)
                    deeper = np.arange(len(node))
                    for d in range(LEAST_DEPTH, DEPTH if len(known) else 0):
                        deeper = deeper[known[np.minimum(np.searchsorted(known, key[deeper]), len(known) - 1)] == key[deeper]]
                        if not len(deeper):
                            break
                        key[deeper] = T.mix(key[deeper] * np.uint64(0x9E3779B97F4A7C15) + labels[deeper, d])
                        depth[deeper] = d + 1
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(depth), _fixed(labels.byteswap().view(np.uint8)), pa.array(node), sketch], ["region", "depth", "labels", "node", "sketch"])

    return nodes.mapInArrow(make, "region long, depth byte, labels binary, node long, sketch binary")


def most_mismatches(threshold: float) -> int:
    """How many of the minima may differ in their 4 bits for their share to be estimated as at least the threshold."""
    return int(np.floor(_K * (1 - 1 / 16 - threshold * 15 / 16) + 1e-9))


def _mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of minima whose 4 bits differ, for sketches as eight 64-bit words; a metric."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    x &= np.uint64(0x1111111111111111)
    return np.bitwise_count(x).sum(-1, dtype=np.int32)


def leaves(region: np.ndarray, labels: np.ndarray, leaf: int = LEAF, least: int | np.ndarray = LEAST_DEPTH) -> np.ndarray:
    """A leaf number for each record of sorted records, by adaptive depth from `least` on; -1 where a record is alone."""
    n = len(region)
    out = np.full(n, -1, np.int64)
    common = np.zeros(n, np.int64)  # labels in common with the record before, 0 across regions
    if n > 1:
        same = (labels[1:] == labels[:-1]) & (region[1:] == region[:-1])[:, None]
        common[1:] = np.cumprod(same, axis=1, dtype=np.int8).sum(1)
    open_ = np.ones(n, bool)
    base = 0
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        run = np.cumsum(common < depth) - 1
        size = np.bincount(run)[run]
        done = open_ & ((size <= leaf) | (depth == DEPTH)) & (depth >= least)
        out[done] = np.where(size[done] > 1, base + run[done], -1)
        open_ &= ~done
        base += n
    return out


def _link(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index in each component of the pairs."""
    while len(a):
        before = lab.copy()
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, a, low)
        np.minimum.at(lab, b, low)
        lab = lab[lab]
        if np.array_equal(before, lab):
            break
    return lab


class Clusters:
    """A large leaf: records join the first pivot within `most` mismatches or become one."""

    def __init__(self, most: int):
        self.most, self.pivot, self.node, self.radius = most, np.zeros((0, _K // 16), np.uint64), [], np.zeros(0, np.int32)

    def add(self, node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, mismatches with its pivot) of each record."""
        cluster, off = np.full(len(node), -1), np.zeros(len(node), np.int32)
        free, c = np.arange(len(node)), 0
        while len(free):
            if c == len(self.node):
                self.pivot, self.radius = np.concatenate((self.pivot, sketch[free[:1]])), np.append(self.radius, 0)
                self.node.append(int(node[free[0]]))
            d = _mismatches(sketch[free], self.pivot[c])
            near = d <= self.most
            cluster[free[near]], off[free[near]] = c, d[near]
            self.radius[c] = max(self.radius[c], d[near].max(initial=0))
            free, c = free[~near], c + 1
        return cluster, off

    def open_pairs(self) -> list[tuple[int, int, int]]:
        """(cluster, cluster, mismatches of their pivots) of those whose members could still be linked."""
        out = []
        for i in range(len(self.node) - 1):
            d, reach = _mismatches(self.pivot[i + 1 :], self.pivot[i]), self.radius[i] + self.radius[i + 1 :]
            out += [(i, i + 1 + int(j), int(d[j])) for j in np.flatnonzero((d <= self.most + reach) & (reach > 0))]
        return out


Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # sketch, cluster, mismatches with the pivot


def _crossing(most: int, pairs: list[tuple[int, int, int]], root: list[int], a: Block, b: Block) -> None:
    """Unite in root the clusters of a pair of which a member in one block resembles a member in the other."""

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def members(block: Block) -> dict[int, np.ndarray]:
        order = np.argsort(block[1], kind="stable")
        which, first = np.unique(block[1][order], return_index=True)
        return dict(zip(which.tolist(), np.split(order, first[1:])))

    of_a = members(a)
    of_b = of_a if a is b else members(b)
    none = np.zeros(0, np.int64)
    for i, j, d in pairs:
        if find(i) == find(j):
            continue
        for x, y in ((of_a.get(i, none), of_b.get(j, none)), (of_b.get(i, none), of_a.get(j, none)))[: 1 if a is b else 2]:
            if not len(x) or not len(y):
                continue
            xb, yb = (a, b) if x is of_a.get(i) else (b, a)
            x = x[xb[2][x] >= d - most - int(yb[2][y].max())]
            y = y[yb[2][y] >= d - most - int(xb[2][x].max(initial=0))] if len(x) else none
            step = max(1, (1 << 18) // max(1, len(y)))
            if any((_mismatches(xb[0][x[k : k + step], None], yb[0][None, y[m : m + (1 << 18)]]) <= most).any() for k in range(0, len(x), step) for m in range(0, len(y), 1 << 18)):
                root[find(j)] = find(i)
                break


def leaf_components(leaf_of: np.ndarray, sketch: np.ndarray, threshold: float = THRESHOLD, leaf: int = LEAF) -> np.ndarray:
    """For each record the index of the first record that it is connected to by pairs within its leaf."""
    lab, most = np.arange(len(leaf_of)), most_mismatches(threshold)
    used = np.flatnonzero(leaf_of >= 0)
    if not len(used):
        return lab
    runs, size = np.unique(leaf_of[used], return_counts=True)
    order = used[np.argsort(leaf_of[used], kind="stable")]
    of, big = leaf_of[order], np.repeat(size > leaf, size)
    pairs_a, pairs_b = [], []
    small, small_of = order[~big], of[~big]
    for gap in range(1, min(int(size[size <= leaf].max(initial=1)), len(small))):
        i = np.flatnonzero(small_of[gap:] == small_of[:-gap])
        for at in range(0, len(i), 1 << 16):
            j = i[at : at + (1 << 16)]
            a, b = small[j], small[j + gap]
            ok = _mismatches(sketch[a], sketch[b]) <= most
            pairs_a.append(a[ok])
            pairs_b.append(b[ok])
    starts = np.concatenate(([0], np.cumsum(size)))
    for r in np.flatnonzero(size > leaf):
        members = order[starts[r] : starts[r + 1]]
        found = Clusters(most)
        cluster, off = found.add(members, sketch[members])
        root = list(range(len(found.node)))
        block = sketch[members], cluster, off
        _crossing(most, found.open_pairs(), root, block, block)
        pivots = np.array(found.node)
        pairs_a += [members, pivots]
        pairs_b += [pivots[cluster], pivots[np.array(root)]]
    return _link(lab, np.concatenate(pairs_a), np.concatenate(pairs_b)) if pairs_a else lab


class _LargeRegion:
    """A region of more than BLOCK records, which come sorted: parts that share more labels are settled as they end.

    depth: what is held shares so many labels, and fewer are known to be shared by more than BLOCK records.
    """

    def __init__(self, threshold: float, depth: int, folder: str):
        self.threshold, self.most, self.depth, self.folder = threshold, most_mismatches(threshold), depth, folder
        self.labels, self.node, self.sketch = np.zeros((0, DEPTH), np.uint32), np.zeros(0, np.int64), np.zeros((0, _K // 16), np.uint64)
        self.leaf: Clusters | None = None
        self.blocks: list[str] = []

    def take(self, labels: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked (a, b); labels must not come before what was taken."""
        while len(node):
            if not len(self.node) and self.leaf is None:
                self.own = labels[0]
            n = int((labels[:, : self.depth] == self.own[: self.depth]).all(1).sum())
            if n:
                self.labels, self.node, self.sketch = np.concatenate((self.labels, labels[:n])), np.concatenate((self.node, node[:n])), np.concatenate((self.sketch, sketch[:n]))
                while len(self.node) > BLOCK:
                    yield from self._deepen()
            if n < len(node):
                yield from self.end()
                self.depth = int(np.cumprod(labels[n] == self.own).sum()) + 1
                self.depth = min(self.depth, DEPTH)
            labels, node, sketch = labels[n:], node[n:], sketch[n:]

    def _settle(self, n: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node = self.node[:n]
        lab = leaf_components(leaves(np.zeros(n, np.int64), self.labels[:n], least=least), self.sketch[:n], self.threshold)
        yield node, node[lab]
        self.labels, self.node, self.sketch = self.labels[n:], self.node[n:], self.sketch[n:]

    def _deepen(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.depth == DEPTH:
            self.leaf = self.leaf or Clusters(self.most)
            cluster, off = self.leaf.add(self.node, self.sketch)
            yield self.node, np.array(self.leaf.node)[cluster]
            where, root = fs.FileSystem.from_uri(self.folder)
            self.blocks.append(f"{root}/leaf-{uuid.uuid4().hex}")
            with where.open_output_stream(self.blocks[-1]) as out, io.BytesIO() as held:
                np.savez(held, sketch=self.sketch, cluster=cluster, off=off)
                out.write(held.getvalue())
            self.labels, self.node, self.sketch = self.labels[:0], self.node[:0], self.sketch[:0]
            return
        last = self.labels[-1]
        first = len(self.labels) - int((self.labels[:, : self.depth + 1] == last[: self.depth + 1]).all(1).sum())
        if first:
            yield from self._settle(first, self.depth + 1)
        self.depth, self.own = self.depth + 1, last

    def end(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is left of the part that shares `depth` labels."""
        if self.leaf is None:
            if len(self.node):
                yield from self._settle(len(self.node), self.depth)
            return
        if len(self.node):
            yield from self._deepen()
        pairs, root = self.leaf.open_pairs(), list(range(len(self.leaf.node)))
        where, _ = fs.FileSystem.from_uri(self.folder)

        def read(path: str) -> Block:
            with where.open_input_stream(path) as f:
                x = np.load(io.BytesIO(f.read()))
                return x["sketch"], x["cluster"], x["off"]

        for k, path in enumerate(self.blocks if pairs else ()):
            a = read(path)
            for other in self.blocks[k:]:
                _crossing(self.most, pairs, root, a, a if other == path else read(other))
        nodes = np.array(self.leaf.node)
        yield nodes, nodes[np.array(root)]
        for path in self.blocks:
            where.delete_file(path)
        self.leaf, self.blocks = None, []


def near_edges(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) with b < a: nodes linked in some leaf of some tree."""
    folder = shared_folder(records.sparkSession)

    def arrays(batch: pa.RecordBatch):
        return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2), 4 * DEPTH, np.dtype(">u4")), batch.column(3).to_numpy(zero_copy_only=False), _matrix(batch.column(4), _K // 2, np.uint64)

    def edges(node: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        i = np.flatnonzero(node != other)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], other[i])), pa.array(np.minimum(node[i], other[i]))], ["a", "b"])

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        region, depth, labels, node, sketch = (np.concatenate(x) for x in zip(*parts))
        return edges(node, node[leaf_components(leaves(region, labels, least=depth), sketch, threshold)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        large: _LargeRegion | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = arrays(batch)
            open_region = kept[-1][0][-1] if kept else large_of if large else None
            same = int(np.searchsorted(now[0], open_region, side="right") - np.searchsorted(now[0], open_region)) if open_region is not None and now[0][0] == open_region else 0
            if same:  # the open region goes on
                part = tuple(x[:same] for x in now)
                if large:
                    yield from (edges(*e) for e in large.take(part[2], part[3], part[4]))
                else:
                    kept.append(part)
                    if sum(len(x[0]) for x in kept) > BLOCK:
                        large, large_of = _LargeRegion(threshold, int(part[1][0]), folder), open_region
                        for x in kept:
                            yield from (edges(*e) for e in large.take(x[2], x[3], x[4]))
                        kept = []
            if same < len(now[0]):
                if large:
                    yield from (edges(*e) for e in large.end())
                    large = None
                last = int(np.searchsorted(now[0], now[0][-1]))  # the last region may go on in the next batch
                last = max(last, same)
                if last > same:
                    kept.append(tuple(x[same:last] for x in now))
                if kept:
                    yield flush(kept)
                kept = [tuple(x[last:] for x in now)]
        if large:
            yield from (edges(*e) for e in large.end())
        if kept:
            yield flush(kept)

    ordered = records.repartition("region").sortWithinPartitions("region", "labels")
    return ordered.mapInArrow(make, "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the edges, by alternating large and small stars until nothing changes.

    Minima are aggregated before they are joined back, so a hub costs no task more than its share.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    mark = state(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = cut(small)
        new = state(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, th, file, group_id (the least doc_id of the group), group_size, keep, kept_th."""
    sigs = signatures(docs).withColumn("node", F.when(F.col("sig").isNotNull(), F.xxhash64("sig"))).withColumn("row", F.monotonically_increasing_id())
    sigs = cut(sigs)
    nodes = sigs.where("sig IS NOT NULL").select("node", "sig").dropDuplicates(["node"])
    found = components(near_edges(forest_records(nodes, large_prefixes(sigs, sigs.count())), threshold))
    rows = sigs.select("doc_id", "th", "file", "node", "row")
    wordy = rows.where("node IS NOT NULL").join(found, "node", "left").select("doc_id", "th", "file", "row", F.coalesce("component", "node").alias("g"))
    of = wordy.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "row")).alias("first"), F.count("*").alias("group_size"))
    grouped = wordy.join(of, "g").select("doc_id", "th", "file", F.col("first")["doc_id"].alias("group_id"), "group_size", (F.col("row") == F.col("first")["row"]).alias("keep"), F.col("first")["th"].alias("kept_th"))
    alone = rows.where("node IS NULL").select("doc_id", "th", "file", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"), F.col("th").alias("kept_th"))
    return grouped.unionByName(alone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, group_id, group_size, keep for each row of docs."""
    return near_groups(docs, threshold).select("doc_id", "group_id", "group_size", "keep")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one row of each group."""
    return keep_one(docs, near_groups(docs, threshold))
