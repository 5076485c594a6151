"""Language ID by hierarchical discrimination.

A text is the relative frequencies of its hashed character 1-, 2- and 3-grams
(lower case, letters only, anything else a space).  One-versus-rest linear
support vector machines choose the language family; within the family one-versus-
one machines, one for each pair of its languages, vote, and the sum of their
margins settles a tie.  A gate before them rejects texts of no known language:
those without letters and those whose 3-grams were mostly never seen in training.

Machines are fitted on a bounded sample of labelled rows: at most PER_LANGUAGE of each
of the MOST_LANGUAGES labels with the most rows, drawn by a hash of doc_id; features are
counted on the executors.  Each sampled text also gives short pieces, so that short texts
are in domain.  Every row of the table is judged, whole.

Defined results: null, empty and letterless texts are "und" and not accepted; equal
texts and repeated rows get equal results, very long ones are read whole; of languages
with equal votes and margins the first by name is taken; without any labelled row every
text is "und", an empty table gives an empty result; with one language every text of
known 3-grams is that language.  Rows keep their columns, whatever they are called; a
null ``lang`` is filled in by ``accept_known``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Bound of the labelled sample, rows a language.
PER_LANGUAGE = 250
#: Bound of the languages that machines are fitted for.
MOST_LANGUAGES = 128
PIECES, PIECE_CHARS = 3, 60
BITS = 14
SEEN_BITS = 20
LEAST_SEEN = 0.5
UNKNOWN = "und"

FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr ne pa gu",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def _grams(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(letters of each text, for n = 1, 2, 3 (32-bit gram hashes, first gram of each text), ...)."""
    cp, at = T.code_points(texts)
    letter = _letters()[cp]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of a run of other characters the first stays, as a space
    index = np.flatnonzero(kept)
    c = np.where(letter[index], cp[index], np.uint32(32)).astype(np.uint32)
    first = np.searchsorted(index, at)
    h = np.zeros(len(c), np.uint32)
    out = []
    for n in (1, 2, 3):
        if n == 1:
            h = (c + np.uint32(0x9E37)) * np.uint32(0x85EBCA6B)
        else:
            h = h[:-1] * np.uint32(0x01000193) ^ (c[n - 1 :] + np.uint32(n)) * np.uint32(0xC2B2AE35)
        x = h ^ (h >> np.uint32(15))
        x = x * np.uint32(0x2C1B3C6D)
        out.append((x ^ (x >> np.uint32(13)), first))
    return T.reduce_by_doc(np.add, letter.astype(np.int64), at, 0), out, first


_letter_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter_table:
        _letter_table.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letter_table[0]


def _ranges(first: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each text's n-grams that don't reach into the next text."""
    lo = np.minimum(first[:-1], length)
    return lo, np.maximum(lo, np.minimum(first[1:] - (n - 1), length))


@dataclass
class Model:
    families: list[str]
    languages: list[str]
    family_of: np.ndarray  # family index of each language
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # float32, buckets x (family machines, then pair machines)
    bias: np.ndarray
    seen: np.ndarray  # bool, by hash of 3-gram

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[str | None], np.ndarray, np.ndarray]:
        """(language, family, margin, accepted) of each text."""
        lang: list[str] = []
        family: list[str | None] = []
        margins, accepted = [], []
        nf = len(self.families)
        for _, run in T.chunks(texts):
            letters, grams, first = _grams(run)
            score = np.zeros((len(run), self.weights.shape[1]))
            seen = np.zeros(len(run))
            for k, (h, _) in enumerate(grams):
                lo, hi = _ranges(first, k + 1, len(h))
                size = np.maximum(hi - lo, 1)
                bucket = (h >> np.uint32(32 - BITS)).astype(np.int64) + (k << BITS)
                w = np.concatenate((self.weights[bucket], np.zeros((1, self.weights.shape[1]), np.float32)))
                total = _between(w, lo, hi)
                score += total / size[:, None]
                if k == 2:
                    known = np.concatenate((self.seen[h >> np.uint32(32 - SEEN_BITS)].astype(np.int64), [0]))
                    seen = np.where(hi > lo, _between(known, lo, hi) / size, 1.0)
            score += self.bias
            ok = (letters > 0) & (seen >= LEAST_SEEN) & bool(self.languages)
            if not self.languages:
                best = np.zeros(len(run), np.int64)
                margin = np.zeros(len(run))
            else:
                fam = np.argmax(score[:, :nf], axis=1)
                votes = np.where(self.family_of[None, :] == fam[:, None], 0.0, -1e9)
                for j, (a, b) in enumerate(self.pairs):
                    m = score[:, nf + j]
                    votes[:, a] += (m > 0) + 1e-3 * np.tanh(m)
                    votes[:, b] += (m <= 0) - 1e-3 * np.tanh(m)
                best = np.argmax(votes, axis=1)
                margin = np.max(score[:, :nf], axis=1)
            for i in range(len(run)):
                lang.append(self.languages[best[i]] if ok[i] else UNKNOWN)
                family.append(self.families[self.family_of[best[i]]] if ok[i] else None)
            margins.append(np.where(ok, margin, 0.0))
            accepted.append(ok)
        if not margins:
            return [], [], np.zeros(0), np.zeros(0, bool)
        return lang, family, np.concatenate(margins), np.concatenate(accepted)


def _between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of values[lo:hi] for each pair; values has one more row at its end."""
    out = np.zeros((len(lo), *values.shape[1:]), np.float64)
    some = np.flatnonzero(hi > lo)
    if len(some):
        cuts = np.empty(2 * len(some), np.int64)
        cuts[0::2], cuts[1::2] = lo[some], hi[some]
        out[some] = np.add.reduceat(values, cuts, axis=0)[0::2]
    return out


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, relative frequencies) of each text, at most 3 << BITS of them however long it is."""
    out = []
    for text in texts:
        _, grams, first = _grams([text])
        ids, values = [], []
        for k, (h, _) in enumerate(grams):
            lo, hi = _ranges(first, k + 1, len(h))
            bucket, count = np.unique((h[lo[0] : hi[0]] >> np.uint32(32 - BITS)).astype(np.int64), return_counts=True)
            ids.append(bucket + (k << BITS))
            values.append(count / max(1, hi[0] - lo[0]))
        out.append((np.concatenate(ids), np.concatenate(values)))
    return out


def _seen_of(texts: list[str]) -> np.ndarray:
    _, grams, first = _grams(texts)
    h = grams[2][0]
    lo, hi = _ranges(first, 3, len(h))
    return np.unique(np.concatenate([h[a:b] for a, b in zip(lo, hi)] or [np.zeros(0, np.uint32)]) >> np.uint32(32 - SEEN_BITS))


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, buckets, frequencies, hashes of 3-grams) of sampled texts and pieces of them."""
    named = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    counts = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    share = counts.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(per_language + 4 * per_language**0.5) / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for lang, u, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                step = max(1, len(text) // PIECES)
                pieces = [text] + [text[i : i + PIECE_CHARS] for i in range(0, len(text), step)][:PIECES]
                for j, ((ids, values), piece) in enumerate(zip(_features(pieces), pieces)):
                    rows.append((lang, u, j, ids.tolist(), values.tolist(), _seen_of([piece]).tolist() if j == 0 else []))
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["lang", "u", "j", "ids", "freq", "seen"])

    drawn = named.select("lang", draw.alias("u"), "text")
    sample = drawn.join(F.broadcast(share), (F.col("lang") == F.col("_lang")) & (F.col("u") < F.col("share"))).select("lang", "u", "text")  # at most MOST_LANGUAGES rows are broadcast
    rows = sample.mapInArrow(make, "lang string, u double, j int, ids array<int>, freq array<float>, seen array<int>").toArrow()
    order = sorted(range(rows.num_rows), key=lambda i: (rows["lang"][i].as_py(), rows["u"][i].as_py(), rows["j"][i].as_py()))
    taken: dict[str, list[float]] = {}
    out = []
    for i in order:
        lang, u = rows["lang"][i].as_py(), rows["u"][i].as_py()
        of = taken.setdefault(lang, [])
        if u not in of[-1:]:
            if len(of) >= per_language:
                continue
            of.append(u)
        out.append((lang, np.array(rows["ids"][i].as_py(), np.int64), np.array(rows["freq"][i].as_py()), np.array(rows["seen"][i].as_py(), np.int64)))
    return out


@dataclass
class Rows:
    """A sparse matrix by rows: row i has values[first[i]:first[i + 1]] in the columns ids[first[i]:first[i + 1]]."""

    ids: np.ndarray
    values: np.ndarray
    first: np.ndarray
    width: int

    def of(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.first)[rows]
        first = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(first[-1]) + np.repeat(self.first[:-1][rows] - first[:-1], size)
        return Rows(self.ids[at], self.values[at], first, self.width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(self.values * w[self.ids], 0), self.first[:-1]) * (np.diff(self.first) > 0)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, self.values * np.repeat(g, np.diff(self.first)), self.width)


def _svm(x: Rows, y: np.ndarray, rounds: int = 80, c: float = 20.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine for y = +-1, classes weighted alike, by accelerated gradient descent."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(x.width), 0.0
    vw, vb, t = w.copy(), b, 1.0
    squares = Rows(x.ids, x.values**2, x.first, x.width).times(np.ones(x.width))
    lip = 1.0 + 2 * c * float((weight * (squares + 1)).sum())
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x.times(vw) + vb))
        g = -2 * c * weight * y * slack
        new_w, new_b = vw - (vw + x.transposed_times(g)) / lip, vb - float(g.sum()) / lip
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        k = (t - 1) / new_t
        vw, vb = new_w + k * (new_w - w), new_b + k * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the languages that occur in docs.lang."""
    rows = labelled_sample(docs, per_language)
    languages = sorted({r[0] for r in rows})
    family_name = [FAMILY_OF.get(x.lower().split("-")[0], "other:" + x) for x in languages]
    families = sorted(set(family_name))
    family_of = np.array([families.index(f) for f in family_name], np.int64)
    seen = np.zeros(1 << SEEN_BITS, bool)
    width = 3 << BITS
    ids = np.concatenate([r[1] for r in rows] or [np.zeros(0, np.int64)])
    used = np.unique(ids)  # buckets that occur; the others' weights are 0
    x = Rows(np.searchsorted(used, ids), np.concatenate([r[2] for r in rows] or [np.zeros(0)]).astype(np.float64), np.concatenate(([0], np.cumsum([len(r[1]) for r in rows]))).astype(np.int64), len(used))
    label = np.array([languages.index(r[0]) for r in rows], np.int64)
    for r in rows:
        seen[r[3]] = True
    scale = 1 / np.sqrt(x.transposed_times(np.ones(len(rows))) / len(rows) + 1e-5) if len(rows) else np.ones(len(used))
    x.values *= scale[x.ids]
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family_of[a] == family_of[b]]
    columns, bias = [], []
    done: dict[bytes, tuple[np.ndarray, float]] = {}
    for f in range(len(families)):
        inside = family_of[label] == f
        if inside.all():
            w, b = np.zeros(len(used)), 1.0
        else:
            key, other = inside.tobytes(), (~inside).tobytes()
            if other in done:
                w, b = -done[other][0], -done[other][1]
            else:
                w, b = done[key] = _svm(x, np.where(inside, 1.0, -1.0))
        columns.append(w * scale)
        bias.append(b)
    for a, b in pairs:
        rows_of = np.flatnonzero((label == a) | (label == b))
        w, c = _svm(x.of(rows_of), np.where(label[rows_of] == a, 1.0, -1.0))
        columns.append(w * scale)
        bias.append(c)
    weights = np.zeros((width, len(columns)), np.float32)
    if columns:
        weights[used] = np.stack(columns, 1)
    return Model(families, languages, family_of, pairs, weights, np.array(bias), seen)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, declared lang, predicted language and family, margin of the family, accepted, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, family, margin, ok = shared.value.classify(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(family, pa.string()), pa.array(margin, pa.float64()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "language", "family", "margin", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(make, "doc_id long, lang string, language string, family string, margin double, accepted boolean")


def accept_known(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without the texts that the gate rejects; a null lang becomes the predicted one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, where = batch.schema.get_field_index("text"), batch.schema.get_field_index("lang")
            lang, _, _, ok = shared.value.classify(batch.column(text).to_pylist())
            if batch.column(where).null_count:
                columns = list(batch.columns)
                columns[where] = pa.array([x if x is not None else y for x, y in zip(batch.column(where).to_pylist(), lang)], batch.schema.field(where).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch if ok.all() else batch.filter(pa.array(ok))

    return docs.mapInArrow(make, docs.schema)
