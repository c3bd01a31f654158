"""Toxicity by nearest labelled examples: exact TF-IDF cosine search over all words of the examples.

1. `count_words` takes every word of a bounded, documented sample of labelled rows (`per_class` a class, in the order
   of a hash), with the number of toxic and other examples that hold it. No word is left out.
2. `vectors` counts those words in every whole text; words that no example holds share one term, so that a vector also
   knows how much of a text they are. Document frequencies come from all texts. A word weighs its idf times
   `relevance`, which is least for a word spread evenly over both classes and never 0.
3. `Index` holds the labelled vectors, equal ones merged, as postings; the longest lists are kept as a dense matrix.
   A batch of texts is compared with all of them, so the result equals a full scan.
4. Votes are weighted by distance and mapped to probabilities by isotonic regression on leave-one-out votes.

Edge cases: null and empty texts have the empty vector; its score is the share of toxic rows among labelled texts
without any word, or the overall share if there are none. Ties go to the entry that comes first in the
index. Without labels the score is 0. Repeated rows are scored one by one, further columns are ignored, an empty table
gives an empty result. The score depends on the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .texts import labelled, pieces

#: Texts that are compared at once, and the most lists of the index that are kept dense.
BLOCK = 64
DENSE = 512
_LETTERS = re.compile(r"[^\W\d_]+")


def _held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: word, and how many texts with label 1 and label 0 hold it."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in pieces(batches, "text"):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[0 if label else 1].update(set(_LETTERS.findall((text or "").lower())))
    terms = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in counts]], names=["term", "toxic", "other"])


def count_words(texts: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All words of the labelled texts, sorted, and the numbers of toxic and other texts that hold them."""
    rows = texts.select("text", "label").mapInArrow(_held, "term string, toxic bigint, other bigint")
    got = rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow().sort_by("term")
    return got["term"].to_pylist(), got["toxic"].to_numpy(), got["other"].to_numpy()


def relevance(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """1/2 and the fourth power of how many standard errors a word's log rate among toxic texts is above that among others."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    return 0.5 + np.maximum(0.0, ratio / np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))) ** 4


def counter(terms: list[str]):
    number = {term: k for k, term in enumerate(terms)}

    def count(text: str | None) -> tuple[int, dict[int, int]]:
        """Number of words, and counts of the terms among them."""
        words = Counter(_LETTERS.findall((text or "").lower()))
        return len((text or "").split()), {number[w]: n for w, n in words.items() if w in number}

    return count


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n_words, terms array<int> (ascending), counts array<int>. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def vector(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        for batch in pieces(batches, "text"):
            rows = [count(t) for t in batch.column(1).to_pylist()]
            keys = [sorted(f) for _, f in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array(keys, pa.list_(pa.int32())),
                 pa.array([[f[k] for k in ks] for ks, (_, f) in zip(keys, rows)], pa.list_(pa.int32()))],
                names=["doc_id", "n_words", "terms", "counts"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(vector, "doc_id bigint, n_words bigint, terms array<int>, counts array<int>")


def weigh_all(n_words: np.ndarray, cuts: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit vectors of texts whose terms (ascending) lie between their cuts: cuts, terms and weights; term len(idf) - 1 stands for all other words."""
    size = np.diff(cuts)
    rest = n_words - np.bincount(np.repeat(np.arange(len(size)), size), counts, minlength=len(size))
    more = rest > 0
    raw = np.insert(np.sqrt(counts.astype(np.float64)) * idf[terms], cuts[1:][more], rest[more] ** 0.5 * idf[-1])
    terms = np.insert(terms.astype(np.int64), cuts[1:][more], len(idf) - 1)
    cuts = np.r_[0, np.cumsum(size + more)]
    full = np.flatnonzero(np.diff(cuts))
    norm = np.sqrt(np.add.reduceat(raw * raw, cuts[full])) if len(full) else np.zeros(0)
    return cuts, terms, np.round(raw / np.repeat(norm, np.diff(cuts)[full]), 9)


def weigh(n_words: int, terms: Iterable[int], counts: Iterable[int], idf: np.ndarray) -> tuple[tuple[int, float], ...]:
    """The unit vector of a text as (term, weight)."""
    keys, times = np.array(terms, np.int64), np.array(counts, np.float64)
    order = np.argsort(keys)
    _, keys, weights = weigh_all(np.array([n_words]), np.array([0, len(keys)]), keys[order], times[order], idf)
    return tuple(zip(keys.tolist(), weights.tolist()))


@dataclass
class Index:
    """Entries are distinct unit vectors with the weights of their toxic and other examples.

    Entry i is `cuts[i]` to `cuts[i + 1]` of `keys` and `weights`. The list of term k is `first[k]` to `first[k + 1]` of
    `ids` and `impacts`; where `place[k]` is not -1 it is that row of `matrix`.
    """

    cuts: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    toxic: np.ndarray
    other: np.ndarray
    examples: list[list[int]]
    first: np.ndarray
    ids: np.ndarray
    impacts: np.ndarray
    place: np.ndarray
    matrix: np.ndarray

    @classmethod
    def build(cls, rows: Iterable[tuple[int, tuple, int, float]], n_terms: int) -> Index:
        """rows: doc_id, unit vector, label, weight."""
        merged: dict[tuple[bytes, bytes], list] = {}
        for doc_id, vector, label, weight in rows:
            if vector:
                keys, weights = zip(*vector)
                e = merged.setdefault((np.array(keys, np.int32).tobytes(), np.array(weights, np.float64).tobytes()), [0.0, 0.0, []])
                e[0 if label else 1] += weight
                e[2].append(doc_id)
        for e in merged.values():
            e[2].sort()
        found = sorted(merged.items(), key=lambda x: (x[1][2], x[0]))
        n = len(found)
        keys = np.frombuffer(b"".join([v[0] for v, _ in found]), np.int32)
        weights = np.frombuffer(b"".join([v[1] for v, _ in found]), np.float64)
        length = np.array([len(v[0]) // 4 for v, _ in found], np.int64)
        order = np.argsort(keys, kind="stable")
        ids, impacts = np.repeat(np.arange(n, dtype=np.int32), length)[order], weights[order]
        first = np.searchsorted(keys[order], np.arange(n_terms + 1))
        size = np.diff(first)
        dense = np.argsort(-size, kind="stable")[:DENSE]
        dense = dense[8 * size[dense] > n]
        place, matrix = np.full(n_terms, -1), np.zeros((len(dense), n))
        place[dense] = np.arange(len(dense))
        for row, k in enumerate(dense):
            matrix[row, ids[first[k] : first[k + 1]]] = impacts[first[k] : first[k + 1]]
        amounts = np.array([e[:2] for _, e in found], np.float64).reshape(-1, 2)
        return cls(np.r_[0, np.cumsum(length)], keys, weights, amounts[:, 0], amounts[:, 1], [e[2][:3] for _, e in found], first, ids, impacts, place, matrix)

    @property
    def entries(self) -> Iterator[tuple[tuple[int, float], ...]]:
        for a, z in zip(self.cuts[:-1], self.cuts[1:]):
            yield tuple(zip(self.keys[a:z].tolist(), self.weights[a:z].tolist()))

    def cosines(self, cuts: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Queries x entries; query i is `cuts[i]` to `cuts[i + 1]` of `keys` and `weights`."""
        n, many = len(self.toxic), len(cuts) - 1
        owner = np.repeat(np.arange(many), np.diff(cuts))
        row = self.place[keys]
        known = np.zeros((many, len(self.matrix)))
        known[owner[row >= 0], row[row >= 0]] = weights[row >= 0]
        owner, keys, weights = owner[row < 0], keys[row < 0], weights[row < 0]
        size = self.first[keys + 1] - self.first[keys]
        at = np.arange(size.sum()) + np.repeat(self.first[keys] - np.cumsum(size) + size, size)
        sparse = np.bincount(np.repeat(owner * n, size) + self.ids[at], weights=np.repeat(weights, size) * self.impacts[at], minlength=many * n)
        return known @ self.matrix + sparse.reshape(many, n)

    def nearest_all(self, cuts: np.ndarray, keys: np.ndarray, weights: np.ndarray, enough: float) -> Iterator[list[tuple[float, int]]]:
        """For each query (cosine, entry), nearest first: the fewest entries that hold examples of weight `enough`."""
        weight = self.toxic + self.other
        for first in range(0, len(cuts) - 1, BLOCK):
            some = cuts[first : first + BLOCK + 1]
            if not len(weight):
                yield from ([] for _ in some[1:])
                continue
            for scores in self.cosines(some - some[0], keys[some[0] : some[-1]], weights[some[0] : some[-1]]):
                many = 32
                while True:
                    least = np.partition(scores, -many)[-many] if many < len(scores) else 0.0
                    found = np.flatnonzero((scores >= least - 2e-9) & (scores > 0))
                    value = np.round(scores[found], 9)
                    order = np.lexsort((found, -value))
                    held = np.cumsum(weight[found[order]])
                    last = int(np.searchsorted(held, enough))
                    # those of an equal cosine are all found, if one is
                    if last < len(held) and last < many or many >= len(scores):
                        break
                    many *= 4
                yield [(float(value[j]), int(found[j])) for j in order[: last + 1]]

    def nearest(self, query: tuple[tuple[int, float], ...], enough: float) -> list[tuple[float, int]]:
        keys, weights = np.array([k for k, _ in query], np.int64), np.array([w for _, w in query], np.float64)
        return next(self.nearest_all(np.array([0, len(keys)]), keys, weights, enough))

    def vote(self, near: list[tuple[float, int]], without: tuple[int, float, float] | None = None) -> float | None:
        """Share of toxic weight among the neighbours, each divided by its distance."""
        up = down = 0.0
        for s, i in near:
            t, o = self.toxic[i], self.other[i]
            if without and without[0] == i:
                t, o = t - without[1], o - without[2]
            near_weight = 1.0 / (0.05 + max(0.0, 2 - 2 * s) ** 0.5)
            up, down = up + near_weight * t, down + near_weight * (t + o)
        return up / down if down > 1e-9 else None


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression of y on x by pooling adjacent violators: steps (x, value)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b * c
            pools[-1][2] += c
        else:
            pools.append([a, b * c, c])
    out: list[list[float]] = []
    for a, s, c in pools:
        out.append([a, a, s, c])
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    xs = np.array([v for p in out for v in (p[0], p[1])])
    return xs, np.array([p[2] / p[3] for p in out for _ in range(2)])


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    index: Index
    steps: tuple[np.ndarray, np.ndarray]
    empty: float
    enough: float

    def score_all(self, n_words: np.ndarray, cuts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> list[tuple[float, list[int], list[float]]]:
        """Score and evidence of texts whose terms and counts lie between their cuts."""
        out = []
        for near in self.index.nearest_all(*weigh_all(n_words, cuts, terms, counts, self.idf), self.enough):
            vote = self.index.vote(near)
            if vote is None:
                out.append((self.empty, [], []))
                continue
            p = float(np.interp(vote, *self.steps)) if len(self.steps[0]) else vote
            out.append((p, [self.index.examples[i][0] for _, i in near[:5]], [s for s, _ in near[:5]]))
        return out


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, per_class: int = 4000, neighbours: int = 25) -> tuple[Model, DataFrame]:
    """The model, and the vectors of all documents, staged once."""
    sample = stage(labelled(labels.select("doc_id", "toxic"), "toxic", parts, held, per_class), "sample")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = stage(rows.join(F.broadcast(sample), "doc_id"), "labelled_texts")  # 2 x per_class rows at most
    terms, toxic, other = count_words(texts)
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    counted = stage(vectors(docs, terms), "vectors")
    n_docs = counted.count()
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()  # len(terms) rows
    df = np.zeros(len(terms))
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    idf = np.r_[(np.log((1 + n_docs) / (1 + df)) + 1) * relevance(toxic, other, n.get(1, 0), n.get(0, 0)), 1.0]
    got = counted.join(F.broadcast(sample), "doc_id").select("doc_id", "n_words", "terms", "counts", "label", "weight").toArrow()
    rows = (row for batch in got.to_batches(max_chunksize=256) for row in zip(*[c.to_pylist() for c in batch.columns]))
    return assemble(terms, idf, rows, neighbours), counted


def assemble(terms: list[str], idf: np.ndarray, rows: Iterable[tuple], neighbours: int = 25) -> Model:
    """rows: doc_id, n_words, terms, counts, label, weight of the labelled sample."""
    seen: list[tuple[bool, int, float]] = []

    def weighed() -> Iterator[tuple[int, tuple, int, float]]:
        for doc_id, n_words, keys, counts, label, weight in rows:
            vector = weigh(n_words, keys, counts, idf)
            seen.append((not vector, label, weight))
            yield doc_id, vector, label, weight

    index = Index.build(weighed(), len(idf))
    total, toxic = sum(r[2] for r in seen), sum(r[2] for r in seen if r[1])
    bare = [r[1:] for r in seen if r[0]]
    empty = sum(w for y, w in bare if y) / sum(w for _, w in bare) if bare else (toxic / total if total else 0.0)
    enough = float(neighbours)
    x, y, w = [], [], []
    for i, near in enumerate(index.nearest_all(index.cuts, index.keys, index.weights, enough + 1)):
        for label, amount in ((1.0, index.toxic[i]), (0.0, index.other[i])):
            if amount > 0:
                one = min(1.0, amount)
                vote = index.vote(near, (i, one * label, one * (1 - label)))
                if vote is not None:
                    x.append(vote)
                    y.append(label)
                    w.append(amount)
    return Model(terms, idf, index, isotonic(np.array(x), np.array(y), np.array(w)), empty, enough)


def score(counted: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (doc_ids of the nearest examples), cosines. Reads the staged vectors alone."""
    index = replace(model.index, keys=np.zeros(0, np.int32), weights=np.zeros(0))  # the search needs neither these nor the words
    slim = replace(model, terms=[], index=index)
    shared = counted.sparkSession.sparkContext.broadcast(slim)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a in range(0, batch.num_rows, 1024):
                n_words, terms, counts = (batch.column(k).slice(a, 1024) for k in (1, 2, 3))
                cuts = np.r_[0, np.cumsum(pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False))]
                out += shared.value.score_all(n_words.to_numpy(), cuts, terms.flatten().to_numpy(), counts.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                names=["doc_id", "score", "evidence", "cosines"],
            )

    return counted.select("doc_id", "n_words", "terms", "counts").mapInArrow(scored, "doc_id bigint, score double, evidence array<bigint>, cosines array<double>")
