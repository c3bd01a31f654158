"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

`fit` takes a bounded, documented sample of labelled rows (`per_class` a class, in the order of a hash), bins each
statistic at its quantiles, and grows depth-limited trees on binned gradients. `Forest` holds all trees as
flat arrays; a batch walks all of them at once, one level a step.

Edge cases: null and empty texts have all statistics 0 and get a score like any other; without labels of
both classes the score is the known class's share, or 0.5 without any label; repeated rows are scored one
by one; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import beside, SPACES, labelled, pieces

STATISTICS = (
    "log_words", "word_length", "symbols", "bangs", "capitals", "digits", "commas", "stops", "distinct", "doubled",
    "top_word", "line_words", "repeated_lines", "bars", "non_ascii", "quotes", "brackets", "spaces",
)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    gone = lambda kinds: len(data) - len(data.translate(None, kinds))
    lines = [x for x in data.split(b"\n") if x.strip()]
    spaces = gone(SPACES)
    counts = Counter(words)
    return [
        float(np.log1p(len(words))), (len(data) - spaces) / n, gone(b"#*$%&<>@^~") / n, data.count(b"!") / n, gone(_UPPER) / size,
        gone(_DIGIT) / size, data.count(b",") / n, gone(b".?") / n, len(counts) / n, sum(map(eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n, np.log1p(len(words) / max(1, len(lines))), (len(lines) - len(set(lines))) / max(1, len(lines)),
        data.count(b"|") / n, (len(data) - len(text or "")) / size, gone(b"\"'`") / n, gone(b"()[]{}=_/\\") / n, spaces / size,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth in arrays of shape (trees, nodes); a leaf's children are the leaf itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum over trees, for all rows and trees at once; memory is rows x trees integers."""
        if not len(self.value) or not len(x):
            return np.full(len(x), self.base)
        tree = np.arange(len(self.value))
        node = np.zeros((len(x), len(self.value)), np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_left = x[rows, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(go_left, self.left[tree, node], self.right[tree, node])
        return self.base + self.value[tree, node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0
) -> Forest:
    """Boost logistic loss. Every node's histogram of gradients and curvatures has `bins` cells a statistic."""
    total = weight.sum()
    if not total:
        return Forest(0.0, *[np.zeros((0, 1))] * 5, depth)
    share = float(np.clip((weight * y).sum() / total, 1e-4, 1 - 1e-4))
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    nodes = 2 ** (depth + 1) - 1
    made = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    raw = np.full(len(x), base)
    if not 0 < (weight * y).sum() < total:
        trees = 0
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold = np.zeros(nodes, np.int32), np.full(nodes, np.inf)
        left, right, value = np.arange(nodes, dtype=np.int32), np.arange(nodes, dtype=np.int32), np.zeros(nodes)
        node = np.zeros(len(x), np.int64)
        for level in range(depth + 1):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                if not len(at):
                    continue
                gs, hs = g[at].sum(), h[at].sum()
                value[k] = -rate * gs / (hs + ridge)
                if level == depth:
                    continue
                best = (1e-6, 0, 0)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    cell = binned[at, f]
                    gl = np.cumsum(np.bincount(cell, g[at], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(cell, h[at], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(cell, minlength=len(e) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(at) - nl < least)] = -1
                    b = int(gain.argmax())
                    best = max(best, (float(gain[b]), -f, -b))
                if best[0] > 1e-6:
                    f, b = -best[1], -best[2]
                    feature[k], threshold[k], left[k], right[k] = f, edges[f][b], 2 * k + 1, 2 * k + 2
                    node[at] = np.where(binned[at, f] <= b, 2 * k + 1, 2 * k + 2)
        raw += value[node]
        for name, array in zip(made, (feature, threshold, left, right, value)):
            made[name].append(array)
    if not trees:
        return Forest(base, *[np.zeros((0, nodes))] * 5, depth)
    return Forest(base, *[np.stack(made[k]) for k in made], depth)


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, per_class: int = 4000, **options) -> Forest:
    """Train on at most `per_class` labelled rows a class; only their statistics reach the driver."""
    sample = labelled(labels.select("doc_id", "quality"), "quality", parts, held, per_class)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id")  # 2 x per_class rows at most
    schema = "label int, weight double, doc_id bigint, x array<double>"

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = matrix(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "weight", "doc_id", "x"])

    rows = joined.select("label", "weight", "doc_id", "text").mapInArrow(measured, schema).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r["label"] for r in rows], float), np.array([r["weight"] for r in rows], float), **options)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score of every whole text. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # a few hundred kB, whatever the corpus

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = shared.value.score(matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id bigint, score double")


def good(docs: DataFrame, forest: Forest, least: float) -> DataFrame:
    """The rows of `docs` that score `least` or more. Each row is judged by its own text, whatever its doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    scored = beside(docs, lambda texts: [pa.array(shared.value.score(matrix(texts)), pa.float64())], "score double")
    return scored.where(F.col("score") >= least).select("_row.*")
