"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of length 1 to 3. The kernel of two texts is the number of
n-grams both hold, divided by the geometric mean of the two counts. `fit` draws landmark texts from a bounded,
documented sample (`per_class` rows a language, in the order of a hash), maps the sample into the Nystroem
feature space of the landmarks, and solves one-versus-rest kernel ridge regression there, every language with
the same total weight. A batch is scored by one product: presence matrix x landmark matrix x coefficients.

Characters become 64 symbols: one for everything that is no letter (runs count once), the 47 commonest lower-case
letters of the landmarks, and 16 groups of neighbouring code points for all other letters.

Edge cases: a null text or one without a letter is `und` with score 0, as is everything if there is nothing to learn
from; repeated rows are predicted one by one; very long texts cost in proportion to their length and use the
same fixed memory; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import pieces

UNKNOWN = "und"
_SYMBOLS = 64
_GRAMS = _SYMBOLS + _SYMBOLS**2 + _SYMBOLS**3
SHARPNESS = 4.0
SLICES = 64


def symbol_table(letters: Iterable[str]) -> np.ndarray:
    """Symbol of each code point: 0 no letter, 1-47 the given letters, 48-63 groups of other letters."""
    table = np.zeros(0x110000, np.uint8)
    codes = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    table[codes] = 48 + (codes >> 7) % 16
    for k, letter in enumerate(list(letters)[:47]):
        table[ord(letter)] = k + 1
    return table


def present(text: str, table: np.ndarray, seen: np.ndarray) -> int:
    """Mark the n-grams of `text` in `seen` (cleared first) and count them; 0 if there is no letter."""
    s = table[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]].astype(np.int32) if len(s) else s
    if not len(s) or not s.any():
        return 0
    seen[:] = False
    seen[s] = True
    if len(s) > 1:
        two = s[:-1] * _SYMBOLS + s[1:]
        seen[_SYMBOLS + two] = True
        if len(s) > 2:
            seen[_SYMBOLS + _SYMBOLS**2 + two[:-1] * _SYMBOLS + s[2:]] = True
    return int(np.count_nonzero(seen))


@dataclass(frozen=True)
class Model:
    """`landmarks` holds 1 / sqrt(count) where a landmark has a gram; `weights` and `offset` give a score a language."""

    table: np.ndarray
    languages: tuple[str, ...]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def kernel(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values against the landmarks, and which texts have a letter."""
        seen = np.zeros(_GRAMS, bool)
        x = np.zeros((len(texts), len(self.grams)), np.float32)
        sizes = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if text:
                sizes[i] = present(text, self.table, seen)
                if sizes[i]:
                    x[i] = seen[self.grams]
        return (x @ self.landmarks) / np.sqrt(np.maximum(sizes, 1))[:, None], sizes > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        k, known = self.kernel(texts)
        f = SHARPNESS * (k @ self.weights + self.offset)
        e = np.exp(f - f.max(axis=1, keepdims=True))
        best = f.argmax(axis=1)
        share = (e / e.sum(axis=1, keepdims=True))[np.arange(len(texts)), best]
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.where(known, share, 0.0)


def train(texts: list[str], languages: list[str], landmarks: int = 96, ridge: float = 1e-2) -> Model:
    names = tuple(sorted(set(languages)))
    if not names:
        return Model(np.zeros(0x110000, np.uint8), (), *[np.zeros((0, 0))] * 4)
    chosen: list[int] = []
    for name in names:
        chosen += [i for i, x in enumerate(languages) if x == name][: max(4, landmarks // len(names))]
    counts = Counter()
    for i in chosen:
        counts.update(c for c in texts[i].lower() if c.isalpha())
    table = symbol_table(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if len(c) == 1)
    seen, sets, used = np.zeros(_GRAMS, bool), [], []
    for i in chosen:
        if present(texts[i], table, seen):
            sets.append(np.flatnonzero(seen))
            used.append(i)
    grams = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
    marks = np.zeros((len(grams), len(sets)), np.float32)
    for j, s in enumerate(sets):
        marks[np.searchsorted(grams, s), j] = len(s) ** -0.5
    blank = Model(table, names, grams, marks, np.zeros((len(sets), len(names))), np.zeros(len(names)))
    k = np.concatenate([blank.kernel(texts[a : a + 256])[0] for a in range(0, len(texts), 256)]).astype(np.float64)
    where, vectors = np.linalg.eigh(marks.T.astype(np.float64) @ marks)
    root = vectors @ np.diag(np.where(where > 1e-8, np.maximum(where, 1e-8) ** -0.5, 0.0)) @ vectors.T
    phi = np.c_[k @ root, np.ones(len(k))]
    share = Counter(languages)
    d = np.array([1.0 / (len(names) * share[x]) for x in languages])
    target = np.array([[1.0 if x == n else -1.0 for n in names] for x in languages])
    penalty = ridge / len(texts) * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(phi.T @ (d[:, None] * phi) + penalty, phi.T @ (d[:, None] * target))
    return Model(table, names, grams, marks, (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32))


def _first(ids: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
    return ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def fit(docs: DataFrame, learn: Column, per_class: int = 400, **options) -> Model:
    """Learn from at most `per_class` rows a language among those where `learn` is true and lang and text are known."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = rows.select("doc_id", "lang").distinct()
    # the first rows of each slice hold the first rows of the language, so no task orders a whole language
    sliced = _first(ids.withColumn("slice", F.pmod(F.hash("doc_id"), F.lit(SLICES))), ["lang", "slice"], per_class)
    sample = _first(sliced, ["lang"], per_class).drop("slice")  # per_class rows a language
    got = rows.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"]).collect()
    got.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    kept = [r for r in got if any(c.isalpha() for c in r["text"])]
    return train([r["text"] for r in kept], [r["lang"] for r in kept], **options)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row. No shuffle; the model's size does not depend on the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_500_000):
            names, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(labelled, "doc_id bigint, lang_pred string, score double")
