"""Quality rules as a ledger: every rule is evaluated once per document, policies are masks over the stored bits.

`ledger` measures a text in one pass and writes one failure bit per rule beside the measurements.
`apply_policy` and `ablation` read the bits alone, so a new policy version or the question "what would
rule k reject on its own" never reads a text again.

Edge cases: a null text has no words and fails `few_words`; repeated rows are measured one by one; an
empty table gives an empty ledger; further columns of the input are not looked at or carried on, so their
names can't clash. Null doc_ids are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import SPACES, beside, pieces

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_bangs",
)
_UPPER = bytes(range(65, 91))
SCHEMA = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    """`fails` is a SQL condition over the measurements; its place in RULES is its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
    Rule("bangs", "100 * n_bangs > 10 * n_words"),
)
#: Versions of the policy: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    return sum(1 << k for k, r in enumerate(RULES) if r.name in POLICIES[policy])


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found at least twice; windows may overlap.

    Windows of 1, 2, 4 and 8 words are numbered one after the other, equal windows alike, so the
    comparison is exact. `width` is a power of two.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    step, kinds = 1, len(number)
    while step < width:
        pairs = ids[: len(ids) - step] * kinds + ids[step:]
        kept, ids = np.unique(pairs, return_inverse=True)
        step, kinds = 2 * step, len(kept)
        if kinds == len(ids):
            return 0
    often = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(often)] += often
    edges[width : width + len(often)] -= often
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_spaces = len(data) - len(data.translate(None, SPACES))
    return (
        len(words), len(text or "") - n_spaces, len(data) - len(data.translate(None, SYMBOLS)), len(lines),
        len(lines) - len(set(lines)), repeated_words(words), len(data) - len(data.translate(None, _UPPER)), data.count(b"!"),
    )


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *MEASURES]
    for batch in pieces(batches, "text"):
        rows = np.array([measure(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, k]) for k in range(len(MEASURES))]], names=names)


def failure_bits() -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, r in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed`, the bits of the rules that the text fails. No shuffle."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measured, SCHEMA).withColumn("failed", failure_bits())


def passing(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of `docs` that a policy keeps. Each row is judged by its own text, whatever its doc_id."""

    def measures(texts: list[str | None]) -> list[pa.Array]:
        rows = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
        return [pa.array(rows[:, k]) for k in range(len(MEASURES))]

    judged = beside(docs, measures, ", ".join(f"{m} bigint" for m in MEASURES)).withColumn("failed", failure_bits())
    return apply_policy(judged, policy).where("kept").select("_row.*")


def apply_policy(rows: DataFrame, policy: str, into: str = "kept") -> DataFrame:
    return rows.withColumn(into, F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """One row per rule of a policy: rejected by it, by it alone, and kept by the policy without it.

    Rows are first counted by their bits; there are at most 2 ** len(RULES) such groups, so everything
    after the first partial aggregate is small whatever the number of documents.
    """
    whole = mask(policy)
    seen = rows.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("bigint")).alias("bits")).count()
    out = []
    for k, r in enumerate(RULES):
        if whole >> k & 1:
            has, rest = F.col("bits").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, F.col("bits").bitwiseAND(F.lit(whole & ~(1 << k)).cast("bigint")) == 0
            out += [F.sum(F.when(has, F.col("count")).otherwise(0)), F.sum(F.when(has & rest, F.col("count")).otherwise(0)), F.sum(F.when(rest, F.col("count")).otherwise(0))]
    names = [r.name for k, r in enumerate(RULES) if whole >> k & 1]
    sums = seen.agg(F.array(*[F.coalesce(x, F.lit(0)).cast("bigint") for x in out]).alias("s"))
    table = F.array(*[F.struct(F.lit(n).alias("rule"), F.col("s")[3 * i].alias("n_rejected"), F.col("s")[3 * i + 1].alias("n_only"), F.col("s")[3 * i + 2].alias("n_kept_without")) for i, n in enumerate(names)])
    return sums.select(F.inline(table))
