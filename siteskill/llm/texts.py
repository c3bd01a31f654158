"""Small helpers that several text operators share: Arrow batches, word splitting, stable hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The ASCII white space that separates words. `bytes.split()` splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch, about as many as `pieces` hands on at once.
BATCH = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_GOLDEN, _MIX_1, _MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def give_back() -> None:
    """Hand freed memory back to the system: a worker waits for its next task for up to a minute, beside the JVM of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Have this session's later queries send rows to Python workers in batches of some `BATCH` bytes; a limit that the user set stays.

    Spark's own limit is 64 MB, and a batch lies in the JVM while it grows and is sent, and in the worker until its last row is done.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BATCH))


def pieces(batches: Iterable[pa.RecordBatch], column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about `chars` bytes of text (or one longer text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64))
        slot = (np.cumsum(sizes) // chars).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
        pa.default_memory_pool().release_unused()
    give_back()


def beside(docs: DataFrame, work: Callable[[list[str | None]], list[pa.Array]], fields: str) -> DataFrame:
    """`_row`, a struct of all columns of a row, and the fields that `work` makes of its text. No name can clash, and no row is joined.

    Only texts go to the Python workers and only the fields come back; the rows wait in Spark.
    """
    made = StructType.fromDDL(fields)

    @F.arrow_udf(made)
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts.cast(pa.string())], names=["text"])
            parts = [pa.StructArray.from_arrays(work(piece.column(0).to_pylist()), names=made.names) for piece in pieces([batch], "text")]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(f.name, pa.float64() if f.dataType.simpleString() == "double" else pa.int64()) for f in made]))

    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    return rows.select("_row", call(F.col("_row.text").cast("string")).alias("_made")).select("_row", "_made.*")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64); overflow is meant."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on a 64-bit key and a counter alone."""
    with np.errstate(over="ignore"):
        bits = mixed(mixed(key + _GOLDEN) ^ (counter.astype(np.uint64) * _GOLDEN + _MIX_2))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def crc_rest(column: str, parts: int) -> Column:
    """crc32 of a column as text, modulo `parts`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def labelled(labels: DataFrame, label: str, parts: int, held: int, per_class: int) -> DataFrame:
    """doc_id, label and weight of a bounded training sample.

    Rows whose crc32 rest is `held` and rows without doc_id or label are left out; a doc_id labelled
    more than once takes its largest label. At most `per_class` rows a class are kept, in the order of a
    hash; `weight` is the number of rows a kept one stands for.
    """
    rows = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_rest("doc_id", parts) != held))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
        .where(F.col("label").isin(0, 1))
    )
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    taken = [
        rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        .withColumn("weight", F.lit(n / min(n, per_class)))
        for k, n in sorted(counts.items())
    ]
    if not taken:
        return rows.withColumn("weight", F.lit(1.0))
    return taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])
