"""Merkle manifest of a dataset with incremental witnesses: eight-way trees per group, and a tree of their roots.

Leaves are appended in order. An `Appender` keeps one open run of up to eight subtrees per level, each with its partial witness:
the digests of the siblings to its left, and of those to its right so far. Every sibling that is completed later extends the
witnesses of the open subtrees before it; when a run is full, its witnesses go to the leaves below, and its digest is appended one level
up. Nothing is looked up again later, and no tree is kept.

Distribution: leaves are numbered inside their group by one range-partitioned sort, and aligned blocks of `SPAN` = 8 ** 4 numbers are built
by tasks of their own. The roots of the blocks are appended further, to blocks of block roots, and so on up to the root of the
group, then the roots of the groups to the root of the dataset. So no task sees more than `SPAN` nodes, however large a group is.
Blocks first give their roots alone; once the witnesses of the roots are known, blocks are built again and their leaves'
witnesses continued with that of their block. Texts are read once and never shuffled, witnesses never.

A digest is H: the SHA-256, in lower-case hex, of its inputs one after the other. A leaf is H of its fields, each as byte count, colon
and value, or `-` for null. A witness is an array of (left, right), from the leaf's run to the root's; `folded` recomputes the root.

Edge cases: a group of one leaf is its own root without hashing, while a last run of one below other nodes is hashed; a null group is a
group and comes first; null order values come first, equal ones in order of their leaves; repeated rows are leaves of their own;
columns not named are left out; names that clash with new ones are an error; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.joins import join_null_safe
from ..session import stage

FAN = 8
LEVELS = 4
SPAN = FAN**LEVELS
WITNESS = "array<struct<left: string, right: string>>"


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


class Appender:
    """Appends nodes in order; `witness[k]` grows to the (left, right) siblings of node k, a pair per level."""

    def __init__(self) -> None:
        self.open: list[list[list]] = [[]]  # per level: subtrees as [digest, first node, node after the last, left, right]
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._add(0, node, at, at + 1)

    def _add(self, level: int, node: str, first: int, end: int) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        for subtree in run:
            subtree[4] += node
        run.append([node, first, end, "".join(s[0] for s in run), ""])
        if len(run) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for _, first, end, left, right in run:
            for k in range(first, end):
                self.witness[k].append((left, right))
        self._add(level + 1, digest(*[s[0] for s in run]), run[0][1], run[-1][2])

    def finish(self, levels: int) -> str:
        """Complete what is open below `levels`; the digest that remains there."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def _levels(total: int) -> int:
    """Levels of a tree of `total` nodes, those of a block at most."""
    return next(k for k in range(LEVELS + 1) if k == LEVELS or FAN**k >= total)


def _built(table: pa.Table) -> tuple[pa.Table, Appender, str]:
    table = table.sort_by("i")
    grown = Appender()
    for node in table.column("node").to_pylist():
        grown.append(node)
    return table, grown, grown.finish(_levels(table.column("total")[0].as_py()))


def encoded(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, leaf, lambda node, w: F.sha2(F.concat(w["left"], node, w["right"]).cast("binary"), 256))


def proof(witness: Column) -> Column:
    """All siblings in one string, level by level, left to right."""
    return F.array_join(F.transform(witness, lambda w: F.concat(w["left"], w["right"])), "")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Add `i`, the place of a row in its group from 0, and `total`, the number of its rows. No group is sorted in one task."""
    tie = df.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may be many
    keys = [*by, *order, "_tie"]
    placed = tie.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("_part", F.shiftright("_at", 33)), label)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n")).withColumns(
        {"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(*by))})
    return join_null_safe(placed, parts, [*by, "_part"]).withColumn("i", F.col("_at") - F.col("_low") + F.col("_before")).select(*df.columns, "i", "total")


def _grown(nodes: DataFrame, by: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Of numbered nodes (by, i, total, node): the witness of each block of them (by, block, witness), and the roots (by, root)."""
    block = F.floor(F.col("i") / SPAN).cast("bigint").alias("block")
    rows = nodes.select(*by, block, "i", "total", "node")
    keys = [*by, "block"]
    schema = StructType([rows.schema[k] for k in keys]).add("total", "long").add("node", "string")

    def roots(table: pa.Table) -> pa.Table:
        table, _, root = _built(table)
        return table.slice(0, 1).select([*keys, "total"]).append_column("node", pa.array([root]))

    tops = stage(rows.groupBy(*keys).applyInArrow(roots, schema), f"{label}_tops")
    if tops.where(F.col("total") > SPAN).isEmpty():
        empty = F.expr(f"CAST(array() AS {WITNESS})")
        return tops.select(*by, "block", empty.alias("witness")), tops.select(*by, F.col("node").alias("root"))
    above = tops.select(*by, F.col("block").alias("i"), F.ceil(F.col("total") / SPAN).cast("bigint").alias("total"), "node")
    continued, root = _grown(above, by, f"{label}_up")
    return stage(_witnessed(above, continued, by).select(*by, F.col("i").alias("block"), "witness"), f"{label}_witness"), root


def _witnessed(nodes: DataFrame, blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """All columns of the numbered nodes, the other columns of their blocks, and the witness, continued by that of the block."""
    keys = [*by, "block"]
    left = nodes.withColumn("block", F.floor(F.col("i") / SPAN).cast("bigint"))
    more = [f for f in blocks.schema if f.name not in (*keys, "witness")]
    schema = StructType([*nodes.schema.fields, *more, *StructType.fromDDL(f"witness {WITNESS}").fields])
    right = blocks.withColumnsRenamed({k: f"_{k}" for k in keys})

    def call(table: pa.Table, top: pa.Table) -> pa.Table:
        table, grown, _ = _built(table)
        upper = top.column("witness")[0].as_py()
        out = table.drop_columns(["block"])
        for f in more:
            out = out.append_column(f.name, pa.array(top.column(f.name).to_pylist() * len(table), top.schema.field(f.name).type))
        witness = [[{"left": a, "right": b} for a, b in w] + upper for w in grown.witness]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return out.append_column("witness", pa.array(witness, kind))

    return left.groupBy(*keys).cogroup(right.groupBy(*[f"_{k}" for k in keys])).applyInArrow(call, schema)


def manifest(leaves: DataFrame, by: str = "lang", order: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """All columns of `leaves` with subroot (of the group), root (of the dataset) and witness (to the root)."""
    clash = {"subroot", "root", "witness", "i", "total", "node", "block", "_group"} & set(leaves.columns)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    rows = numbered(leaves.withColumn("node", F.col(leaf)), [by], [order, "node"], "manifest_leaves")
    # groups are numbered, so that keys are integers and null groups need no rules
    groups = stage(numbered(rows.where("i = 0").select(by, F.col("total").alias("_size")), [], [by], "manifest_groups").select(
        by, F.col("i").alias("_group"), F.col("total").alias("_groups")), "manifest_groups_numbered")
    rows = stage(join_null_safe(rows, groups.select(by, "_group"), [by]), "manifest_rows")
    inner, subroots = _grown(rows, ["_group"], "manifest")
    nodes = stage(subroots.join(groups.select("_group", "_groups"), "_group").select(
        F.col("_group").alias("i"), F.col("_groups").alias("total"), F.col("root").alias("node")), "manifest_subroots")
    blocks, root = _grown(nodes, [], "manifest_root")
    outer = _witnessed(nodes, blocks.withColumn("root", root.select("root").scalar()), [])
    outer = stage(outer.select(F.col("i").alias("_group"), F.col("node").alias("subroot"), "root", F.col("witness").alias("outer")), "manifest_outer")
    ends = inner.join(outer, "_group").select("_group", "block", "subroot", "root", F.concat("witness", "outer").alias("witness"))
    return _witnessed(rows, ends, ["_group"]).select(*leaves.columns, "subroot", "root", "witness")
