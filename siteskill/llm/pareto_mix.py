"""Mixing sources to target weights with Pareto order sampling.

Targets: sources in code point order (null last) weigh 3, 1, 2 and so on; a share of all words is dealt out by
weight, no target exceeds `most` times its source's words, and the excess goes to the others by weight until none is
above. That is a water level, found in one pass over the sources sorted by their limit per weight.

Selection: each document is taken floor(target / size of its source) times for certain. The rest of the target is
filled by Pareto order sampling: documents rank by random odds over inclusion odds (larger documents have larger
odds, see `odds`), and are taken in that order while the words fit. What the next one would overshoot is filled by
smaller ones further down, in two more rounds. Documents with equal ranks are taken together or not at all.

A source is never sorted in one task: words are summed by 4096 slots of the rank, the slot where the
target is crossed is found from these sums, and only rows of that slot are ordered. The decision is then
a rule on (source, rank, size), so texts are neither shuffled nor sorted.

Edge cases: null texts and texts without words have size 0; null doc_ids draw by their text; repeated rows share
their rank; a source without words has target 0; other columns pass through; an empty table gives an empty result.
Only DataFrame expressions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_null_safe
from ..session import stage
from .texts import WORD

SLOTS = 4096
ROUNDS = 3


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def odds(size: Column) -> Column:
    """Inclusion odds up to a factor per source: 1 below 100 words, 2 below 1000, 3 from there."""
    return F.when(size < 100, 1.0).when(size < 1000, 2.0).otherwise(3.0)


def rank(seed: str, size: Column) -> Column:
    """Random odds over inclusion odds; the random number comes from an md5 of seed and doc_id."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(" "), key).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return draw / (1.0 - draw) / odds(size)


def targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target: one row per source."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1).cast("double")
    every = Window.partitionBy()
    by_limit = Window.orderBy((most * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    level = total.withColumn("weight", weight).withColumns({
        "all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every),
        "limits": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most, "weights": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", (F.lit(share) * F.col("all_size") - F.col("limits")) / (F.col("all_weight") - F.col("weights")))
    # sorted by limit, the level falls below the limits at some source and stays there: the first such level holds
    free = most * F.col("source_size") > F.col("level") * F.col("weight")
    water = F.min(F.when(free, F.struct(most * F.col("source_size") / F.col("weight"), F.col("weights"), F.col("level").alias("level")))).over(every)["level"]
    return level.withColumn("water", water).select(
        "source", "source_size",
        F.when(free, F.col("weight") * F.col("water")).otherwise((most * F.col("source_size")).cast("double")).alias("target"),
    )


def _round(left: DataFrame, goals: DataFrame) -> DataFrame:
    """left: source, rank, size of documents not taken yet; goals: source, after, gap. The last rank taken, and the words."""
    fitting = join_null_safe(left, goals, ["source"]).where((F.col("rank") > F.col("after")) & (F.col("size") <= F.col("gap")) & (F.col("size") > 0))
    slotted = fitting.withColumn("slot", F.floor(F.col("rank") / (1 + F.col("rank")) * SLOTS).cast("int"))
    sums = slotted.groupBy("source", "slot").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"), F.max("rank").alias("last"))
    upto = Window.partitionBy("source").orderBy("slot")
    running = sums.withColumn("upto", F.sum("words").over(upto)).withColumn("crossed", F.col("upto") > F.col("gap"))
    edge = running.groupBy("source").agg(
        F.min(F.when(F.col("crossed"), F.col("slot"))).alias("slot"), F.coalesce(F.max(F.when(~F.col("crossed"), F.col("upto"))), F.lit(0)).alias("base"),
        F.max(F.when(~F.col("crossed"), F.col("last"))).alias("whole"),
    )
    inside = join_null_safe(slotted, edge.where("slot IS NOT NULL").select("source", "slot", "base"), ["source", "slot"])
    ordered = inside.withColumn("words", F.col("base") + F.sum("size").over(Window.partitionBy("source", "slot").orderBy("rank"))).where(F.col("words") <= F.col("gap"))
    tail = ordered.groupBy("source").agg(F.max("rank").alias("part"), F.max("words").alias("part_words"))
    return join_null_safe(edge, tail, ["source"], "left").select(
        "source", F.coalesce("part", "whole").alias("upto"), F.coalesce("part_words", "base").cast("bigint").alias("got")
    )


def plan(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """One row per source: source_size, target, copies, and rounds, an array of (after, upto, gap)."""
    size = size_of()
    sized = stage(docs.select("source", size.alias("size"), rank(seed, size).alias("rank")), "mix_sizes")
    goals = targets(sized, **options)
    copies = F.floor(F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))).cast("bigint")
    kept = goals.withColumn("copies", copies).withColumn("gap", F.col("target") - F.col("copies") * F.col("source_size"))
    state = stage(kept.withColumns({"after": F.lit(-1.0), "rounds": F.expr("CAST(array() AS array<struct<after:double,upto:double,gap:double>>)")}), "mix_goals")
    for k in range(ROUNDS):
        got = _round(sized, state.select("source", "after", "gap"))
        state = stage(join_null_safe(state, got, ["source"], "left").select(
            "source", "source_size", "target", "copies", (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap"), F.coalesce("upto", "after").alias("after"),
            F.concat("rounds", F.array(F.struct("after", F.coalesce("upto", "after").alias("upto"), "gap"))).alias("rounds"),
        ), f"mix_goals_{k}")
    return state


def mixed(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """All rows and columns of `docs` with size, source_size, target, times (copies in the mix) and taken (words)."""
    size = size_of()
    chosen = plan(docs, seed, **options).select("source", "source_size", "target", "copies", "rounds")
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "rounds", "rank", "times", "taken")]
    rows = docs.select(*own).withColumns({"size": size, "rank": rank(seed, size)})
    hit = F.exists("rounds", lambda r: (F.col("rank") > r["after"]) & (F.col("rank") <= r["upto"]) & (F.col("size") <= r["gap"]) & (F.col("size") > 0))
    return (
        join_null_safe(rows, chosen, ["source"])
        .withColumn("times", F.col("copies") + hit.cast("bigint"))
        .withColumn("taken", F.col("times") * F.col("size"))
        .select(*own, "size", "source_size", "target", "times", "taken")
    )


def repeated(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken. Columns of any name pass through."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))
    return mixed(rows, seed, **options).where("times > 0").withColumn("_copy", copies).select("_row.*")
