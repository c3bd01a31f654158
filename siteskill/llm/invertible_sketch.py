r"""Document fingerprints as invertible Bloom lookup sketches of hashed paragraphs.

A paragraph is a line, cut after every 128 code points; a text is the set of their 64-bit digests. A sketch has 24
cells in three tables of eight; a digest goes into one cell of each, which holds a count, the xor of its digests and the xor
of their checks. Sketches of two versions are subtracted cell by cell, which leaves the digests in which they differ;
peeling takes cells with a single digest, checks it, and takes it out of its two other cells, until nothing is left.
If something is, the pair is tried again with larger sketches: blocks of 24 cells for about eight digests each, then the blocks
that fail with eight times as many. What survives that is compared digest by digest, so results are always whole.

`likeness` is the Jaccard similarity of both sets, from their sizes and the number of differing digests. A fingerprint
string is the digest of the text followed by the cells, so equal texts have equal fingerprints and others differ.

`with_next` finds the neighbour in descending order of doc_id: a window inside blocks of 256 ids, and the heads of
the blocks for the rows at their ends, so that nothing is sorted in one task.

Edge cases: null texts count as empty; two texts without paragraphs have likeness 1; a single document is its own
next; null doc_ids come last, equal ones in the order of their texts; repeated rows stay; other columns are ignored; an empty
table gives an empty result. Only DataFrame and SQL expressions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_null_safe
from ..session import stage

PARAGRAPH = r"[^\n]{1,128}"
BLOCK = 256
ROUNDS = 8
_CHECK = "xxhash64({0}, 7L)"


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda x: F.xxhash64(x)))


def _tables(keys: str, cell) -> str:
    """24 cells: `cell` makes one of the list of digests that fall into it."""
    place = ("x & 7", "shiftrightunsigned(x, 8) & 7", "shiftrightunsigned(x, 16) & 7")
    return "concat(" + ", ".join(f"transform(sequence(0L, 7L), c -> {cell(f'filter({keys}, x -> ({p}) = c)')})" for p in place) + ")"


def sketch_sql(keys: str) -> str:
    lists = _tables(keys, lambda inside: inside)
    return (
        f"transform({lists}, f -> named_struct('n', size(f), 'k', aggregate(f, 0L, (s, x) -> s ^ x), "
        f"'h', aggregate(f, 0L, (s, x) -> s ^ {_CHECK.format('x')})))"
    )


def subtract_sql(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (a, b) -> named_struct('n', a.n - b.n, 'k', a.k ^ b.k, 'h', a.h ^ b.h))"


def peel_sql(cells: str) -> str:
    """got (the differing digests) and whole (whether the sketch came out empty)."""
    taken = f"named_struct('n', c.n - p.n, 'k', c.k ^ p.k, 'h', c.h ^ {_CHECK.format('p.k')})"
    here = "CASE WHEN i < 8 THEN p.k & 7 WHEN i < 16 THEN shiftrightunsigned(p.k, 8) & 7 ELSE shiftrightunsigned(p.k, 16) & 7 END = i % 8"
    pure = f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND c.h = {_CHECK.format('c.k')}), c -> named_struct('n', c.n, 'k', c.k)))"
    left = f"transform(s.cells, (c0, i) -> aggregate(filter(pure, p -> {here}), c0, (c, p) -> {taken}))"
    step = f"CASE WHEN s.over THEN s ELSE element_at(transform(array({pure}), pure -> named_struct('cells', IF(size(pure) = 0, s.cells, {left}), 'got', concat(s.got, transform(pure, p -> p.k)), 'over', size(pure) = 0)), 1) END"
    begin = f"named_struct('cells', {cells}, 'got', CAST(array() AS array<bigint>), 'over', false)"
    end = "named_struct('got', s.got, 'whole', forall(s.cells, c -> c.n = 0 AND c.k = 0 AND c.h = 0))"
    return f"aggregate(sequence(1, {ROUNDS}), {begin}, (s, r) -> {step}, s -> {end})"


def _retried(block: str, smaller: str) -> str:
    """The differing digests of one block of both sides: peeled, or else what `smaller` makes of it."""
    peeled = peel_sql(subtract_sql(sketch_sql(f"{block}.a"), sketch_sql(f"{block}.b")))
    return f"element_at(transform(array({peeled}), t -> IF(t.whole, t.got, {smaller})), 1)"


def _except(block: str) -> str:
    return f"concat(array_except({block}.a, {block}.b), array_except({block}.b, {block}.a))"


def differing(left: str, right: str, left_sketch: str, right_sketch: str) -> Column:
    """The digests in which two sides differ, from sketches first and larger ones on failure. Arguments name columns."""
    first = peel_sql(subtract_sql(left_sketch, right_sketch))
    side = "CAST(ceil(sqrt((size({0}) + size({1})) / 8.0)) AS bigint)".format(left, right)
    cut = lambda a, b, p: f"named_struct('a', filter({a}, x -> {p}), 'b', filter({b}, x -> {p}))"
    coarse = f"transform(sequence(0L, m - 1), g -> {cut(left, right, '(shiftrightunsigned(x, 24) & 65535) % m = g')})"
    fine = f"flatten(transform({coarse}, w -> transform(sequence(0L, m - 1), q -> {cut('w.a', 'w.b', '(shiftrightunsigned(x, 40) & 65535) % m = q')})))"
    eighths = f"transform(sequence(0L, 7L), z -> {cut('v.a', 'v.b', 'shiftrightunsigned(x, 61) = z')})"
    last = f"flatten(transform({eighths}, y -> {_retried('y', _except('y'))}))"
    larger = f"element_at(transform(array({side}), m -> flatten(transform({fine}, v -> {_retried('v', last)}))), 1)"
    return F.expr(f"element_at(transform(array({first}), l -> IF(l.whole, l.got, {larger})), 1)")


def likeness(n_left: Column, n_right: Column, n_differing: Column) -> Column:
    return F.when(n_left + n_right == 0, 1.0).otherwise((n_left + n_right - n_differing) / (n_left + n_right + n_differing))


def fingerprint(text: Column, cells: str) -> Column:
    packed = F.expr(f"array_join(transform({cells}, c -> concat(hex(c.n), '.', hex(c.k), '.', hex(c.h))), ',')")
    return F.concat(F.substring(F.sha2(text.cast("binary"), 256), 1, 32), F.lit(":"), packed)


def _following(keys: DataFrame, level: int = 2) -> DataFrame:
    """For distinct `key` values the next smaller one as `next`; the smallest gets the largest. Null is smallest."""
    down = F.col("key").desc_nulls_last()
    if not level:
        top = F.max("key").over(Window.partitionBy())  # a row per 2 ** 16 ids
        return keys.withColumns({"next": F.lead(F.struct("key")).over(Window.orderBy(down)), "top": top}).select(
            "key", F.when(F.col("next").isNull(), F.col("top")).otherwise(F.col("next.key")).alias("next"))
    grouped = keys.withColumn("group", F.floor(F.col("key") / F.lit(BLOCK)))
    heads = grouped.groupBy("group").agg(F.max("key").alias("head"))
    after = _following(heads.select(F.col("group").alias("key")), level - 1).select(F.col("key").alias("group"), F.col("next").alias("next_group"))
    ends = join_null_safe(after, heads.select(F.col("group").alias("next_group"), "head"), ["next_group"]).select("group", "head")
    lead = F.lead(F.struct("key")).over(Window.partitionBy("group").orderBy(down))
    return join_null_safe(grouped.withColumn("next", lead), ends, ["group"]).select("key", F.when(F.col("next").isNull(), F.col("head")).otherwise(F.col("next.key")).alias("next"))


def with_next(docs: DataFrame, more: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, text (null: empty) and next_text, the text of the next document in descending order.

    `more` names columns to be made of the text, one after the other. They come along from the next row as next_*, which are null
    for the few rows whose next one is in another block.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block = F.floor(F.col("doc_id") / F.lit(BLOCK)).alias("block")
    heads = stage(rows.groupBy(block).agg(F.max("doc_id").alias("head")), "sketch_heads")
    after = _following(heads.select(F.col("block").alias("key"))).select(F.col("key").alias("block"), F.col("next").alias("next_block"))
    ends = stage(join_null_safe(after, heads.select(F.col("block").alias("next_block"), "head"), ["next_block"]).select("block", "head"), "sketch_ends")
    known = rows.join(ends.select(F.col("head").alias("doc_id")).distinct(), "doc_id").groupBy("doc_id").agg(F.min("text").alias("head_text"))
    if not heads.where("head IS NULL").isEmpty():
        known = known.unionByName(rows.where("doc_id IS NULL").groupBy("doc_id").agg(F.min("text").alias("head_text")))
    last = stage(join_null_safe(ends.withColumnRenamed("head", "doc_id"), known, ["doc_id"]).select("block", "head_text"), "sketch_last")
    # the block as a struct is never null, so window and join share one exchange of the texts
    order = Window.partitionBy("place").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    placed = rows.withColumn("place", F.struct(block.alias("b")))
    for name, column in (more or {}).items():
        placed = placed.withColumn(name, column)
    kept = ["text", *(more or {})]
    led = placed.withColumn("lead", F.lead(F.struct(*kept)).over(order))
    ends = last.select(F.struct(F.col("block").alias("b")).alias("place"), "head_text")
    following = [F.coalesce("lead.text", "head_text").alias("next_text"), *[F.col(f"lead.{c}").alias(f"next_{c}") for c in more or {}]]
    return led.join(ends, "place").select("doc_id", *kept, *following)


def versions(docs: DataFrame, more: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, text, edited and next_text: the last half of the text gives way to the beginning of the next one."""
    half = F.floor(F.length("text") / F.lit(2)).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    return with_next(docs, more).withColumn("edited", edited)


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited version, and how like they are to each other and to the next text."""
    keyed = versions(docs, {"a": digests(F.col("text")), "sa": F.expr(sketch_sql("a"))})
    keyed = keyed.withColumns({"e": digests(F.col("edited")), "x": F.coalesce("next_a", digests(F.col("next_text")))})
    sketched = keyed.withColumns({"se": F.expr(sketch_sql("e")), "sx": F.coalesce(F.col("next_sa"), F.expr(sketch_sql("x")))})
    size = lambda c: F.size(c).cast("double")
    return sketched.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), "sa").alias("fingerprint"), fingerprint(F.col("edited"), "se").alias("edited_fingerprint"),
        likeness(size("a"), size("e"), size(differing("a", "e", "sa", "se"))).alias("near_edited"),
        likeness(size("a"), size("x"), size(differing("a", "x", "sa", "sx"))).alias("near_next"),
    )
