"""Exact Jaccard join on word shingles by partitioning the universe of shingles (pigeonhole).

Two sets of sizes a <= b with Jaccard >= 0.8 differ in at most floor((a + b) / 9) shingles, and b <= 1.25 a. Sizes fall
into bands; the scheme of a band serves all pairs whose smaller set lies in it, with one bound H on the difference.
It hashes the universe into 2 (H + 1) segments. The part of a set in one segment is its subset there; a pair
differs in at most H segments, so of c non-empty subsets at least c - H are equal. In one global order of
signatures (segment, subset), the first H + 1 of both sets therefore share one whenever c > H. Bands of at most
`SINGLES` shingles use one segment per shingle, where c > H always holds; a scheme that meets a larger set
with c <= H is run once more with one segment per shingle. Nothing depends on luck.

Allocation by cost: the pairs that a signature makes are joined as rows up to `HOT` ** 2 / 2, and compared piece by piece with piece, by
bitmaps (below), beyond; a pair that shares many is told by the smallest of them. A signature in so many texts that this costs more than the neighbourhoods of its texts would (`ENTRY`)
is left out (-1), and the texts that hold one index all their other segments with their one-deletion neighbourhoods
(+1): subsets of two or more shingles then match up to one difference. Sets without enough such segments left
compare within their common signatures instead, piece by piece, so no link is lost.

Verification: each class has a bitmap of shingle parities, in which two sets differ in at most as many bits as in shingles. Candidates
are first compared by it, which needs no texts and is never wrong about a link; what passes is verified on the words of both texts.

Copies never meet in pairs: equal sets form one class (128-bit digest) first. Within a signature the classes are first compared
with one hub; pairs that components already join are not compared again. Components come from rounds of
smallest neighbours and pointer jumping, all in tables.

Edge cases: null and empty texts and texts without words have no shingles and link with nothing; rows without doc_id
are returned and have no component; fewer than five words count as one shingle; rows that share a doc_id are linked by the
text each has; repeated rows stay; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .texts import SPACES, mixed, pieces

WORDS = 5
SINGLES = 16
HOT = 32
#: What the neighbourhoods of a text cost for each of its shingles (four rows), in comparisons of two bitmaps.
ENTRY = 20.0
#: Common signatures that a class carries to all of them, so that a pair is told by few of those it shares.
EARLY = 16
#: Bytes of text in one piece of work; a piece takes some 60 times as much memory in arrays.
CHARS = 250_000
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        done, factor = 1, base
        while done < n:
            out[done : 2 * done] = out[: min(done, n - done)] * np.uint64(factor)
            done, factor = 2 * done, factor * factor % 2**64
    return out


class Shingler:
    """Turns a list of texts into (text number, distinct shingle) arrays, sorted by both."""

    def __init__(self) -> None:
        self.steps = self.backs = np.ones(0, np.uint64)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        data = [(t or "").encode().lower() for t in texts]
        ends = np.cumsum([len(d) + 1 for d in data])
        raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
        if len(raw) > len(self.steps):
            self.steps, self.backs = _powers(_STEP, 2 * len(raw)), _powers(_BACK, 2 * len(raw))
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.r_[True, space]))  # first letters and the spaces after last letters, in turns
        starts, stops = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            upto = np.r_[np.uint64(0), np.cumsum(_LETTER[raw] * self.steps[: len(raw)])]
            codes = mixed((upto[stops] - upto[starts]) * self.backs[starts])
        return np.searchsorted(ends, starts, side="right"), codes

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        at, codes = self.words(texts)
        count = np.bincount(at, minlength=len(texts))
        first = np.cumsum(count) - count
        with np.errstate(over="ignore"):
            rows, values = [], []
            for width in range(1, WORDS + 1):
                begin = np.flatnonzero(at[: max(0, len(at) - WORDS + 1)] == at[WORDS - 1 :]) if width == WORDS else first[count == width]
                value = np.full(len(begin), width, np.uint64)
                for k in range(width):
                    value = mixed(value + codes[begin + k])
                rows.append(at[begin])
                values.append(value)
        row, value = np.concatenate(rows), np.concatenate(values)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])] if len(row) else np.zeros(0, bool)
        return row[new], value[new]


def digests(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two order-free 64-bit digests of the sets."""
    size = np.bincount(row, minlength=n)
    first = np.cumsum(size) - size
    out = []
    with np.errstate(over="ignore"):
        for salt in (1, 2):
            sums = np.r_[np.uint64(0), np.cumsum(mixed(value ^ mixed(np.array([salt], np.uint64))))]
            out.append(mixed(sums[first + size] - sums[first] + size.astype(np.uint64)).view(np.int64))
    return size, *out


def _bands() -> np.ndarray:
    """First sizes of the bands: one size each at first, then about 1.6 times as wide as the one before."""
    out = [1]
    while out[-1] < 2**40:
        out.append(out[-1] + 1 if out[-1] <= SINGLES else int(out[-1] * 1.6))
    return np.array(out)


BANDS = _bands()


def schemes(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, band) for every scheme that a set takes part in: its own band, and lower ones whose partners reach it."""
    own = np.searchsorted(BANDS, size, side="right") - 1
    lowest = np.searchsorted(BANDS, -(-4 * size // 5), side="right") - 1  # the smallest partner has 0.8 of the size
    times = np.where(size > 0, own - lowest + 1, 0)
    which = np.repeat(np.arange(len(size)), times)
    back = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return which, own[which] - back


def differing(band: np.ndarray) -> np.ndarray:
    """H: the most shingles in which a pair differs whose smaller set is in the band."""
    last = BANDS[band + 1] - 1
    return (last + 5 * last // 4) // 9


def subsets(row: np.ndarray, value: np.ndarray, size: np.ndarray, which: np.ndarray, band: np.ndarray, single: bool | np.ndarray) -> dict:
    """The non-empty segment subsets of every (set, scheme): entry, segment, signature, number of shingles, and all elements."""
    first = np.cumsum(size) - size
    reps = size[which]
    entry = np.repeat(np.arange(len(which)), reps)
    place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[which], reps)
    element = value[place]
    n = (2 * (differing(band) + 1)).astype(np.uint64)
    with np.errstate(over="ignore"):
        segment = np.where((np.broadcast_to(single, len(which)) | (BANDS[band] <= SINGLES))[entry], element, mixed(element ^ np.uint64(77)) % n[entry])
        order = np.lexsort((segment, entry))
        entry, segment, element = entry[order], segment[order], mixed(element[order] + np.uint64(5))
        new = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (segment[1:] != segment[:-1])]) if len(entry) else np.zeros(0, int)
        sums = np.r_[np.uint64(0), np.cumsum(element)]
        ends = np.r_[new[1:], len(entry)].astype(int)
        total = sums[ends] - sums[new]
        head = mixed(segment[new] + mixed(band[entry[new]].astype(np.uint64) + np.uint64(1000)))
        return {"entry": entry[new], "total": total, "head": head, "count": ends - new, "sig": mixed(head ^ total), "first": new, "element": element}


def prefix(part: dict, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subset number, whether its set has too few): the first bound + 1 signatures of each entry."""
    order = np.lexsort((part["sig"], part["entry"]))
    entry = part["entry"][order]
    count = np.bincount(entry, minlength=len(bound))
    place = np.arange(len(entry)) - (np.cumsum(count) - count)[entry]
    return order[place <= bound[entry]], count <= bound


def _per_batch(work, names: list[str], keep: str = "text"):
    def call(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in pieces(batches, keep, CHARS):
            out = work(shingler, batch)
            if len(out[0]):
                yield from pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names).to_batches(max_chunksize=100_000)

    return call


def _sets_of(shingler: Shingler, batch: pa.RecordBatch):
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    row, value = shingler.sets(texts)
    return row, value, *digests(row, value, len(texts))


def parities(row: np.ndarray, value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A bitmap per set: bit h mod m is the parity of its shingles there, m the power of two from one to two times the size.

    The bitmaps of two sets differ in at most as many bits as the sets differ in shingles. A longer bitmap folds to a
    shorter one by xor of its halves, so any two can be compared.
    """
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    first = np.cumsum(width // 8) - width // 8
    spot = (mixed(value ^ np.uint64(99)) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    where, times = np.unique(first[row] * 8 + spot, return_counts=True)
    bits = np.zeros(int((width // 8).sum()), np.uint8)
    odd = where[times % 2 == 1]
    np.bitwise_or.at(bits, odd >> 3, (1 << (odd & 7)).astype(np.uint8))
    data = bits.tobytes()
    return [data[a : a + w] if n else b"" for a, w, n in zip(first.tolist(), (width // 8).tolist(), size.tolist())]


def differ(x: bytes, y: bytes) -> int:
    """At most the number of shingles in which two sets differ."""
    if len(x) > len(y):
        x, y = y, x
    other = np.frombuffer(y, np.uint64)
    while len(other) * 8 > len(x):
        other = other[: len(other) // 2] ^ other[len(other) // 2 :]
    return int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ other).sum())


def _described(shingler: Shingler, batch: pa.RecordBatch):
    row, value, size, node, other = _sets_of(shingler, batch)
    return batch.column(0), size, node, other, pa.array(parities(row, value, size), pa.binary())


def _possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps do not rule a link out; sets that differ in d shingles of a + b have 9 d <= a + b where they link."""
    for batch in batches:
        both = zip(*[batch.column(k).to_pylist() for k in range(4, 8)])
        keep = pa.array([9 * differ(x, y) <= n + m for n, m, x, y in both], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(4)], names=["a", "b", "a_doc", "b_doc"])


def _signed(single: list[int] | None):
    """Signatures of all schemes, or with one segment per shingle for the schemes named."""

    def work(shingler: Shingler, batch: pa.RecordBatch):
        row, value, size, node, _ = _sets_of(shingler, batch)
        which, band = schemes(size)
        once = np.zeros(len(size), bool)  # copies in one batch give the same signatures
        once[np.unique(node, return_index=True)[1]] = True
        which, band = which[once[which]], band[once[which]]
        if single is not None:
            chosen = np.isin(band, single)
            which, band = which[chosen], band[chosen]
        bound = differing(band)
        part = subsets(row, value, size, which, band, single is not None)
        taken, few = prefix(part, bound)
        entry = part["entry"][taken]
        return part["sig"][taken].view(np.int64), node[which[entry]], np.where(few, band, -1)[entry].astype(np.int32)

    return work


def _neighbourhoods(shingler: Shingler, batch: pa.RecordBatch):
    """All subsets (kind 0) and their one-deletion neighbourhoods (kind 1), with the bound that their set has to reach."""
    row, value, size, node, _ = _sets_of(shingler, batch)
    which, band = schemes(size)
    part = subsets(row, value, size, which, band, False)
    many = np.repeat(np.arange(len(part["sig"])), np.where(part["count"] > 1, part["count"], 0))
    owner = np.repeat(np.arange(len(part["sig"])), part["count"])
    inside = np.flatnonzero(part["count"][owner] > 1)
    with np.errstate(over="ignore"):
        less = mixed(part["head"][many] ^ (part["total"][many] - part["element"][inside]))
    sig = np.r_[part["sig"], less].view(np.int64)
    entry = np.r_[part["entry"], part["entry"][many]]
    whole = np.r_[part["sig"], part["sig"][many]].view(np.int64)
    kind = np.r_[np.zeros(len(part["sig"]), np.int32), np.ones(len(many), np.int32)]
    weight = np.r_[np.minimum(part["count"], 2), np.zeros(len(many), int)].astype(np.int32)
    return sig, whole, node[which[entry]], band[entry].astype(np.int32), kind, weight, differing(band)[entry]


def _linked(shingler: Shingler, batch: pa.RecordBatch):
    left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    row, value = shingler.sets(left + right)
    ends = np.searchsorted(row, np.arange(len(left) * 2 + 1))
    good = []
    for k in range(len(left)):
        x, y = value[ends[k] : ends[k + 1]], value[ends[k + len(left)] : ends[k + len(left) + 1]]
        both = len(np.intersect1d(x, y, assume_unique=True))
        good.append(100 * both >= 80 * (len(x) + len(y) - both) and both > 0)
    keep = pa.array(good, pa.bool_())
    return batch.column(0).filter(keep), batch.column(1).filter(keep)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, root (smallest node of its component) for all nodes of `edges` (a, b).

    Every round links each node's neighbours to the smallest of them, which halves the depth at least; the number of
    rounds is logarithmic in the number of nodes.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{label}_edges")
    k, sums = 0, None
    while True:
        # larger neighbours of a node go to its smallest neighbour, then smaller ones do
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = stage(large.where("a > b"), f"{label}_large_{k}")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").unionByName(least.select("a", F.col("low").alias("b"))).distinct()
        now = stage(small, f"{label}_small_{k}")
        said = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if sums == said:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sums, k = said, k + 1


def _blocks(table: pa.Table, forest: int | None) -> pa.Table:
    """Pairs of one task that may link: within the left piece if there is no other, else between left and right.

    With a `forest` number, only so many pairs as join everything that all of them would join; the number fixes which.
    Without one, a pair is left to the smallest signature that both share: `early` has some of the signatures of each class, so a
    smaller one in both lists tells for certain that this is not the smallest. That one tells the pair whatever the lists hold.
    """
    if forest is not None:
        order = np.argsort(mixed(np.asarray(table.column("node")).view(np.uint64) + np.uint64(forest)), kind="stable")
        table = table.take(pa.array(order))
    right = np.asarray(table.column("right").combine_chunks())
    inner = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    node, root, n = (np.asarray(table.column(c)) for c in ("node", "root", "n"))
    sig, lists = table.column("sig")[0].as_py(), table.column("early").combine_chunks()
    early = np.full((len(node), EARLY), sig)
    times = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    early[np.arange(EARLY) < times[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    raw = table.column("bits").to_pylist()
    width = np.array([len(x) for x in raw])
    packed = {w: (np.flatnonzero(width == w), np.frombuffer(b"".join(x for x in raw if len(x) == w), np.uint64).reshape(-1, w // 8)) for w in np.unique(width).tolist()}
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    joined = np.unique(root, return_inverse=True)[1]
    for long, (rows, words) in packed.items():
        for short, (others, less) in packed.items():
            if short > long or short * 4 < long:  # sizes differ by more than 1.25, lengths of bitmaps by more than 2
                continue
            folded = words
            while folded.shape[1] * 8 > short:
                half = folded.shape[1] // 2
                folded = folded[:, :half] ^ folded[:, half:]
            for k, one in zip(rows.tolist(), folded):
                near = others[9 * np.bitwise_count(less ^ one).sum(axis=1, dtype=np.int64) <= n[others] + n[k]]
                near = near[(root[near] != root[k]) & (4 * np.maximum(n[near], n[k]) <= 5 * np.minimum(n[near], n[k]))]
                near = near[(near > k) | (short < long)] if inner else near[right[near] != right[k]]
                if forest is None and len(near):
                    near = near[~np.isin(early[near], early[k][early[k] < sig]).any(axis=1)]
                if forest is not None and len(near):
                    groups, one_each = np.unique(joined[near], return_index=True)
                    near = near[one_each[groups != joined[k]]]
                    joined[np.isin(joined, groups)] = joined[k]
                a.append(np.minimum(node[near], node[k]))
                b.append(np.maximum(node[near], node[k]))
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _blocks_by(forest: int | None):
    return lambda table: _blocks(table, forest)


def pairs_of(placed: DataFrame) -> DataFrame:
    """sig and the number of pairs with different roots that a join by it makes."""
    of_root = placed.groupBy("sig", "root").agg(F.count("*").cast("double").alias("n"))
    return of_root.groupBy("sig").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))


class _Join:
    """The state of one join: classes, verified edges, and the roots that follow from them."""

    def __init__(self, docs: DataFrame) -> None:
        self.texts = _texts(docs)
        names = ["doc_id", "n_shingles", "node", "other", "bits"]
        schema = "doc_id bigint, n_shingles bigint, node bigint, other bigint, bits binary"
        self.rows = stage(self.texts.mapInArrow(_per_batch(_described, names), schema), "join_rows")
        known = self.rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        same = (F.min("other") == F.max("other")).alias("same")
        classes = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), same, F.first("bits").alias("bits"))
        sound = F.when(F.col("same"), F.col("doc_id")).otherwise(F.raise_error(F.lit("one digest for different sets")).cast("bigint"))
        self.classes = stage(classes.select("node", sound.alias("doc_id"), "n", "bits"), "join_classes")
        self.live = self.texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
        self.edges = self.roots = self.done = None
        self.step = 0

    def check(self, pairs: DataFrame) -> None:
        """Verify candidate pairs (a, b) of classes, and join what is linked."""
        self.step += 1
        found = self._candidates(pairs)
        if self.roots is None or not found.isEmpty():
            self._verify(found)

    def _candidates(self, pairs: DataFrame) -> DataFrame:
        if self.roots is not None:
            root = lambda c: self.roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
            pairs = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(
                F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
        of = lambda c: self.classes.select(F.col("node").alias(c), F.col("doc_id").alias(f"{c}_doc"), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))
        sized = pairs.join(of("a"), "a").join(of("b"), "b").where("5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)")
        sized = sized.select("a", "b", "a_doc", "b_doc", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(_possible, "a bigint, b bigint, a_doc bigint, b_doc bigint")
        if self.done is not None:
            sized = sized.join(self.done, ["a", "b"], "left_anti")
        return stage(sized, f"join_pairs_{self.step}")

    def _verify(self, sized: DataFrame) -> None:
        self.done = sized.select("a", "b") if self.done is None else self.done.unionByName(sized.select("a", "b"))
        used = sized.select(F.col("a_doc").alias("doc_id")).unionByName(sized.select(F.col("b_doc").alias("doc_id"))).distinct()
        found = stage(self.live.join(stage(used, f"join_used_{self.step}"), "doc_id", "left_semi"), f"join_texts_{self.step}")
        side = lambda c: found.select(F.col("doc_id").alias(f"{c}_doc"), F.col("text").alias(f"{c}_text"))
        full = sized.join(side("b"), "b_doc").join(side("a"), "a_doc").select("a", "b", "a_text", "b_text")
        linked = full.mapInArrow(_per_batch(_linked, ["a", "b"], "a_text"), "a bigint, b bigint")
        edges = stage(linked, f"join_edges_{self.step}")
        if self.roots is not None and edges.isEmpty():
            return
        self.edges = edges if self.edges is None else self.edges.unionByName(edges)
        self.roots = components(self.edges, f"join_{self.step}")

    def rooted(self, members: DataFrame) -> DataFrame:
        return members.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def within(self, members: DataFrame, label: str, hot: int | None, entry: float = 0) -> DataFrame | None:
        """Compare the classes that share a signature; return signatures left out as too costly."""
        hub = members.groupBy("sig").agg(F.min("node").alias("hub"))
        self.check(members.join(stage(hub, f"{label}_hubs"), "sig").where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
        placed = stage(self.rooted(members), f"{label}_placed")
        several = stage(pairs_of(placed).where("pairs > 0"), f"{label}_several")
        few = F.col("pairs") <= (0 if hot is None else hot * hot / 2)
        large = stage(placed.join(several.where(~few), "sig").select("sig", "node", "pairs"), f"{label}_large")
        if hot is None:
            return self.compare(large)
        placed = placed.join(several.where(few).select("sig"), "sig")
        left = placed.select("sig", F.col("node").alias("a"), F.col("root").alias("a_root"))
        right = placed.select("sig", F.col("node").alias("b"), F.col("root").alias("b_root"))
        self.check(left.join(right, "sig").where("a < b AND a_root <> b_root").select("a", "b").distinct())
        # one class stands for all: sets of one scheme are of much the same size, and only the cost hangs on it
        crowds = large.groupBy("sig").agg(F.max("pairs").alias("pairs"), F.count("*").alias("times"), F.min("node").alias("one"))
        sizes = self.classes.select(F.col("node").alias("one"), "n")
        costs = stage(crowds.join(sizes, "one").select("sig", (F.col("pairs") > entry * F.col("times") * F.col("n")).alias("dear")), f"{label}_costs")
        self.compare(large.join(costs.where("NOT dear").select("sig"), "sig"))
        return costs.where("dear").select("sig")

    def compare(self, placed: DataFrame, rows: int = 2048) -> None:
        """Compare all classes that share a signature, however many: pieces of them with pieces, by bitmaps; only what may link is a pair."""
        cut = placed.groupBy("sig").agg(F.ceil(F.count("*") / rows).cast("int").alias("p"))
        own = F.pmod(F.xxhash64("node"), "p").cast("int")
        turns = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j"), (i < own).alias("right")))
        early = placed.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("sig")), 1, EARLY).alias("early"))  # no more than a text has shingles
        facts = stage(early.join(self.classes.select("node", "n", "bits"), "node"), "join_facts")
        placed = stage(placed.join(cut, "sig").join(facts, "node").select("sig", "node", "n", "bits", "early", F.inline(turns)), "join_pieces")
        # first few pairs that would join a whole family, twice; then all that still lie between different roots
        for forest in (1, 2, None):
            tasks = self.rooted(placed).groupBy("sig", "i", "j").applyInArrow(_blocks_by(forest), "a bigint, b bigint")
            self.check(tasks.distinct())


def join(docs: DataFrame, hot: int = HOT, entry: float = ENTRY) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`. The result does not depend on `hot` and `entry`."""
    state = _Join(docs)
    schema, names = "sig bigint, node bigint, few int", ["sig", "node", "few"]
    low, high = (f(F.col("node")).over(Window.partitionBy("sig")) for f in (F.min, F.max))
    signed = state.live.mapInArrow(_per_batch(_signed(None), names), schema).withColumns({"low": low, "high": high})
    members = stage(signed.where("low < high OR few >= 0").distinct(), "join_members")
    few = sorted(r["few"] for r in members.where("few >= 0").select("few").distinct().collect())  # bands, fifty at most
    shared = members.where("low < high").select("sig", "node")
    left_out = state.within(shared, "join_subsets", hot, entry)
    if not left_out.isEmpty():
        _neighbours(state, shared, left_out, hot)
    if few:
        again = state.live.mapInArrow(_per_batch(_signed(few), names), schema).withColumns({"low": low, "high": high})
        again = stage(again.where("low < high").select("sig", "node").distinct(), "join_singles")
        state.within(again, "join_singles", None)
    return _named(state)


def _neighbours(state: _Join, shared: DataFrame, left_out: DataFrame, hot: int) -> None:
    """The second allocation: texts that hold a costly signature, by all their other subsets and one-deletion neighbourhoods."""
    nodes = stage(state.rooted(shared.join(left_out, "sig")).select("node", "root").distinct(), "join_affected")
    ids = stage(state.classes.join(nodes, "node").select("doc_id"), "join_affected_ids")
    texts = state.live.join(ids, "doc_id", "left_semi")
    names = ["sig", "whole", "node", "band", "kind", "weight", "bound"]
    schema = "sig bigint, whole bigint, node bigint, band int, kind int, weight int, bound bigint"
    spelled = stage(texts.mapInArrow(_per_batch(_neighbourhoods, names), schema).distinct().join(nodes, "node"), "join_spelled")
    # a subset that stands for a costly signature, in either text, matches nothing and counts for nothing
    of_root = spelled.groupBy("sig", "root").agg(F.count(F.when(F.col("kind") == 0, 1)).cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    product = lambda x, y: F.sum(x) * F.sum(y) - F.sum(F.col(x) * F.col(y))
    crowd = stage(of_root.groupBy("sig").agg(product("k", "n").alias("pairs")).where("pairs > 0"), "join_crowd")
    most = hot * hot / 2
    wide = crowd.where(F.col("pairs") > most).select("sig")
    lost = spelled.join(wide, "sig", "left_semi").select("whole", "node", "band").distinct()
    found = spelled.where("kind = 0").join(lost.withColumn("lost", F.lit(True)), ["whole", "node", "band"], "left")
    enough = found.groupBy("node", "band").agg(F.sum(F.when(F.col("lost"), 0).otherwise(F.col("weight"))).alias("w"), F.max("bound").alias("h"))
    weak = state.classes.join(nodes, "node", "left_semi").select("node").join(
        enough.groupBy("node").agg(F.min(F.col("w") > F.col("h")).alias("ok")).where("ok").select("node"), "node", "left_anti")
    weak = stage(weak, "join_weak")
    near = stage(spelled.join(crowd.where(F.col("pairs") <= most).select("sig"), "sig").select("sig", "node", "root", "kind"), "join_near")
    whole = near.where("kind = 0").select("sig", F.col("node").alias("a"), F.col("root").alias("a_root"))
    cut = near.select("sig", F.col("node").alias("b"), F.col("root").alias("b_root"))
    state.check(whole.join(cut, "sig").where("a_root <> b_root").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # both sides of a pair are weak, or one is strong and has found the other
    state.compare(stage(shared.join(left_out, "sig").join(weak, "node", "left_semi").select("sig", "node"), "join_rest"))


def _named(state: _Join) -> DataFrame:
    """Roots are digests; the component's name is its smallest doc_id."""
    placed = stage(state.rooted(state.classes.select("node", "doc_id")), "join_placed")
    least = stage(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "join_least")
    named = stage(placed.join(least, "root").select("node", "component_id"), "join_named")
    rows = state.rows.select("doc_id", "n_shingles", "node")
    own = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, one row per component: the smallest doc_id (null last), the first such row. Rows without shingles stay.

    Rows get keys when they are written, so null and shared doc_ids neither hide copies nor take other rows along.
    """
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*docs.columns).alias("_row")), "join_keyed")
    found = join(keyed.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text"))).where("n_shingles > 0")
    ranked = found.join(keyed.select(F.col("_key").alias("doc_id"), F.col("_row.doc_id").alias("id")), "doc_id").select(
        "component_id", F.struct(F.col("id").isNull(), "id", F.col("doc_id").alias("key")).alias("rank"))
    ranked = stage(ranked, "join_ranked")
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("first"))
    dropped = ranked.join(first, "component_id").where("rank <> first").select(F.col("rank.key").alias("_key"))
    return keyed.join(stage(dropped, "join_dropped"), "_key", "left_anti").select("_row.*")
