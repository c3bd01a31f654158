"""Embedding near-duplicates by a pigeonhole over subspaces, exact in double precision.

Two unit vectors with cosine c are at squared distance 2 - 2c, so links are pairs within T = 2 - 2 * threshold. Vectors are
rotated (random signs and a Hadamard transform, twice), which spreads differences evenly, and split into `blocks` blocks. Each block
has a budget: its share of the dimensions times T. If all blocks of a pair exceeded their budgets, the pair would exceed T, so every
link is within budget in some block.

Range join of a block: cells of a grid over its first `grid` coordinates, twice as wide as the radius. A vector lives in one
cell and visits those neighbours (half of all directions, so that a pair meets once) that its radius touches. In a cell, distances in
the block are matrix products of tiles; pairs within budget are candidates, their distances in all blocks are
computed anew in double precision and in fixed order, and the pair belongs to the first block where it is within budget. So each
pair counts once, with no pair ever written down: a task gives each vector its number of links and the smallest
vector it is joined with. Rotated vectors travel as 32-bit floats; pairs whose cosine is within `UNSURE` of the threshold are written, and
are decided on the unit vectors in double precision.

Cells with more than `rows` vectors are cut into pieces, and a task compares two pieces. Equal vectors form one class with a
weight first. For vectors that lie evenly in all directions the number of comparisons stays nearly quadratic (a grid of
few coordinates is wide at this threshold), in tiles; what is shuffled grows with the vectors, times the pieces of a cell.

Edge cases: null, empty, zero vectors and vectors with null or non-finite components link with nothing, neither do vectors of
different lengths; rows without vec_id are returned with no links, null component_id and kept true; rows that share a vec_id are vectors of
their own, which are one in components; repeated rows count as links of each other; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .jaccard_join import components
from .texts import mixed

THRESHOLD = 0.95
BLOCKS = 4
#: Vectors of one side of a task, and of a tile of it.
ROWS = 16_384
TILE = 1024
#: Rounding to 32 bits moves a cosine by less than a tenth of UNSURE; products of tiles in 32 bits are off by less than SLACK.
UNSURE = 1e-6
SLACK = 2e-5
PAIRS = 50_000


def unit_vectors(column: pa.Array) -> list[bytes | None]:
    """Unit vectors as bytes of doubles; none for vectors that have no direction."""
    out: list[bytes | None] = [None] * len(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    values = column.flatten()
    known = np.asarray(values.is_valid())
    flat = np.asarray(pa.compute.fill_null(values.cast(pa.float64()), np.nan))
    first = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        place = first[rows][:, None] + np.arange(size)
        vectors = np.where(known[place], flat[place], np.nan)
        top = np.abs(vectors).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        vectors = vectors[good] / top[good][:, None]
        vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        for row, vector in zip(rows[good].tolist(), vectors):
            out[row] = vector.tobytes()
    return out


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Distances stay; the length is filled up to a power of two."""
    n, size = vectors.shape
    width = max(1 << (size - 1).bit_length(), BLOCKS)
    out = np.zeros((n, width))
    out[:, :size] = vectors
    for turn in range(2):
        sign = np.where(mixed(np.arange(width, dtype=np.uint64) + np.uint64(1000 * turn + 17)) & np.uint64(1), 1.0, -1.0)
        out *= sign
        half = 1
        while half < width:
            pair = out.reshape(n, width // (2 * half), 2, half)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
            half *= 2
        out /= np.sqrt(width)
    return out


def block_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances by block, the same for the same two vectors wherever they meet."""
    d = left.astype(np.float64) - right.astype(np.float64)
    return np.add.reduce((d * d).reshape(len(d), BLOCKS, -1), axis=2)


def placements(vectors: np.ndarray, threshold: float, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vector, block, cell, whether it only visits) of rotated vectors."""
    n, width = vectors.shape
    radius = np.sqrt((2 - 2 * threshold) / BLOCKS + SLACK)
    reach = radius + 1e-6
    cell = 2 * reach
    base = 2 * int(np.ceil(1 / cell)) + 5
    grid = min(grid, width // BLOCKS)
    halves = [d for d in itertools.product((-1, 0, 1), repeat=grid) if d > (0,) * grid]
    which, blocks, cells, visits = [], [], [], []
    for b in range(BLOCKS):
        at = vectors[:, b * (width // BLOCKS) :][:, :grid].astype(np.float64)
        home = np.floor(at / cell)
        inside = at - home * cell  # from 0 to cell
        power = base ** np.arange(grid)
        number = ((home + base // 2) @ power if grid else np.zeros(n)).astype(np.int64)
        gap = {-1: inside**2, 0: np.zeros_like(inside), 1: (cell - inside) ** 2}
        every = [(np.arange(n), number, False)]
        for d in halves:
            far = sum((gap[x][:, k] for k, x in enumerate(d)), np.zeros(n))
            rows = np.flatnonzero(far <= reach * reach)
            every.append((rows, number[rows] + int(np.dot(d, power)), True))
        for rows, where, visit in every:
            which.append(rows)
            blocks.append(np.full(len(rows), b))
            cells.append(where)
            visits.append(np.full(len(rows), visit))
    return tuple(np.concatenate(x) for x in (which, blocks, cells, visits))


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join a[i] with b[i] for all i; `root` points to smaller or equal numbers, and to roots when done."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def compare(vectors: np.ndarray, weights: np.ndarray, n_left: int, inner: bool, block: int, threshold: float):
    """Links among the left vectors (if `inner`) and between left and right ones, for the pairs that belong to `block`.

    Returns the weight of each vector's links, its root, and the unsure pairs.
    """
    n, width = vectors.shape
    each = width // BLOCKS
    budget = (2 - 2 * threshold) / BLOCKS + SLACK / 2
    part = np.ascontiguousarray(vectors[:, block * each : (block + 1) * each])
    norm = (part * part).sum(axis=1)
    links, root, unsure = np.zeros(n, np.int64), np.arange(n), []
    for a in range(0, n_left, TILE):
        z = min(a + TILE, n_left)
        for c in range(a if inner else n_left, n, TILE):
            e = min(c + TILE, n)
            near = norm[a:z, None] + norm[None, c:e] - 2 * (part[a:z] @ part[c:e].T) <= budget + SLACK
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            once = i < j
            i, j = i[once], j[once]
            for k in range(0, len(i), PAIRS):
                x, y = i[k : k + PAIRS], j[k : k + PAIRS]
                d = block_distances(vectors[x], vectors[y])
                own = (d[:, block] <= budget) & (d[:, :block] > budget).all(axis=1)
                cosine = 1 - d.sum(axis=1) / 2
                sure = own & (cosine >= threshold + UNSURE)
                np.add.at(links, x[sure], weights[y[sure]])
                np.add.at(links, y[sure], weights[x[sure]])
                unite(root, x[sure], y[sure])
                open_ = own & ~sure & (cosine >= threshold - UNSURE)
                if open_.any():
                    unsure.append(np.stack([x[open_], y[open_]]))
    return links, root, np.concatenate(unsure, axis=1) if unsure else np.zeros((2, 0), np.int64)


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, key) and classes of equal vectors (node, key, vec_id, weight, unit)."""

    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit_vectors(batch.column(1)), pa.binary())], names=["vec_id", "unit"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(units, "vec_id bigint, unit binary")
    rows = stage(rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.unhex(F.sha2("unit", 256)))), "subspace_rows")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
    return rows, stage(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "subspace_classes")


def _placed(classes: DataFrame, threshold: float, grid: int, whole: bool) -> DataFrame:
    """Where every class takes part: size (of the vector), block, cell, visit; with its rotated vector if `whole`."""
    schema = "node bigint, size int, block int, cell bigint, visit boolean" + (", weight bigint, vector binary" if whole else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def call(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, weights = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            sizes = np.asarray(pa.compute.binary_length(batch.column(2)))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                data = np.frombuffer(b"".join(batch.column(2).take(pa.array(rows)).to_pylist())).reshape(len(rows), -1)
                turned = rotated(data).astype(np.float32)
                which, block, cell, visit = placements(turned, threshold, grid)
                out = [nodes[rows][which], np.full(len(which), size, np.int32), block.astype(np.int32), cell, visit]
                if whole:
                    packed = pa.array([v.tobytes() for v in turned], pa.binary())
                    out += [weights[rows][which], packed.take(pa.array(which))]
                yield from pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names).to_batches(max_chunksize=4096)

    return classes.select("node", "weight", "unit").mapInArrow(call, schema)


def _tasks(placed: DataFrame, sizes: DataFrame, rows: int) -> DataFrame:
    """Each row once per task: (size, block, cell, i, j, right). Cells of several pieces are compared piece by piece."""
    p, q = F.ceil(F.col("homes") / rows).cast("int"), F.ceil(F.col("visitors") / rows).cast("int")
    big = sizes.where((F.col("homes") + F.col("visitors")) > 2 * rows).select("size", "block", "cell", F.greatest(p, F.lit(1)).alias("p"), q.alias("q"))
    cut = placed.join(big, ["size", "block", "cell"], "left")
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    task = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), right.alias("right"))
    none = F.array(task(F.lit(0), F.lit(0), F.col("visit")))
    h = at(F.col("p"))
    homes = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: task(F.least(i, h), F.greatest(i, h), i < h)),
        F.when(F.col("q") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("q") - 1, F.lit(0))), lambda v: task(h, F.col("p") + v, F.lit(False)))).otherwise(F.array()),
    )
    visitors = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: task(i, F.col("p") + at(F.col("q")), F.lit(True)))
    spread = F.when(F.col("p").isNull(), none).when(F.col("visit"), visitors).otherwise(homes)
    return cut.withColumn("task", F.explode(spread)).select("node", "weight", "vector", "size", "block", "cell", "task.*")


def links(classes: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, grid: int | None = None) -> DataFrame:
    """node, links, other, sure: a node's links in a task and the smallest node there it is joined with, or an unsure pair."""
    if grid is None:  # one coordinate more for every doubling beyond a cell's size; results do not depend on it
        n = classes.agg(F.max(F.octet_length("unit")), F.count("*")).first()[1]
        grid = min(3, max(1, int(np.ceil(np.log2(max(n, 1) / rows)))))

    sizes = stage(_placed(classes, threshold, grid, False).groupBy("size", "block", "cell").agg(
        F.count(F.when(~F.col("visit"), 1)).alias("homes"), F.count(F.when(F.col("visit"), 1)).alias("visitors")), "subspace_cells")
    shared = sizes.where("homes > 0 AND homes + visitors > 1")
    placed = _placed(classes, threshold, grid, True)
    tasks = _tasks(placed, shared, rows)

    def call(table: pa.Table) -> pa.Table:
        right = np.asarray(table.column("right").combine_chunks())
        order = np.argsort(right, kind="stable")
        n_left = int((~right).sum())
        nodes = np.asarray(table.column("node"))[order]
        weights = np.asarray(table.column("weight"))[order]
        data = table.column("vector").combine_chunks().take(pa.array(order)).to_pylist()
        vectors = np.frombuffer(b"".join(data), np.float32).reshape(len(data), -1)
        inner = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        count, root, (a, b) = compare(vectors, weights, n_left, inner, table.column("block")[0].as_py(), threshold)
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, root, nodes)
        some = np.flatnonzero(count > 0)
        return pa.table({
            "node": np.r_[nodes[some], nodes[a]], "links": np.r_[count[some], np.zeros(len(a), np.int64)], "other": np.r_[least[root[some]], nodes[b]],
            "sure": np.r_[np.ones(len(some), bool), np.zeros(len(a), bool)],
        })

    return tasks.groupBy("size", "block", "cell", "i", "j").applyInArrow(call, "node bigint, links bigint, other bigint, sure boolean")


def _exact(classes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The unsure pairs (node, other) that are linked, decided on unit vectors in double precision."""

    def call(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [bool(np.dot(np.frombuffer(x), np.frombuffer(y)) >= threshold) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(2)], names=["node", "other"])

    full = pairs.join(classes.select("node", F.col("unit").alias("u")), "node").join(
        classes.select(F.col("node").alias("other"), F.col("unit").alias("v")), "other")
    return full.select("node", "other", "u", "v").mapInArrow(call, "node bigint, other bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, grid: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding)."""
    if not 0.5 <= threshold < 1:
        raise ValueError("threshold must be from 0.5 to below 1")
    members, classes = _classes(vectors)
    found = stage(links(classes, threshold, rows, grid), "subspace_found")
    close = stage(_exact(classes, found.where("NOT sure").select("node", "other"), threshold), "subspace_close")
    weight = lambda c: classes.select(F.col("node").alias(c), "weight")
    counted = found.where("sure").select("node", "links").unionByName(
        close.join(weight("other"), "other").select("node", F.col("weight").alias("links"))).unionByName(
        close.join(weight("node"), "node").select(F.col("other").alias("node"), F.col("weight").alias("links")))
    total = counted.groupBy("node").agg(F.sum("links").alias("links"))
    # classes that share a vec_id are one vector to the components
    same = classes.groupBy("vec_id").agg(F.min("node").alias("b"), F.count("*").alias("n"), F.collect_list("node").alias("nodes")).where("n > 1")
    edges = found.where("sure AND node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(
        close.select(F.col("node").alias("a"), F.col("other").alias("b"))).unionByName(same.select(F.explode("nodes").alias("a"), "b"))
    roots = components(edges, "subspace")
    named = stage(classes.select("node", "key", "vec_id", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "subspace_roots")
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    facts = named.join(least, "root").join(total, "node", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id")
    out = members.select("vec_id", "key").join(facts, "key", "left")
    component: Column = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
