"""Manifest, fill-in-middle and embedding join against brute force and odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteskill.llm import counted_infill, subspace_join, witness_manifest

LEAVES = "doc_id bigint, lang string, leaf string"


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def brute_tree(nodes):
    """Root and, per leaf, the siblings level by level."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            proofs[k] += [n for j, n in enumerate(nodes[p // 8 * 8 : p // 8 * 8 + 8]) if j != p % 8]
            place[k] = p // 8
        nodes = [h(*nodes[r : r + 8]) for r in range(0, len(nodes), 8)]
    return nodes[0], proofs


def brute_manifest(rows):
    langs = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        group = sorted((r for r in rows if r[1] == lang), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees.append((group, *brute_tree([r[2] for r in group])))
    root, outer = brute_tree([t[1] for t in trees])
    return Counter((*r, subroot, root, h(*inner, *outer[k])) for k, (group, subroot, proofs) in enumerate(trees) for r, inner in zip(group, proofs))


@pytest.mark.parametrize("sizes", [[1], [3], [9, 1, 64, 65], [1] * 11, [4097, 8], [40_000]])
def test_manifest_equals_whole_trees(spark, sizes):
    rows = [((k * 7919) % 100_003 if k % 97 != 5 else None, None if g == 1 else f"é{g}", h(str(k % 3000))) for g, n in enumerate(sizes) for k in range(n)]
    told = witness_manifest.manifest(spark.createDataFrame(rows, LEAVES))
    told = told.withColumns({"back": witness_manifest.folded(F.col("leaf"), F.col("witness")), "proof": F.sha2(witness_manifest.proof(F.col("witness")).cast("binary"), 256)})
    got = told.drop("witness").collect()
    assert Counter((r.doc_id, r.lang, r.leaf, r.subroot, r.root, r.proof) for r in got) == brute_manifest(rows)
    assert all(r.back == r.root for r in got)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 63, 64, 65, 513])
def test_appender_keeps_witnesses_as_it_goes(n):
    nodes = [h(str(k)) for k in range(n)]
    grown = witness_manifest.Appender()
    for node in nodes:
        grown.append(node)
        assert sum(len(run) for run in grown.open) <= 7 * len(grown.open)
    root, proofs = brute_tree(nodes)
    assert grown.finish(witness_manifest._levels(n)) == root
    assert ["".join(a + b for a, b in w) for w in grown.witness] == ["".join(p) for p in proofs]


def test_manifest_of_odd_rows(spark):
    assert witness_manifest.manifest(spark.createDataFrame([], LEAVES)).collect() == []
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "é", "x")], "doc_id bigint, text string, extra string")
    got = docs.select(witness_manifest.leaf_of(F.col("doc_id"), F.col("text")).alias("leaf")).collect()
    assert [r.leaf for r in got] == [h("--"), h("1:10:"), h("1:12:é")]
    with pytest.raises(ValueError):
        witness_manifest.manifest(spark.createDataFrame([(1, "a", "b", 1)], LEAVES + ", root int"))


def brute_infill(key, text, how=counted_infill.Infill(), unit=r"[^\n]*\n|[^\n]+"):
    units = re.findall(unit, text)
    d = h(f"{how.seed}:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(d[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in how.marks) or h3 % 100 >= how.rate:
        return key, len(units), "plain", text, None, None
    psm = h4 % 100 >= how.spm_rate
    out = how.prefix + p + how.suffix + s + how.middle + m if psm else how.suffix + s + how.prefix + p + how.middle + m
    return key, len(units), "psm" if psm else "spm", out, len(p), len(m)


@pytest.mark.parametrize("how", [counted_infill.Infill(), counted_infill.Infill(3, counted_infill.LINE, 60, 50, "$1", "\\E(", "é|")])
def test_infill_equals_brute_force(spark, how):
    texts = ["a\nb\nc", None, "", "x<P>y", "x$1", "\n\n\n", "é\n" * 100_000, "one", "a$2\\b\n$2\n\r\x85  z\n", "<P\n>", "\n", "<\n<S", "z" * 200_000]
    rows = [(k, t) for k in range(7) for t in texts] + [(None, "a\nb"), (None, "a\nb")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, n string, _parts int")
    told = counted_infill.transformed(docs, how).withColumn("back", counted_infill.restored(F.col("output"), F.col("form"), how))
    got = told.collect()
    assert Counter((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in got) == Counter(brute_infill(k, t or "", how) for k, t in rows)
    assert Counter(r.back for r in got) == Counter(t or "" for _, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert counted_infill.transformed(docs.limit(0), how).collect() == []


def test_infill_by_words_and_its_refusals(spark):
    how = counted_infill.Infill(unit=counted_infill.WORD)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b  c\n d ", "  ", "x"] * 5)], "doc_id bigint, text string")
    got = counted_infill.transformed(docs, how).withColumn("back", counted_infill.restored(F.col("output"), F.col("form"), how)).collect()
    assert [r.back for r in got] == [r.text for r in got] and {r.n for r in got} == {5, 1}
    for marks in [("<P>", "<P>", "x"), ("ab", "b", "x"), ("ab", "ca", "x"), ("aba", "x", "y"), ("", "x", "y")]:
        with pytest.raises(ValueError):
            counted_infill.transformed(docs, counted_infill.Infill(7, counted_infill.LINE, 100, 50, *marks))
    with pytest.raises(Exception, match="units do not tile"):
        counted_infill.transformed(docs, counted_infill.Infill(unit="[a-z]")).collect()


VECTORS = "vec_id bigint, embedding array<double>, label int"


def brute_links(rows, threshold=0.95):
    ids = [k for k, _ in rows]
    scaled = [np.array(v) / np.abs(v).max() for _, v in rows]
    unit = [v / np.linalg.norm(v) for v in scaled]
    link = np.array([[i != j and len(x) == len(y) and x @ y >= threshold for j, y in enumerate(unit)] for i, x in enumerate(unit)])
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *[root[j] for j in np.flatnonzero(link[i])]]) for i in range(len(rows))]
    least = {}
    for k, r in zip(ids, root):
        least[r] = min(k, least.get(r, k))
    return Counter((k, int(link[i].sum()), least[root[i]], k == least[root[i]]) for i, k in enumerate(ids))


def joined(df, **options):
    return Counter(tuple(r) for r in subspace_join.near_duplicates(df, **options).collect())


@pytest.mark.parametrize("size", [1, 5, 100])
def test_join_of_vectors_equals_brute_force(spark, size):
    rng = np.random.default_rng(size)
    bases = rng.normal(size=(9, size))
    rows = [(k, (bases[k % 9] * rng.choice([1, 3e-200, 1e200]) * (1 + rng.normal(size=size) * rng.choice([0, 0.05, 0.2, 0.3]))).tolist()) for k in range(150)]
    rows += [(500 + k, rows[k][1]) for k in range(5)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    want = brute_links(rows)
    for options in ({}, {"rows": 16}, {"rows": 24, "grid": 2}):
        assert joined(df, **options) == want


def test_join_of_vectors_at_the_threshold(spark):
    """Pairs on both sides of the threshold, closer to it than 32-bit floats can tell."""
    rows, k = [], 0
    for step in (-3e-9, -1e-12, 1e-12, 3e-9, 1e-5):
        c = 0.95 + step
        for _ in range(4):
            rows += [(k, [0.0] * k + [1.0, 0.0] + [0.0] * (60 - k)), (k + 1, [0.0] * k + [c, float(np.sqrt(1 - c * c))] + [0.0] * (60 - k))]
            k += 2
    assert joined(spark.createDataFrame([(*r, 0) for r in rows], VECTORS)) == brute_links(rows)


def test_join_of_odd_vectors(spark):
    assert joined(spark.createDataFrame([], VECTORS)) == Counter()
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (None, [1.0, 1.0]), (10, [1.0, -1.0])]
    rows += [(10, [-1.0, 1.0]), (11, [-1.0, 1.0]), (7, [1.0, 1.0])]
    got = joined(spark.createDataFrame([(*r, 0) for r in rows], VECTORS))
    alone = [(k, 0, k, True) for k in (1, 2, 3, 4, 5, 6, 9)]
    assert got == Counter([*alone, (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (None, 0, None, True), (10, 0, 10, True), (10, 1, 10, True), (11, 1, 10, False)])
    with pytest.raises(ValueError):
        subspace_join.near_duplicates(spark.createDataFrame([], VECTORS), 0.2)
