"""Text operators against brute force, round trips and odd inputs."""

import dataclasses
import hashlib
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from siteskill.llm import chat_grammar, gumbel_pieces, invertible_sketch, jaccard_join, pareto_mix, payload_archive, queries, rule_ledger

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, extra=""):
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


def frame(words, *edits):
    out = list(words)
    for at, word in edits:
        out[at] = word
    return " ".join(out)


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(texts):
    sets = [(k, shingles(t)) for k, t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i][1] & sets[j][1])
        if both and 100 * both >= 80 * len(sets[i][1] | sets[j][1]):
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


def joined(docs, **options):
    return sorted(tuple(r) for r in jaccard_join.join(docs, **options).collect())


@pytest.mark.parametrize(("hot", "entry"), [(1, 0), (1, 1e9), (32, 20)])
def test_join_finds_every_link(spark, hot, entry):
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(0, 40_000))
    passage = [word() for _ in range(50)]
    texts, k = [], itertools.count()
    for size in [1, 3, 4, 5, 6, 8, 9, 12, 20, 21, 25, 40, 90, 200, 400]:
        words = [word() for _ in range(size)]
        texts += [(next(k), " ".join(words)), (next(k), "  ".join(words).upper()), (next(k), " ".join(words[:-1])), (next(k), frame(words, (size // 2, word())))]
        texts += [(next(k), frame(words, (size // 3, word()), (size - 1, word()))), (next(k), " ".join(words[size // 10 :]))]
    for n in (3, 8, 14, 30, 60):  # texts that share a passage
        texts += [(next(k), " ".join(passage + [word() for _ in range(n)])) for _ in range(6)]
    texts += [(next(k), None), (next(k), ""), (next(k), " \n\t")]
    assert joined(docs_of(spark, texts), hot=hot, entry=entry) == brute_components(texts)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    texts = []
    for n in (5, 6, 9, 40, 130, 700):
        words = [f"w{k}" for k in rng.integers(0, 9999, n)]
        texts += [" ".join(words), " ".join(words[: max(5, int(0.9 * n))]), " ".join([*words, "x", "y"]), frame(words, (n // 2, "z"))]
    row, value = jaccard_join.Shingler().sets(texts)
    bits = jaccard_join.parities(row, value, np.bincount(row, minlength=len(texts)))
    for i, j in itertools.product(range(len(texts)), repeat=2):
        apart = len(np.setxor1d(value[row == i], value[row == j]))
        assert jaccard_join.differ(bits[i], bits[j]) <= apart
        assert i // 4 == j // 4 or jaccard_join.differ(bits[i], bits[j]) > 0


@pytest.mark.parametrize(("size", "entry"), [(20, 20), (60, 20), (60, 0)])
def test_families_with_a_common_passage_are_hardly_verified(spark, monkeypatch, size, entry):
    rng = np.random.default_rng(size)
    word = lambda: "w" + str(rng.integers(0, 40_000))
    passage = [word() for _ in range(60)]
    texts = []
    for f in range(2):
        own = [word() for _ in range(60)]
        texts += [(1000 * f + k, " ".join(frame(own, (k % 60, word())).split() + passage)) for k in range(size)]
    verified, staged = [], jaccard_join.stage

    def counting(df, label):
        out = staged(df, label)
        if label.startswith("join_pairs"):
            verified.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stage", counting)
    assert joined(docs_of(spark, texts), hot=4, entry=entry) == brute_components(texts)
    assert sum(verified) <= 8 * len(texts)


def test_members_of_a_common_signature_meet_their_bitmaps_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [(k, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 40_000, 10 + k % 7))) for k in range(80)]
    wide, staged = [], jaccard_join.stage

    def spying(df, label):
        if {"sig", "bits"} <= set(df.columns):
            wide.append(label)
        return staged(df, label)

    monkeypatch.setattr(jaccard_join, "stage", spying)
    assert joined(docs_of(spark, texts), hot=4) == brute_components(texts)
    assert wide == ["join_pieces"]


def test_a_pair_is_told_by_the_smallest_common_signature():
    # classes 0 to 4 share the signatures 10, 20 and 30; class 5 has 20 and 30; all may link
    held = {node: [10, 20, 30] if node < 5 else [20, 30] for node in range(6)}
    told = []
    for sig in (10, 20, 30):
        nodes = [k for k, sigs in held.items() if sig in sigs]
        rows = [{"sig": sig, "node": k, "n": 20, "bits": bytes(8), "early": held[k], "i": 0, "j": 0, "right": False, "root": k} for k in nodes]
        pairs = jaccard_join._blocks(pa.Table.from_pylist(rows), None)
        told += zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())
    assert sorted(told) == list(itertools.combinations(range(6), 2))


def test_join_defines_odd_rows(spark):
    assert joined(docs_of(spark, [])) == []
    text = "one two three four five six"
    rows = [(3, text, None, None, None), (None, text, None, None, None), (3, text, None, None, None), (1, text, None, None, None)]
    got = Counter(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter({(3, 2, 1): 2, (None, 2, None): 1, (1, 2, 1): 1})


@pytest.mark.parametrize("n", range(6))
def test_join_of_a_single_short_text(spark, n):
    texts = [(7, " ".join(f"w{k}" for k in range(n)))]
    assert joined(docs_of(spark, texts)) == brute_components(texts)


def test_three_words_in_several_texts():
    for texts in (["a", "b c"], ["a", "b", "c"], [None, "a b c", ""]):
        row, _ = jaccard_join.Shingler().sets(texts)
        assert row.tolist() == [i for i, t in enumerate(texts) if t]


def test_archive_reconstructs_records(spark):
    big = "é" * 600
    rows = [(1, "http://a/\r\nX", big), (2, None, big), (3, "", "small"), (4, "u", "small"), (5, "u", None), (7, "u", big), (7, "u", big), (None, "u", big)]
    archive = payload_archive.write(spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, key string"))
    assert archive.payloads.count() == 3
    got = Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in payload_archive.read_back(archive).collect())
    sha = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    url = lambda u: u and u.replace("\r", "%0D").replace("\n", "%0A")
    want = Counter()
    for page, u, html in rows:
        revisit = html == big and page != 7
        want[(page, url(u), len((html or "").encode()), sha(html), "revisit" if revisit else "response", 7 if revisit else None)] += 1
    assert got == want
    records = payload_archive.records(archive).collect()
    assert len(records) == len(rows)
    for r in records:
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert len(body) - 4 == int(re.search(rb"Content-Length: (\d+)", head)[1])


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<\\\\|", "<|", "", None, "a\n<n|b", "<"]
    roles = ["user", "assistant", "a\nb", "<|im_start|>", None]
    rows = [(k, t, roles[(k + t) % 5], texts[(2 * k + t) % 9], 0) for k in range(12) for t in range(4)]
    told = chat_grammar.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int"))
    got = told.withColumn("turns", chat_grammar.recovered(told["formatted"])).collect()
    assert len(got) == 12
    for r in got:
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert r.same and [(t.role, t.text) for t in r.turns] == want
        assert r.escaped or "<\\" not in r.formatted


def test_sketches_recover_differences(spark):
    rng = np.random.default_rng(5)
    line = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 200)))
    texts = [(600 * k % 7001, "\n".join(line() for _ in range(n))) for k, n in enumerate([1, 2, 5, 9, 20, 40, 80, 150, 700])]
    texts += [(20_000, None), (20_001, ""), (20_002, "same"), (20_003, "same")]
    got = {r.doc_id: r for r in invertible_sketch.compared(docs_of(spark, texts)).collect()}
    order = sorted(((k, t or "") for k, t in texts), reverse=True)
    parts = lambda t: set(re.findall(r"[^\n]{1,128}", t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (k, text) in enumerate(order):
        following, half = order[(i + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[k].n_chars == len(text) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k].near_edited == pytest.approx(like(parts(text), parts(edited)))
        assert got[k].near_next == pytest.approx(like(parts(text), parts(following)))
    assert got[20_002].fingerprint == got[20_003].fingerprint and len({r.fingerprint for r in got.values()}) == len(texts) - 2


def test_sketches_of_odd_rows(spark):
    assert invertible_sketch.compared(docs_of(spark, [])).collect() == []
    only = invertible_sketch.compared(spark.createDataFrame([(None, "a\nb", 1)], "doc_id bigint, text string, edited int")).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in only] == [(None, 3, 1.0)]


def test_sampled_segmentations_have_their_probabilities():
    sampler = gumbel_pieces.Sampler(gumbel_pieces.vocabulary())
    units = gumbel_pieces.units_of("the ca", sampler.vocab)
    sampler.learn(set(units))
    numbers = np.array([sampler.number[u] for u in units])
    chance = {c: float(np.exp(sum(sampler.logp[j] for j in c))) for c in itertools.product(*[range(sampler.first[n], sampler.first[n + 1]) for n in numbers])}
    assert sum(chance.values()) == pytest.approx(1)
    first, second, estimate, n = Counter(), Counter(), 0.0, 3000
    for i in range(n):
        *drawn, (_, _, after) = sampler.sample(numbers, gumbel_pieces.seed(i, None), 2)
        a, b = (tuple(int(j) for j in d[0]) for d in drawn)
        assert a != b and drawn[0][2] >= drawn[1][2] >= after
        first[a] += 1
        second[b] += 1
        estimate += sum(np.exp(d[1]) / -np.expm1(-np.exp(d[1] - after)) for d in drawn) / n
    assert max(abs(first[c] / n - p) for c, p in chance.items()) < 0.03
    after = {c: sum(p * q / (1 - p) for d, p in chance.items() if d != c) for c, q in chance.items()}  # without replacement
    assert max(abs(second[c] / n - p) for c, p in after.items()) < 0.03
    assert estimate == pytest.approx(1, abs=0.05)


@pytest.mark.parametrize("text", ["information", "a  straße😀été", "x     internationals", "-" * 9, "       "])
def test_lattice_spans_whole_words(text):
    vocab = gumbel_pieces.vocabulary()
    sampler, units = gumbel_pieces.Sampler(vocab), gumbel_pieces.units_of(text, vocab)
    ways = [gumbel_pieces.unit_lattice(u, vocab) for u in units]
    total = sum(np.logaddexp.reduce([w for w, _ in x]) for x in ways)
    chance = Counter()
    for path in itertools.product(*ways):
        chance[sum((t for _, t in path), ())] += np.exp(sum(w for w, _ in path) - total)
    sampler.learn(set(units))
    numbers, n, first, second, estimate = np.array([sampler.number[u] for u in units]), 2000, Counter(), Counter(), 0.0
    for *drawn, (_, _, after) in sampler.sample_all([numbers] * n, np.array([gumbel_pieces.seed(i, None) for i in range(n)]), 2):
        a, b = (tuple(sampler.spelled(d[0]).tolist()) for d in drawn)
        assert a != b and drawn[0][2] >= drawn[1][2] >= after
        assert [d[1] for d in drawn] == pytest.approx([np.log(chance[x]) for x in (a, b)], abs=1e-9)
        first[a] += 1
        second[b] += 1
        estimate += sum(np.exp(d[1]) / -np.expm1(-np.exp(d[1] - after)) for d in drawn) / n
    common = sorted(chance, key=chance.get)[-40:]
    assert max(abs(first[c] / n - chance[c]) for c in common) < 0.04
    want = {c: sum(p * chance[c] / (1 - p) for d, p in chance.items() if d != c) for c in common}  # without replacement
    assert max(abs(second[c] / n - p) for c, p in want.items()) < 0.04
    assert estimate == pytest.approx(1, abs=0.05)
    if text == "information":
        assert first[(vocab.ids[" information"],)] > n / 2


def test_units_are_cut_where_no_piece_crosses():
    vocab = gumbel_pieces.vocabulary()
    for text in ("end.\nStart of it, 12,5 x😀y\u4e2d\u6587", "a", "\n\n", "z" * 50):
        units = gumbel_pieces.units_of(text, vocab)
        assert "".join(units) == " " + text
        cuts = set(itertools.accumulate(map(len, units)))
        whole = " " + text
        for a, b in itertools.combinations(range(len(whole) + 1), 2):
            assert whole[a:b] not in vocab.ids or not any(a < c < b for c in cuts)


def test_search_of_a_text_is_its_own():
    sampler = gumbel_pieces.Sampler(gumbel_pieces.vocabulary())
    texts = ["international information", "", "a", "d" * 3000, "ab " * 400 + "extraordinarily"]
    units = [gumbel_pieces.units_of(t, sampler.vocab) for t in texts]
    sampler.learn(set().union(*units))
    numbers = [np.array([sampler.number[u] for u in x], np.int64) for x in units]
    keys = np.array([gumbel_pieces.seed(i, None) for i in range(len(texts))])
    for got, text, x, key in zip(sampler.sample_all(numbers, keys, 3), texts, numbers, keys):
        alone = sampler.sample(x, key, 3)
        assert [(d[1], d[2]) for d in got] == [(d[1], d[2]) for d in alone] and len(got) == (2 if not text else len(alone))
        for choice, log_prob, _ in got[:-1]:
            assert gumbel_pieces.decoded(sampler.spelled(choice).tolist(), sampler.vocab) == text
            assert log_prob == pytest.approx(sampler.logp[choice].sum())


def test_frequent_units_stay_and_paths_do_not_change(monkeypatch):
    def run(known):
        monkeypatch.setattr(gumbel_pieces, "KNOWN", known)
        rng, sampler, out, stayed = np.random.default_rng(1), gumbel_pieces.Sampler(gumbel_pieces.vocabulary()), [], 0
        for turn in range(8):
            rare = [" ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(30)) for _ in range(4)]
            units = [gumbel_pieces.units_of(f"the common information \u4e2d😀é of it {t}", sampler.vocab) for t in rare]
            stayed += " information" in sampler.number
            sampler.learn(set().union(*units))
            numbers = [np.array([sampler.number[u] for u in x], np.int64) for x in units]
            found = sampler.sample_all(numbers, np.array([gumbel_pieces.seed(4 * turn + i, None) for i in range(4)]), 2)
            out += [(sampler.spelled(d[0]).tolist(), d[1], d[2]) for x in found for d in x[:-1]]
        return out, stayed, sampler.n_edges

    whole, kept = run(10**9), run(3000)
    assert kept[0] == whole[0] and kept[1] == 7 and kept[2] < whole[2] / 2


def test_units_that_come_back_are_kept_though_forgotten_between(monkeypatch):
    monkeypatch.setattr(gumbel_pieces, "KNOWN", 3000)
    rng, sampler, stayed = np.random.default_rng(2), gumbel_pieces.Sampler(gumbel_pieces.vocabulary()), 0
    for turn in range(60):
        rare = " ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(100))
        stayed += turn > 30 and " information" in sampler.number
        sampler.learn(set(gumbel_pieces.units_of(rare + " information" * (turn % 5 == 0), sampler.vocab)))
    assert stayed == 29


def test_rare_units_pass_with_their_batch(monkeypatch):
    monkeypatch.setattr(gumbel_pieces, "KNOWN", 6000)
    rng, sampler, forgotten, forget = np.random.default_rng(3), gumbel_pieces.Sampler(gumbel_pieces.vocabulary()), [], gumbel_pieces.Sampler.forget
    monkeypatch.setattr(gumbel_pieces.Sampler, "forget", lambda self: [forgotten.append(len(self.number)), forget(self)])
    for turn in range(40):
        rare = " ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(100))
        units = set(gumbel_pieces.units_of(rare + " information of the 中 x internationals", sampler.vocab))
        assert turn == 0 or " internationals" in sampler.number
        sampler.learn(units)
        assert units <= sampler.number.keys() and list(sampler.number.values()) == sorted(sampler.number.values())
        assert sampler.first[sampler.n_nodes] == sampler.n_edges and sampler.start[sampler.n_edges] == sampler.n_tokens
    assert 0 < len(forgotten) <= 4  # once all new units were kept: 9


def test_paths_do_not_hang_on_the_nodes_valued_first(monkeypatch):
    sampler = gumbel_pieces.Sampler(gumbel_pieces.vocabulary())
    texts = ["international information", "", "a", "the " * 2000, "z" * 700, "ab " * 400 + "extraordinarily"]
    units = [gumbel_pieces.units_of(t, sampler.vocab) for t in texts]
    sampler.learn(set().union(*units))
    numbers, keys = [np.array([sampler.number[u] for u in x], np.int64) for x in units], np.arange(len(texts), dtype=np.uint64)

    def found(span):
        monkeypatch.setattr(gumbel_pieces, "SPAN", span)
        return [[(() if c is None else tuple(c.tolist()), x, y) for c, x, y in rows] for rows in sampler.sample_all(numbers, keys, 6)]

    assert found(1) == found(32) == found(10_000)


def test_trie_steps_are_those_of_the_pieces():
    vocab = gumbel_pieces.vocabulary()
    steps = vocab.steps[vocab.steps >= 0]
    pairs = dict(zip(steps.tolist(), vocab.follow(steps).tolist()))
    for piece in list(vocab.ids)[::50]:
        state = 0
        for c in piece:
            state = pairs[state << 21 | ord(c)]
        assert vocab.ends[state] == vocab.ids[piece]
    assert sorted(pairs.values()) == list(range(1, len(vocab.ends))) and (vocab.follow(np.setdiff1d(np.arange(200_000), steps)) == -1).all()


def test_distinct_units_do_not_hang_on_hashes(monkeypatch):
    vocab, texts = gumbel_pieces.vocabulary(), ["the cat \u4e2dthe", None, "", "a cat😀\n", "the", "\u4e2d"]
    want = [u for t in texts for u in gumbel_pieces.units_of(t, vocab)]
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(gumbel_pieces, "mixed", lambda x: x * np.uint64(0))
        whole, cuts, many = gumbel_pieces.spans_of(texts, vocab)
        units, which = gumbel_pieces.distinct(whole, cuts)
        assert [units[k] for k in which] == want and len(set(units)) == len(units)
        assert many.tolist() == [len(gumbel_pieces.units_of(t, vocab)) for t in texts]


def test_pieces_decode_to_the_text(spark):
    texts = [(1, "Hello  world\n a é😀"), (2, ""), (3, None), (4, "▁a ▁ b<0x0A>"), (5, "x"), (None, "   "), (6, "word " * 9000), (6, "word " * 9000)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts], "doc_id bigint, text string, segmentations string")
    encoded = gumbel_pieces.encode(docs, k=3)
    rows = encoded.collect()
    assert all(r.round_trip and len({tuple(s) for s in r.segmentations}) == len(r.segmentations) for r in rows)
    assert all(0 <= x <= 1 for r in rows for x in r.inclusion)
    back = Counter((r.doc_id, t) for r in gumbel_pieces.decode(encoded).collect() for t in set(r.texts))
    assert back == Counter((k, t or "") for k, t in texts)
    six = [r for r in rows if r.doc_id == 6]
    assert six[0] == six[1]
    assert gumbel_pieces.encode(docs.limit(0)).collect() == []


def test_round_trip_reads_the_ids(spark, monkeypatch):
    right = gumbel_pieces.vocabulary()
    wrong = dataclasses.replace(right, spelled=[b"?"] * len(right.spelled))
    monkeypatch.setattr(gumbel_pieces, "vocabulary", lambda model=None: wrong)
    got = gumbel_pieces.encode(docs_of(spark, [(1, "information"), (2, "")])).collect()
    assert {r.doc_id: r.round_trip for r in got} == {1: False, 2: True}


def test_mix_meets_its_targets(spark):
    texts = [(k, "w " * (1 + k * 37 % 90)) for k in range(400)] + [(400, None), (401, "")]
    rows = pareto_mix.mixed(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    total = sum(r.size for r in rows)
    of = {}
    for r in rows:
        assert r.taken <= 2 * r.size and r.size == len((dict(texts)[r.doc_id] or "").split())
        s = of.setdefault(r.source, [r.source_size, r.target, 0, 0])
        s[2] += r.size
        s[3] += r.taken
    assert sum(s[1] for s in of.values()) == pytest.approx(1.5 * total)
    for source_size, target, size, taken in of.values():
        assert size == source_size and target <= 2 * source_size + 1e-6 and abs(taken - target) <= 90
    assert pareto_mix.mixed(docs_of(spark, [])).collect() == []


def test_ledger_counts_by_hand(spark):
    words = [f"w{k}" for k in range(30)]
    texts = [(1, " ".join(words)), (2, None), (3, ""), (4, " ".join(words[:10] * 4)), (5, "a\nb\na\n \n#*")]
    got = {r.doc_id: r for r in rule_ledger.apply_policy(rule_ledger.ledger(docs_of(spark, texts)), "v2").collect()}
    for k, text in texts:
        found = WORD.findall(text or "")
        grams = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
        covered = {i + j for i in range(len(found) - 7) if grams[tuple(found[i : i + 8])] > 1 for j in range(8)}
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words) == (len(found), sum(map(len, found)), len(covered))
    assert got[5].n_dup_lines == 1 and got[5].n_symbols == 2
    assert got[1].kept and not any(got[k].kept for k in (2, 3, 4, 5))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    text = lambda x: sorted(tuple(map(str, r)) for r in x)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert text(rows.select(columns).collect()) == text(want)


def test_ablation_counts_by_hand(spark):
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words), " ".join(words[:10]), "a a b", None, " ".join(words[:9] * 5), "# * $ " * 30, "x\n" * 40, " ".join(w.upper() + "!" for w in words)]
    rows = rule_ledger.ledger(docs_of(spark, list(enumerate(texts)) * 2))
    failed = [r.failed for r in rows.collect()]
    whole = rule_ledger.mask("v2")
    got = {r["rule"]: (r.n_rejected, r.n_only, r.n_kept_without) for r in rule_ledger.ablation(rows, "v2").collect()}
    assert set(got) == {r.name for k, r in enumerate(rule_ledger.RULES) if whole >> k & 1}
    for k, rule in enumerate(rule_ledger.RULES):
        if whole >> k & 1:
            rest = whole & ~(1 << k)
            assert got[rule.name] == (
                sum(f >> k & 1 for f in failed), sum(bool(f >> k & 1) and not f & rest for f in failed), sum(not f & rest for f in failed))


def test_workers_give_memory_back_when_their_batches_end(monkeypatch):
    from siteskill.llm import texts

    called = []
    monkeypatch.setattr(texts, "give_back", lambda: called.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c"] * 9)], names=["text"])
    cut = texts.pieces([batch, batch.slice(0, 0), batch], "text", 8)
    assert sum(b.num_rows for b in cut) == 54 and called == [1]
