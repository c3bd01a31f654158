"""SentencePiece encoding by Gumbel top-k: distinct segmentations sampled without replacement, and decoding.

A text's lattice has an edge for every piece of the vocabulary; a character without a piece is spelled in its bytes.
A piece of merge rank r weighs 1 / (r + 2), a segmentation the product of its pieces, and its probability is its
share of all segmentations of the text. Where two neighbouring characters occur side by side in no piece, no piece can cross, so
the lattice factors exactly into units between such places: mostly words with the spaces before them, without line
breaks and marks. Backward sums over the lattice of a
unit give every edge its probability given the position it leaves; a path is drawn edge by edge from them. Units of up to
`LISTED` characters are one position whose edges are all their segmentations, which is the same thing in fewer steps.

`encode` draws the `k` segmentations whose log probability plus Gumbel noise is largest, by a perturbed A* search from
the top: a node is a prefix of edges, and its perturbed value is the exact maximum over all segmentations below it, so the
first k leaves taken from the queue are the answer, in order. The children of a node share its maximum: the best one
inherits it, the others draw theirs truncated at it. `inclusion` is 1 - exp(-exp(log_prob - threshold)), threshold
being the (k+1)-th perturbed value: dividing by it makes sums over the samples unbiased.

Noise depends on the row's key alone: its doc_id, or its text where that is null. Reruns and repeated rows agree.

Edge cases: null and empty texts have one segmentation, the empty one; a text with fewer than k segmentations gives them
all, with inclusion 1; very long texts are searched whole; a literal U+2581 is spelled in bytes, so that decoding is
exact for any text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import mixed, pieces, small_batches, uniform

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LISTED = 4
#: Edges from which a worker forgets rare units, and characters of new units whose lattices are built at once.
KNOWN = 1_500_000
CHARS = 200_000
#: -log(u) is at least 2 ** -54 for every u that noise can be, so no value lies above its location by more than this.
REACH = 37.5
#: Counts of batches that asked for a unit, by hash.
SLOTS = 1 << 21
#: Nodes of a path that are valued first; of the others only those whose noise can still win.
SPAN = 32
_NEAR = 1024
SCHEMA = (
    "doc_id bigint, n_chars bigint, segmentations array<array<int>>, log_prob array<double>, perturbed array<double>, "
    "inclusion array<double>, round_trip boolean"
)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with spaces for U+2581, their log weights, the ids of the 256 bytes, and the pieces as a trie.

    A step of the trie is state << 21 | code point (`steps`, by hash, -1 where free) to a state (`states`); `ends` is a state's piece or -1.
    `near` and `far` hold the pairs of characters that occur side by side in a piece. `learnt` keeps what a worker has built:
    the broadcast stays in it from task to task.
    """

    ids: dict[str, int]
    weights: np.ndarray
    spelled: list[bytes]
    byte_ids: list[int]
    steps: np.ndarray
    states: np.ndarray
    ends: np.ndarray
    near: np.ndarray
    far: np.ndarray
    learnt: list = field(default_factory=list)

    @cached_property
    def letters(self) -> pa.Array:
        return pa.array(self.spelled, pa.large_binary())

    def follow(self, step: np.ndarray) -> np.ndarray:
        """The states that steps lead to, -1 where the trie has no such step."""
        last = len(self.steps) - 1
        slot = (mixed(step.astype(np.uint64)) & np.uint64(last)).astype(np.int64)
        there = self.steps[slot]
        state = np.where(there == step, self.states[slot], -1)
        on = np.flatnonzero((there != step) & (there >= 0))
        while len(on):
            slot[on] = slot[on] + 1 & last
            there = self.steps[slot[on]]
            hit = there == step[on]
            state[on[hit]] = self.states[slot[on[hit]]]
            on = on[~hit & (there >= 0)]
        return state

    def sampler(self) -> Sampler:
        if not self.learnt:
            self.learnt.append(Sampler(self))
        return self.learnt[0]


def side_by_side(ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring characters of all pieces: a table for small code points, and sorted numbers for the others."""
    pairs = {(ord(a), ord(b)) for piece in ids for a, b in zip(piece, piece[1:])}
    near = np.zeros((_NEAR, _NEAR), bool)
    for a, b in pairs:
        if max(a, b) < _NEAR:
            near[a, b] = True
    return near, np.array(sorted(a << 21 | b for a, b in pairs if max(a, b) >= _NEAR), np.int64)


def trie(ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found: dict[int, int] = {}
    ends = [-1]
    for piece, i in ids.items():
        state = 0
        for c in piece:
            state = found.setdefault(state << 21 | ord(c), len(ends))
            if state == len(ends):
                ends.append(-1)
        ends[state] = i
    return *hashed(np.array(list(found), np.int64), np.array(list(found.values()), np.int64)), np.array(ends, np.int64)


def hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and their values at the first place that is free from their hash on, a quarter of the places at most."""
    size = 4 << len(keys).bit_length()
    placed, kept = np.full(size, -1), np.zeros(size, np.int64)
    slot = (mixed(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)
    left = np.arange(len(keys))
    while len(left):
        free = left[placed[slot[left]] < 0]
        placed[slot[free]] = keys[free]
        left = left[placed[slot[left]] != keys[left]]
        slot[left] = slot[left] + 1 & size - 1
    kept[slot] = values
    return placed, kept


def vocabulary(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    n = p.get_piece_size()
    names = [p.id_to_piece(i) for i in range(n)]
    special = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) for i in range(n)]
    plain = [i for i in range(n) if not special[i] and not p.is_byte(i)]
    byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    spelled = [b"" if special[i] else names[i].replace("▁", " ").encode() for i in range(n)]
    for b, i in enumerate(byte_ids):
        spelled[i] = bytes([b])
    rank = np.array([max(0.0, -p.get_score(i)) for i in range(n)])
    rank[byte_ids] = n
    ids = {names[i].replace("▁", " "): i for i in plain}
    return Vocabulary(ids, -np.log(rank + 2), spelled, byte_ids, *trie(ids), *side_by_side(ids))


def unit_lattice(unit: str, vocab: Vocabulary) -> list[tuple[float, tuple[int, ...]]]:
    """All segmentations of a unit with their log weights."""
    ids, weights, n = vocab.ids, vocab.weights, len(unit)
    tails: list[list] = [[] for _ in range(n)] + [[(0.0, ())]]
    for a in range(n - 1, -1, -1):
        if unit[a] not in ids:
            spelled = tuple(vocab.byte_ids[b] for b in unit[a].encode())
            w = float(sum(weights[i] for i in spelled))
            tails[a] += [(w + x, spelled + t) for x, t in tails[a + 1]]
        for b in range(a + 1, n + 1):
            i = ids.get(unit[a:b])
            if i is not None:
                w = float(weights[i])
                tails[a] += [(w + x, (i, *t)) for x, t in tails[b]]
    return tails[0]


def word_lattice(units: list[str], vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """Edges of the lattices of all units, by the position they leave and the longest first; positions are numbered through.

    Returns the edges of each position, the position an edge leads to (-1 at the end of its unit), its piece (-1 - b for the b-th
    spelling in bytes), its log weight with all that follows, the log sum of those of each position, and the spellings.
    """
    codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(u) for u in units])
    stop = np.repeat(np.cumsum(sizes), sizes)
    begin = at = np.arange(len(codes))
    state = np.zeros(len(codes), np.int64)
    found = []
    bare = np.ones(len(codes), bool)
    while len(at):
        state = vocab.follow(state << 21 | codes[at])
        hit = np.flatnonzero(state >= 0)
        begin, at, state = begin[hit], at[hit] + 1, state[hit]
        piece = vocab.ends[state]
        ok = piece >= 0
        if not found:
            bare[begin[ok]] = False
        found.append((begin[ok], at[ok], piece[ok]))
        on = at < stop[begin]
        begin, at, state = begin[on], at[on], state[on]
    bare = np.flatnonzero(bare)
    letters, which = np.unique(codes[bare], return_inverse=True)
    bytewise = [[vocab.byte_ids[b] for b in chr(c).encode()] for c in letters]
    heavy = np.array([vocab.weights[x].sum() for x in bytewise])
    found.insert(0, (bare, bare + 1, -1 - which))
    # the edges of a position lie side by side, each round of the trie puts its own (one a position at most) behind longer ones
    many = sum(np.bincount(x[0], minlength=len(codes)) for x in found)
    free = np.cumsum(many) - many
    start = np.repeat(np.arange(len(codes)), many)
    to, piece = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for x in found[::-1]:
        place = free[x[0]]
        to[place], piece[place] = x[1], x[2]
        free[x[0]] += 1
    w = vocab.weights[np.maximum(piece, 0)]
    w[piece < 0] = heavy[-1 - piece[piece < 0]]
    to = np.where(to == stop[start], -1, to)
    # positions as far from the end of their unit are summed together; the last entry stands for the end
    after = np.zeros(len(codes) + 1)
    far = (stop - np.arange(len(codes)))[start]
    far = far.astype(np.uint16) if sizes.max() < 1 << 16 else far  # sorted faster
    order = np.argsort(far, kind="stable")
    cuts = np.searchsorted(far[order], np.arange(1, sizes.max() + 2))
    for a, z in zip(cuts[:-1], cuts[1:]):
        e = order[a:z]
        x = w[e] + after[to[e]]
        w[e] = x
        from_ = start[e]
        new = np.flatnonzero(np.r_[True, from_[1:] != from_[:-1]])
        after[from_[new]] = log_sums(x, new, np.diff(np.r_[new, len(e)]))
    return many, to, piece, w, after[:-1], bytewise


def log_sums(w: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log sums of runs that begin `at`."""
    top = np.maximum.reduceat(w, at)
    return top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, counts)), at))


def slots(units: Iterable[str]) -> np.ndarray:
    return np.array(list(map(hash, units)), np.int64) & (SLOTS - 1)


def within(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each begin up to its end, one after the other, and the range each is of."""
    size = (end - begin).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) + np.repeat(begin - np.cumsum(size) + size, size), owner


class Sampler:
    """The lattices of the units met so far as flat arrays, and the search over them.

    A node is a position of a unit; its edges are `first[node]` to `first[node + 1]`. An edge has its log probability given the
    node, the running sum of those probabilities, its tokens, and the node it leads to (-1 at the end of the unit).
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.uses = np.zeros(SLOTS, np.uint8)
        self.least = 0
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.passing: list[str] = []
        self.n_nodes = self.n_edges = self.n_tokens = 0
        self.cum, self.logp = np.zeros(0), np.zeros(0)
        self.first, self.start = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.next, self.tokens = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values into an array that grows by half at least."""
        array, end = getattr(self, name), at + len(values)
        if end > len(array):
            larger = np.zeros(max(end, len(array) * 3 // 2), getattr(self, name).dtype)
            larger[:at] = array[:at]
            setattr(self, name, larger)
            array = larger
        array[at:end] = values

    def forget(self) -> None:
        """Keep the units asked for in the most batches (two at least), in three quarters of the room, and make room of the others.

        Batches are counted by hash, for forgotten units too; units that share a count only stay longer than they would. From
        now on new units are asked for as often as those that stayed, or they pass with their batch.
        """
        names = list(self.number)  # in the order of their nodes
        begin = np.array(list(self.number.values()), np.int64)
        bounds = np.r_[begin, self.n_nodes]
        often, edges = self.uses[slots(names)], np.diff(self.first[bounds])
        order = np.argsort(often, kind="stable")[::-1]
        kept = np.sort(order[(np.cumsum(edges[order]) <= KNOWN * 3 // 4) & (often[order] > 1)])
        self.least = int(often[kept].min()) if len(kept) else 2
        stays = np.zeros(len(names), bool)
        stays[kept] = True
        nodes = np.diff(bounds)
        edge, token = np.repeat(stays, edges), np.repeat(stays, np.diff(self.start[self.first[bounds]]))
        base = np.cumsum(nodes[kept]) - nodes[kept]
        to = self.next[: self.n_edges][edge]
        to = np.where(to < 0, -1, to + np.repeat((base - begin[kept]).astype(np.int32), edges[kept]))
        counts = np.diff(self.first[: self.n_nodes + 1])[np.repeat(stays, nodes)]
        lengths = np.diff(self.start[: self.n_edges + 1])[edge]
        cum, logp, tokens = self.cum[: self.n_edges][edge], self.logp[: self.n_edges][edge], self.tokens[: self.n_tokens][token]
        number = dict(zip([names[k] for k in kept.tolist()], base.tolist()))
        self.reset()
        self.number = number
        self._append(cum, logp, to, counts, lengths, tokens)

    def learn(self, units: Iterable[str]) -> np.ndarray:
        """Build the lattices of those of the different units that are not known; the first nodes of all. Forgets the units that pass."""
        units = list(units)
        if self.passing:
            end = self.number[self.passing[0]]
            for u in self.passing:
                del self.number[u]
            self.n_nodes, self.n_edges = end, int(self.first[end])
            self.n_tokens, self.passing = int(self.start[self.n_edges]), []
        node = np.array(list(map(self.number.get, units, repeat(-1))), np.int64)
        if self.n_edges > KNOWN and (node < 0).any():
            self.forget()
            node = np.array(list(map(self.number.get, units, repeat(-1))), np.int64)
        asked = slots(units)
        if len(asked) and self.uses[asked].max() == 255:
            self.uses >>= 1
            self.least >>= 1
        self.uses[asked] += 1  # once, however many units share a count
        missing = np.flatnonzero(node < 0)
        new = [units[k] for k in missing.tolist()]
        sizes, stays = np.array(list(map(len, new)), np.int64), self.uses[asked[missing]] >= self.least
        short = list(compress(new, sizes <= LISTED))
        if short:  # these stay until they are forgotten
            ways = [unit_lattice(u, self.vocab) for u in short]
            self.number |= {u: self.n_nodes + k for k, u in enumerate(short)}
            counts, w = np.array([len(x) for x in ways]), np.array([w for x in ways for w, _ in x])
            tokens = [i for x in ways for _, t in x for i in t]
            sums = log_sums(w, np.cumsum(counts) - counts, counts)
            self._add(w, sums, counts, np.full(len(w), -1), np.array([len(t) for x in ways for _, t in x]), np.array(tokens))
        order = np.r_[np.flatnonzero((sizes > LISTED) & stays), np.flatnonzero((sizes > LISTED) & ~stays)]
        long, sizes = [new[k] for k in order.tolist()], sizes[order]
        slot = np.cumsum(sizes) // CHARS
        cuts = np.flatnonzero(np.r_[True, np.diff(slot) != 0]).tolist() if long else []
        for a, z in zip(cuts, [*cuts[1:], len(long)]):
            some, base, own = long[a:z], self.n_nodes, sizes[a:z]
            self.number |= dict(zip(some, (base + np.cumsum(own) - own).tolist()))
            counts, to, piece, w, sums, bytewise = word_lattice(some, self.vocab)
            lengths = np.ones(len(piece), np.int64)
            spelled = np.flatnonzero(piece < 0)
            tokens = piece
            if len(spelled):
                many = np.array([len(x) for x in bytewise])
                lengths[spelled] = many[-1 - piece[spelled]]
                tokens = np.repeat(piece, lengths)
                tokens[np.repeat(piece < 0, lengths)] = [i for k in (-1 - piece[spelled]).tolist() for i in bytewise[k]]
            self._add(w, sums, counts, np.where(to < 0, -1, base + to), lengths, tokens)
        self.passing = long[np.count_nonzero((sizes > 0) & stays[order]) :]
        node[missing] = list(map(self.number.__getitem__, new))
        return node

    def _add(self, w: np.ndarray, sums: np.ndarray, counts: np.ndarray, to: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> None:
        """Nodes with `counts` edges each, whose log weights `w` include all that follows, and their log sums."""
        at = np.cumsum(counts) - counts
        w = np.minimum(w - np.repeat(sums, counts), 0.0)
        w[at[counts == 1]] = 0.0
        run = np.exp(w)
        has, k = at[counts > 1], 1
        left = counts[counts > 1]
        while len(has):
            run[has + k] += run[has + k - 1]
            k += 1
            on = left > k
            has, left = has[on], left[on]
        run[at + counts - 1] = 1.0
        self._append(np.minimum(run, 1.0), w, to, counts, lengths, tokens)

    def _append(self, cum: np.ndarray, logp: np.ndarray, to: np.ndarray, counts: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> None:
        for name, values in (("cum", cum), ("logp", logp), ("next", to)):
            self._put(name, self.n_edges, values)
        self._put("first", self.n_nodes + 1, self.n_edges + np.cumsum(counts))
        self._put("start", self.n_edges + 1, self.n_tokens + np.cumsum(lengths))
        self._put("tokens", self.n_tokens, tokens)
        self.n_nodes, self.n_edges, self.n_tokens = self.n_nodes + len(counts), self.n_edges + len(cum), self.n_tokens + len(tokens)

    def _chosen(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of every node, by its probability; the first ones are the likeliest as a rule."""
        took = self.first[nodes].astype(np.int64)
        on = np.flatnonzero(self.cum[took] < u)
        at, u = took[on] + 1, u[on]
        while len(on):
            less = self.cum[at] < u
            took[on] = at
            on, at, u = on[less], at[less] + 1, u[less]
        return took

    def _paths(self, tails: list[np.ndarray], keys: np.ndarray, turn: int) -> list[np.ndarray]:
        """For each text the edges drawn from its nodes to the ends of their units, in order."""
        sizes = np.array([len(x) for x in tails])
        nodes, key = np.concatenate(tails), np.repeat(keys, sizes)
        place = (np.arange(len(nodes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
        which, steps, drawn = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), []
        while len(which):
            took = self._chosen(nodes, uniform(stream(key[which], turn, 0, len(drawn)), place[which]))
            drawn.append((which, took))
            to = self.next[took]
            on = np.flatnonzero(to >= 0)
            steps[which] = len(drawn)
            nodes, which = to[on], which[on]
        upto = np.r_[0, np.cumsum(steps)]
        edges = np.zeros(upto[-1], np.int64)
        for depth, (which, took) in enumerate(drawn):
            edges[upto[which] + depth] = took
        return np.split(edges, upto[np.cumsum(sizes)][:-1])

    def sample(self, units: np.ndarray, key: np.uint64, k: int) -> list[tuple[np.ndarray, float, float]]:
        """(edges, log probability, perturbed value) of the best k, and the value of the next as a last entry."""
        return self.sample_all([units], np.array([key], np.uint64), k)[0]

    def sample_all(self, texts: list[np.ndarray], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
        """`sample` of every text: all draw their next path together."""
        tops = -np.log(-np.log(uniform(stream(keys, 0, 1), np.zeros(len(keys), np.uint64))))
        searches = [_Search(self, units, key, top) for units, key, top in zip(texts, keys, tops.tolist())]
        turn = 0
        live = searches
        while live:
            paths = self._paths([s.tail for s in live], np.array([s.key for s in live], np.uint64), turn)
            self._complete(live, paths, turn, k)
            turn += 1
            live = [s for s in live if len(s.out) < k and s.queue]
            self._advance(live, turn)
        return [[*s.out, (None, 0.0, -s.queue[0][0] if s.queue else -np.inf)] for s in searches]

    def _complete(self, live: list[_Search], paths: list[np.ndarray], turn: int, k: int) -> None:
        """Take the paths of all searches, and put the k + 1 best nodes beside each into its queue."""
        sizes = np.array([len(x) for x in paths])
        begin = np.cumsum(sizes) - sizes
        logs = self.logp[np.concatenate(paths)]
        upto = [s.log_head + np.cumsum(logs[a : a + n]) for s, a, n in zip(live, begin.tolist(), sizes.tolist())]
        for s, path, x in zip(live, paths, upto):
            s.take(path, x)
        if not len(logs):
            return
        before = np.concatenate(upto) - logs  # falls along a path
        key, top = stream(np.array([s.key for s in live], np.uint64), turn, 2), np.array([s.top for s in live])

        def valued(at: np.ndarray, owner: np.ndarray, u: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore"):
                return below(top[owner], before[at] + np.log(-np.expm1(logs[at])), u)

        def noise(at: np.ndarray, owner: np.ndarray) -> np.ndarray:
            return uniform(key[owner], (at - begin[owner]).astype(np.uint64))

        at, owner = within(begin, begin + np.minimum(sizes, SPAN))
        g = valued(at, owner, noise(at, owner))
        ranked = np.lexsort((-g, owner))
        head = np.minimum(sizes, SPAN)
        first = np.cumsum(head) - head
        bar = np.where(head > k, g[ranked[np.minimum(first + k, len(g) - 1)]], -np.inf)
        # a value is at most its location - log(-log(u)), and -log(u) at least 1 - u
        far, whose = within(begin + head, begin + sizes)
        on = np.flatnonzero(before[far] > bar[whose] - REACH)
        far, whose = far[on], whose[on]
        u = noise(far, whose)
        with np.errstate(over="ignore"):
            on = np.flatnonzero((1 - u) * (1 - 1e-9) <= np.exp(before[far] - bar[whose]))
        far, whose, u = far[on], whose[on], u[on]
        at, owner, g = np.concatenate([at, far]), np.concatenate([owner, whose]), np.concatenate([g, valued(far, whose, u)])
        ranked = np.lexsort((-g, owner))
        many = np.bincount(owner, minlength=len(live))
        ends = np.cumsum(many)
        best, _ = within(ends - many, np.minimum(ends - many + k + 1, ends))
        best = ranked[best]
        best = best[g[best] > -np.inf]
        steps = np.concatenate(paths)[at[best]].tolist()
        for i, j, value, edge, x in zip(owner[best].tolist(), (at - begin[owner])[best].tolist(), g[best].tolist(), steps, before[at[best]].tolist()):
            live[i].put(j, value, edge, x)

    def _advance(self, live: list[_Search], turn: int) -> None:
        """Every search leaves the best node of its queue by an edge not taken before."""
        if not live:
            return
        popped = [heapq.heappop(s.queue) for s in live]
        node = np.searchsorted(self.first[: self.n_nodes + 1], np.array([p[3][p[4]] for p in popped], np.int32), side="right") - 1
        begin, end = self.first[node].astype(np.int64), self.first[node + 1].astype(np.int64)
        ways = [[e for e in range(a, z) if e not in p[5]] for a, z, p in zip(begin.tolist(), end.tolist(), popped)]
        chance = np.exp(self.logp[[e for x in ways for e in x]]).tolist()
        u = uniform(stream(np.array([s.key for s in live], np.uint64), turn, 1)[:, None], np.arange(2, dtype=np.uint64)[None])
        took, rest, at = [], [], 0
        for x, share in zip(ways, u[:, 0].tolist()):
            p = chance[at : at + len(x)]
            upto = list(accumulate(p))
            j = min(bisect_left(upto, share * upto[-1]), len(x) - 1)
            took.append(x[j])
            rest.append(sum(p[:j]) + sum(p[j + 1 :]))
            at += len(x)
        with np.errstate(divide="ignore"):
            loc = np.array([p[6] for p in popped]) + np.log(rest)
        g = below(-np.array([p[0] for p in popped]), loc, u[:, 1])
        for s, p, e, to, log, value in zip(live, popped, took, self.next[took].tolist(), self.logp[took].tolist(), g.tolist()):
            s.leave(p, e, to, log, value)

    def spelled(self, choice: np.ndarray) -> np.ndarray:
        return self.tokens_of(choice)[0]

    def tokens_of(self, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of edges, and how many each has."""
        begin = self.start[choice]
        count = self.start[choice + 1] - begin
        return self.tokens[within(begin, begin + count)[0]], count


def stream(key: np.ndarray, turn: int, use: int, depth: int = 0) -> np.ndarray:
    """A key of its own for every step of a search."""
    number = (turn << 34 | use << 32 | depth) + 1
    return key ^ np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def below(top, loc, u):
    """Gumbel values at `loc`, truncated at `top`."""
    with np.errstate(over="ignore", divide="ignore"):
        return top - np.log1p(np.exp(top - loc) * -np.log(u))


class _Search:
    """The perturbed A* search of one text; `tail` is where the path it waits for begins: the nodes still to be left."""

    def __init__(self, sampler: Sampler, units: np.ndarray, key: np.uint64, top: float) -> None:
        self.sampler, self.units, self.key = sampler, units, key
        self.out: list = []
        self.queue: list = []
        self.head, self.log_head, self.tail = np.zeros(0, np.int64), 0.0, units
        self.top = top

    def take(self, tail: np.ndarray, upto: np.ndarray) -> None:
        """Take the path head + tail."""
        choice = np.concatenate([self.head, tail]) if len(self.head) else tail
        self.out.append((choice, float(upto[-1]) if len(upto) else self.log_head, self.top))

    def put(self, j: int, value: float, edge: int, before: float) -> None:
        """Put the node that the last path leaves by its j-th new edge into the queue."""
        heapq.heappush(self.queue, (-value, len(self.out), j, self.out[-1][0], len(self.head) + j, {edge}, before))

    def leave(self, node: tuple, took: int, to: int, log: float, value: float) -> None:
        """Leave a node of the queue by an edge; `value` is what remains there."""
        top, _, _, choice, at, without, log_head = node
        self.top = -top
        if value > -np.inf:
            heapq.heappush(self.queue, (-value, len(self.out), -1 - len(without), choice, at, without | {took}, log_head))
        self.head, self.log_head = choice[: at + 1].copy(), log_head + log
        self.head[at] = took
        left = self.units[np.count_nonzero(self.sampler.next[choice[:at]] < 0) + 1 :]
        self.tail = np.concatenate([[to], left]) if to >= 0 else left


def seed(doc_id: int | None, text: str | None) -> np.uint64:
    name = f"id {doc_id}" if doc_id is not None else f"text {text or ''}"
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def spans_of(texts: list[str | None], vocab: Vocabulary) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts, each with a space before it, as one; where its units begin and the last one ends, cut where no piece can cross; units of each text."""
    whole = "".join([" " + t for t in texts if t])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
    a, b = codes[:-1], codes[1:]
    joined = vocab.near[np.minimum(a, _NEAR - 1), np.minimum(b, _NEAR - 1)]
    high = np.flatnonzero((a >= _NEAR) | (b >= _NEAR))
    joined[high] = False
    if len(high) and len(vocab.far):
        pair = a[high].astype(np.int64) << 21 | b[high]
        joined[high] = vocab.far[np.minimum(np.searchsorted(vocab.far, pair), len(vocab.far) - 1)] == pair
    joined[ends[(ends > 0) & (ends < len(codes))] - 1] = False
    cuts = np.r_[0, np.flatnonzero(~joined) + 1, len(codes)] if len(codes) else np.zeros(1, np.int64)
    return whole, cuts, np.diff(np.searchsorted(cuts, ends), prepend=0)


def distinct(whole: str, cuts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different units between the cuts, and for every unit the number of its own."""
    if len(cuts) < 2:
        return [], np.zeros(0, np.int64)
    if whole.isascii():
        places = cuts
    else:
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        places = np.r_[0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))][cuts]
    units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(whole.encode())).dictionary_encode()
    return units.dictionary.to_numpy(zero_copy_only=False).tolist(), units.indices.to_numpy()


def units_of(text: str | None, vocab: Vocabulary) -> list[str]:
    """The text, with a space before it, cut where no piece can cross."""
    whole, cuts, _ = spans_of([text], vocab)
    return [whole[x:y] for x, y in zip(cuts.tolist(), cuts[1:].tolist())]


def encode(docs: DataFrame, k: int = 2, model: str = MODEL) -> DataFrame:
    """doc_id, n_chars, segmentations with log_prob, perturbed, inclusion, and round_trip (the ids of all of them spell the text). No shuffle."""
    vocab = vocabulary(model)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # as large as the vocabulary
    small_batches(docs.sparkSession)

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = shared.value.sampler()
        for batch in pieces(batches, "text", 500_000):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            whole, cuts, many = spans_of(texts, shared.value)
            units, which = distinct(whole, cuts)
            numbers = np.split(sampler.learn(units)[which], np.cumsum(many)[:-1])
            searched = sampler.sample_all(numbers, np.array([seed(i, t) for i, t in zip(ids, texts)], np.uint64), k)
            samples = [(text, *sample, after) for text, (*some, (_, _, after)) in zip(texts, searched) for sample in some]
            counts = [len(x) - 1 for x in searched]
            edges = [choice for _, choice, *_ in samples]
            tokens, many = sampler.tokens_of(np.concatenate(edges))
            lengths = np.diff(np.r_[0, np.cumsum(many)][np.cumsum([0, *map(len, edges)])])
            right = spells(tokens, lengths, [" " + t if t else "" for t, *_ in samples], shared.value)
            bad = np.bincount(np.repeat(np.arange(len(texts)), counts), ~np.array(right), minlength=len(texts))
            same = bad == 0
            logs, tops = [x[2] for x in samples], [x[3] for x in samples]
            with np.errstate(over="ignore"):
                shares = -np.expm1(-np.exp(np.array(logs) - np.array([x[4] for x in samples])))
            outer = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(tokens))
            listed = lambda x: pa.ListArray.from_arrays(outer, pa.array(x, pa.float64()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.ListArray.from_arrays(outer, inner), listed(logs), listed(tops), listed(shares),
                pa.array(same, pa.bool_()),
            ], names=["doc_id", "n_chars", "segmentations", "log_prob", "perturbed", "inclusion", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sampled, SCHEMA)


def spell(ids: Iterable[int], vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.spelled.__getitem__, ids))


def spells(ids: np.ndarray, lengths: np.ndarray, texts: list[str], vocab: Vocabulary) -> list[bool]:
    """Whether the ids of each sample, `lengths` of them, spell its text."""
    made = vocab.letters.take(pa.array(ids))
    _, ends, letters = made.buffers()
    letters = letters.to_pybytes() if letters else b""
    cuts = np.frombuffer(ends, np.int64)[np.r_[0, np.cumsum(lengths)]].tolist()
    return [letters[a:z] == text.encode() for a, z, text in zip(cuts, cuts[1:], texts)]


def decoded(ids: Iterable[int], vocab: Vocabulary) -> str:
    return spell(ids, vocab).decode(errors="replace")[1:]


def decode(encoded: DataFrame, column: str = "segmentations", model: str = MODEL) -> DataFrame:
    """doc_id and the texts that its segmentations spell."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model))

    def spelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if s is None else [decoded(ids or [], shared.value) for ids in s] for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.string()))], names=["doc_id", "texts"])

    return encoded.select("doc_id", column).mapInArrow(spelled, "doc_id bigint, texts array<string>")
