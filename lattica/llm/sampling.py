"""Op 7: sampled segmentations without replacement, by perturbed A-star search over the lattice.

A text's lattice has a place after each character and an edge for each vocabulary piece between two
places, weighted by `theta` times the piece's score; characters that no piece covers become bytes.
Backward sums of weights (the exact heuristic) turn weights into probabilities of edges.

A node of the search is a set of paths with a common start, and its value the maximum of their
Gumbel-perturbed log-probabilities. The root's value is Gumbel; the child on the maximal path keeps
its parent's value, and the others' maximum is a truncated Gumbel with the mass that is left. So the
search always expands the node with the largest value: it draws a path from it by edge probabilities
and queues what leaves the path at some place. Such a node stands for a range of places: when its turn
comes, a place is drawn by mass and keeps the value as the node "here, but by another edge", and the
ranges before and after it are queued with truncated Gumbels of their own. The first k paths are k
distinct segmentations without replacement; the next value on the queue is the threshold kappa, from
which the inclusion score of each is 1 - exp(-exp(log p - kappa)).

Spaces become the piece set's mark. Where two characters stand side by side in no piece, no edge crosses,
so a text's lattice is a chain of lattices of words: stretches between such places, as a mark with its
letters, or a comma. A worker keeps those for later batches until they have `KEPT` nodes;
then those stay that a batch after their own asked for, as long as they have half of that. A word's
numbers don't depend on what is kept beside it. All walks of a batch are drawn together.

Every random number is a hash of the row's key, `seed`, and its place in the search.

Decoding turns ids back into text: pieces in a row, bytes of byte pieces, marks as spaces, without the
space that normalising puts in front.

Defined cases: a null or empty text has one segmentation, without pieces; a text with fewer
segmentations than k gives them all, with inclusion 1; equal keys draw equally, and equal rows get equal
samples; at equal values the node queued first goes first; a null key is a key of its own; a very long
text is a batch of its own, read whole; other columns pass through inside `__doc`, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import compress
from math import exp, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, once_a_worker, slices

MARK = "▁"
K, THETA = 3, 0.002
#: Texts that are walked together: so many, and so many characters unless one text has more.
BATCH, CHARACTERS = 64, 250_000
#: Nodes of kept lattices (about 80 bytes each with their edges) beyond which a worker drops words.
KEPT = 500_000

#: Log of a share beyond which the share that is left is summed from the other edges.
NEARLY = -1e-4
#: Kinds of characters that are told apart where texts are split.
KINDS = 2047

#: What draws and places add to a state, and the shifts and factors that mix it (fixed values of a public generator).
DRAW, PLACE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
ALL_BITS, LARGEST = (1 << 64) - 1, 1 - 2.0**-53


def uniforms(states: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit states: the same wherever and in whatever batch they are made."""
    x = states
    for shift, factor in MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    u = x.astype(float)
    u += 0.5
    u /= 2.0**53
    return np.minimum(u, LARGEST, out=u)


def uniform(state: int) -> float:
    """uniforms() for one state."""
    x = state & ALL_BITS
    for shift, factor in MIX:
        x = (x ^ x >> shift) * factor & ALL_BITS
    x ^= x >> 31
    return min(((x >> 11) + 0.5) / 2.0**53, LARGEST)


def draw_of(sample: int, tag: int, step: int = 0) -> int:
    return sample << 56 | tag << 48 | step


class Pieces:
    """Vocabulary of a sentencepiece model as a trie in flat arrays."""

    def __init__(self, path: str | None = None, theta: float = THETA, scores: dict[str, float] | None = None):
        self.model = None
        if path:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.model = model
            self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
            usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
            # Pieces of marks alone carry no rank in such models: they count as the rarest, like single characters.
            low = min((model.get_score(i) for i in usual if model.get_score(i) > -1e8), default=0.0)
            self.ids = {model.id_to_piece(i): (i, theta * max(model.get_score(i), low)) for i in usual}
        else:
            low = min(scores.values(), default=0.0)
            self.bytes = {b: len(scores) + b for b in range(256)}
            self.ids = {p: (i, theta * s) for i, (p, s) in enumerate(scores.items())}
        self.unknown = theta * low
        self.ascii = np.array([self.bytes[b] for b in range(128)], np.int64)
        # Which characters stand side by side in a piece, by kinds of characters: 0 for those in no such pair. Kinds that
        # many characters share only make stretches longer.
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        codes = np.array(sorted({ord(c) for x in pairs for c in x}), np.int64)
        self.kind, self.kinds = np.zeros(0x110000, np.int32), min(len(codes), KINDS) + 1
        self.kind[codes] = 1 + np.arange(len(codes)) % KINDS
        self.beside = np.zeros(self.kinds**2, bool)
        for a, b in pairs:
            self.beside[self.kind[ord(a)] * self.kinds + self.kind[ord(b)]] = True
        nodes: dict[tuple[int, str], int] = {}
        piece, weight = [-1], [0.0]
        for p, (i, w) in self.ids.items():
            at = 0
            for c in p:
                at = nodes.setdefault((at, c), len(piece))
                if at == len(piece):
                    piece.append(-1)
                    weight.append(0.0)
            piece[at], weight[at] = i, w
        keys = np.array([n << 21 | ord(c) for n, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(nodes.values()), np.int64)[order]
        # Steps by ASCII characters from a table with a row for each node that has any; row 0 is empty.
        near = self.keys[(self.keys & (1 << 21) - 1) < 128]
        inner = np.unique(near >> 21)
        self.row = np.zeros(len(piece), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.near = np.full((len(inner) + 1) << 7, -1, np.int32)
        self.near[self.row[near >> 21].astype(np.int64) << 7 | near & 127] = self.child[(self.keys & (1 << 21) - 1) < 128]
        self.piece, self.weight = np.array(piece, np.int64), np.array(weight)
        self.first = np.full(0x110000, -1, np.int32)
        for (n, c), to in nodes.items():
            if n == 0:
                self.first[ord(c)] = to

    def normal(self, text: str) -> str:
        return self.model.normalize(text) if self.model else text.replace(" ", MARK)

    def split(self, text: str) -> list[str]:
        """Stretches that no piece crosses."""
        if not text:
            return []
        kind = self.kind.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
        cut = (~self.beside.take(kind[:-1] * self.kinds + kind[1:])).nonzero()[0] + 1
        cut = cut.tolist()
        return [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)]

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie's next nodes, -1 where there is none."""
        out = self.near.take(self.row.take(node).astype(np.int64) << 7 | code & 127).astype(np.int64)
        far = (code > 127).nonzero()[0]
        if len(far):
            key = node[far] << 21 | code[far]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[far] = np.where(self.keys[at] == key, self.child[at], -1)
        return out


class Lattice:
    """Lattices of words side by side: a node for each character, its edges in a row; edges that end a word lead to -1.

    By edge: piece; turn, of shares summed up to an edge and the node it leads to; logs, of its share and of its node's other
    edges. Pairs are complex, as one look into memory finds both. again, at a word's first node, tells whether a batch after
    its own asked for it."""

    KINDS = {"first": np.int64, "count": np.int32, "again": bool, "piece": np.int32, "turn": complex, "logs": complex}

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        for name, kind in self.KINDS.items():
            setattr(self, name, np.zeros(0, kind))
        self.clear()

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.nodes = self.edges = 0

    def thin(self, most: int) -> None:
        """Drops the words that no batch after their own has asked for; all, if the others have more than so many nodes."""
        words, start = list(self.root), np.fromiter(self.root.values(), np.int64, len(self.root))
        stay = self.again.take(start)
        nodes = np.repeat(stay, np.diff(start, append=self.nodes)).nonzero()[0]
        if not 0 < len(nodes) <= most:
            self.clear()
            return
        count = self.count[: self.nodes]
        place = np.full(self.nodes + 1, -1)  # the last for edges that end a word
        place[nodes] = np.arange(len(nodes))
        held = np.repeat(place[:-1] >= 0, count).nonzero()[0]
        for name in ("piece", "turn", "logs"):
            own = getattr(self, name)
            own[: len(held)] = own.take(held)
        self.turn.imag[: len(held)] = place.take(self.turn.imag[: len(held)].astype(np.int64), mode="wrap")
        self.count[: len(nodes)] = count = count.take(nodes)
        self.first[: len(nodes)] = np.cumsum(count) - count
        self.again[: len(nodes)] = False
        self.root = dict(zip(compress(words, stay.tolist()), place.take(start[stay]).tolist(), strict=True))
        self.nodes, self.edges = len(nodes), len(held)

    def room(self, name: str, at: int, size: int) -> np.ndarray:
        """So many places from `at` on of an array, which grows by doubling."""
        own = getattr(self, name)
        if at + size > len(own):
            wider = np.empty(max(2 * len(own), at + size), own.dtype)
            wider[:at] = own[:at]
            setattr(self, name, wider)
            own = wider
        return own[at : at + size]

    def learn(self, words: set[str]) -> None:
        """Adds the lattices of words it doesn't have."""
        new = list(words.difference(self.root))
        if not new:
            return
        pieces = self.pieces
        length = np.fromiter(map(len, new), np.int64, len(new))
        ends = np.cumsum(length)
        self.root.update(zip(new, (self.nodes + ends - length).tolist(), strict=True))
        code = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n = len(code)
        left = np.repeat(ends, length) - np.arange(n)  # characters to the end of the word
        at, node = np.arange(n), pieces.first.take(code).astype(np.int64)
        lone = (node < 0) | (pieces.piece.take(node, mode="wrap") < 0)  # no piece of this character alone: bytes
        alone = lone.nonzero()[0]
        # Of each size the nodes that have such an edge, in order, with its piece and weight.
        found = [(alone, 1, -1 - code.take(alone), np.full(len(alone), pieces.unknown))]
        on = (node >= 0).nonzero()[0]
        at, node, depth = at.take(on), node.take(on), 1
        while len(at):
            own = pieces.piece.take(node)
            hit = (own >= 0).nonzero()[0]
            found.append((at.take(hit), depth, own.take(hit), pieces.weight.take(node.take(hit))))
            on = (left.take(at) > depth).nonzero()[0]
            at = at.take(on)
            node = pieces.step(node.take(on), code.take(at + depth))
            on = (node >= 0).nonzero()[0]
            at, node = at.take(on), node.take(on)
            depth += 1
        count = np.zeros(n, np.int64)
        for src, *_ in found:
            count[src] += 1
        first = np.cumsum(count) - count
        m, free = int(count.sum()), first.copy()
        size, piece, weight = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m)
        for src, depth, own, w in found:
            place = free.take(src)
            size[place], piece[place], weight[place] = depth, own, w
            free[src] = place + 1
        # Backward sums, all words together: nodes in the order of their distance from the end.
        follow = np.repeat(np.arange(n), count)
        follow += size
        follow[size == np.repeat(left, count)] = n
        turn = np.argsort(left.astype(np.uint16) if left.max() < 65_536 else left, kind="stable")
        each = count.take(turn)
        heads = np.cumsum(each) - each
        order = np.repeat(first.take(turn) - heads, each) + np.arange(m)
        upto = np.cumsum(np.bincount(left))
        cuts = np.append(heads, m).take(upto).tolist()
        back = np.zeros(n + 1)
        value, to, upto = weight.take(order), follow.take(order), upto.tolist()
        for a, b, p, q in zip(cuts[:-1], cuts[1:], upto[:-1], upto[1:], strict=True):
            own = value[a:b]
            own += back.take(to[a:b])
            back[turn[p:q]] = np.logaddexp.reduceat(own, heads[p:q] - a)
        logp = np.empty(m)
        logp[order] = np.minimum(value - np.repeat(back.take(turn), each), 0.0)
        share = np.exp(logp)
        # Shares are summed within a node, so that they don't depend on the words beside it.
        edge, rank = first[count > 1], 1
        many = count[count > 1]
        while len(edge):
            share[edge + rank] += share[edge + rank - 1]
            on = many > rank + 1
            edge, many, rank = edge[on], many[on], rank + 1
        share[first + count - 1] = np.inf
        with np.errstate(divide="ignore"):
            rest = np.log(-np.expm1(logp))
        # Where an edge has nearly all, one minus its share says too little: the others are summed.
        large = (logp > NEARLY).nonzero()[0]
        of = np.searchsorted(first, large, side="right") - 1
        large, of = large[count[of] > 1], of[count[of] > 1]
        if len(large):
            each = count.take(of)
            heads = np.cumsum(each) - each
            other = logp.take(np.repeat(first.take(of) - heads, each) + np.arange(int(each.sum())))
            other[heads + large - first.take(of)] = -np.inf
            rest[large] = np.logaddexp.reduceat(other, heads)
        turn, logs = self.room("turn", self.edges, m), self.room("logs", self.edges, m)
        turn.real, turn.imag = share, np.where(follow == n, -1, follow + self.nodes)
        logs.real, logs.imag = logp, rest
        self.room("piece", self.edges, m)[:] = piece
        self.room("first", self.nodes, n)[:] = first + self.edges
        self.room("count", self.nodes, n)[:] = count
        self.room("again", self.nodes, n)[:] = False
        self.nodes, self.edges = self.nodes + n, self.edges + m

    def walk(self, roots: np.ndarray, seeds: np.ndarray, sample: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a path drawn through each word, in order, and the number of each word's edges."""
        state = seeds + np.uint64(draw_of(sample, 1) * DRAW & ALL_BITS) + word.astype(np.uint64) * np.uint64(PLACE)
        passes, at, mine = [], roots, np.arange(len(roots))
        while len(at):
            u = uniforms(state)
            edge = self.first.take(at)
            turn = self.turn.take(edge)
            # Edges of a node are few; each pass moves those whose share isn't reached yet.
            more = (u >= turn.real).nonzero()[0]
            to, u = edge.take(more), u.take(more)
            while len(more):
                to += 1
                edge[more] = to
                turn[more] = now = self.turn.take(to)
                on = (u >= now.real).nonzero()[0]
                more, to, u = more.take(on), to.take(on), u.take(on)
            passes.append((edge, mine))
            at = turn.imag.astype(np.int64)
            on = (at >= 0).nonzero()[0]
            at, mine, state = at.take(on), mine.take(on), state.take(on)
            state += np.uint64(DRAW)
        size = np.zeros(len(roots), np.int64)
        for i, (_, mine) in enumerate(passes):
            size[mine] = i + 1
        place = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        for i, (edge, mine) in enumerate(passes):
            out[place.take(mine) + i] = edge
        return out, size

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        got = self.piece.take(edges).astype(np.int64)
        bare = (got < 0).nonzero()[0]
        if not len(bare):
            return got.astype(np.uint32)
        code = -1 - got[bare]
        if code.max() < 128:
            got[bare] = self.pieces.ascii[code]
            return got.astype(np.uint32)
        out, last = [], 0
        for i, c in zip(bare.tolist(), code.tolist(), strict=True):
            out += [got[last:i], [self.pieces.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")]]
            last = i + 1
        return np.concatenate([*out, got[last:]]).astype(np.uint32)


def lower_maximum(mass: float, top: float, u: float) -> float:
    """A Gumbel with log mass `mass`, given that it is below `top`."""
    return mass - log(exp(min(mass - top, 700.0)) - log(u))


def total(masses: np.ndarray) -> float:
    """Log of the sum of masses given as logs."""
    top = masses.max(initial=-np.inf)
    return float(top + np.log(np.exp(masses - top).sum())) if top > -np.inf else -np.inf


class Search:
    """The search over one text's lattice.

    The queue has nodes (-value, turn, path, start, stop, taken): paths that leave a found path at one of the places from
    start to before stop; with `taken`, at start, by none of those edges."""

    def __init__(self, lattice: Lattice, roots: np.ndarray, k: int, seed: int):
        self.lattice, self.roots, self.k = lattice, roots, k
        self.seed = seed
        self.queue, self.found, self.turn = [], [], 0
        self.prefix = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        self.turned: list[tuple[int, int]] = []
        self.value = -log(-log(self.draw(0, 0)))

    def draw(self, sample: int, tag: int) -> float:
        return uniform(self.seed + draw_of(sample, tag) * DRAW)

    def push(self, mass: float, top: float, tag: int, *node) -> None:
        if mass > -np.inf:
            heapq.heappush(self.queue, (-lower_maximum(mass, top, self.draw(len(self.found), tag)), self.turn, *node))
            self.turn += 1

    def branch(self) -> tuple[np.ndarray, np.ndarray]:
        """Takes the best node of the queue; where the rest of its path has to be drawn: nodes and their words."""
        sample, lat = len(self.found), self.lattice
        value, _, which, at, stop, taken = heapq.heappop(self.queue)
        path, _, _, word, mass, reached = self.found[which]
        if not taken:
            start = at
            top = float(mass[start:stop].max())
            share = np.exp(mass[start:stop] - top)
            upto = np.cumsum(share)
            at += min(int(np.searchsorted(upto, upto[-1] * self.draw(sample, 4), side="right")), stop - start - 1)
            while mass[at] == -np.inf:
                at -= 1
            before = float(upto[at - start - 1]) if at > start else 0.0
            self.push(top + log(before) if before else -np.inf, -value, 5, which, start, at, frozenset())
            after = float(share[at + 1 - start :].sum())
            self.push(top + log(after) if after > 1e-290 else total(mass[at + 1 : stop]), -value, 6, which, at + 1, stop, frozenset())
            taken = frozenset([int(path[at])])
        new_word = at == 0 or word[at] != word[at - 1]
        node = int(self.roots[word[at]] if new_word else lat.turn.imag[path[at - 1]])
        first = int(lat.first[node])
        left = [e for e in range(first, first + int(lat.count[node])) if e not in taken]
        logp = lat.logs[left].real.tolist()
        top = max(logp)
        share = [exp(x - top) for x in logp]
        edge, left_of = 0, self.draw(sample, 2) * sum(share)
        while edge < len(left) - 1 and left_of >= share[edge]:
            left_of -= share[edge]
            edge += 1
        if len(left) > 1 and (other := sum(share[:edge]) + sum(share[edge + 1 :])):
            self.push(float(mass[at] - lat.logs.imag[path[at]]) + top + log(other), -value, 3, which, at, at + 1, taken | {left[edge]})
        edge = left[edge]
        own, on = int(word[at]), int(lat.turn.imag[edge])
        self.prefix, self.turned = (path[:at], word[:at], mass[:at], reached[:at]), [(edge, own)]
        self.value = -value
        starts, words = self.roots[own + 1 :], np.arange(own + 1, len(self.roots))
        return (np.concatenate([[on], starts]), np.concatenate([[own], words])) if on >= 0 else (starts, words)

    def expand(self, edges: np.ndarray, words: np.ndarray) -> None:
        """Takes the path of the prefix, the edge where it turned off and these edges, and queues what leaves it on these."""
        lat, n = self.lattice, len(self.prefix[0]) + len(self.turned)
        path, word, mass, reached = self.prefix
        for edge, own in self.turned:
            edges, words = np.concatenate([[edge], edges]), np.concatenate([[own], words])
        # Sums go on from the prefix's last.
        before = reached[-1:]
        logs = lat.logs.take(edges)
        upto = np.cumsum(np.concatenate([before, logs.real]))
        rest = logs.imag.copy()
        if len(before):
            rest += upto[:-1]
            upto = upto[1:]
        else:
            rest[1:] += upto[:-1]
        if len(path):
            edges, words, rest, upto = np.concatenate([path, edges]), np.concatenate([word, words]), np.concatenate([mass, rest]), np.concatenate([reached, upto])
        self.found.append((edges, float(upto[-1]) if len(upto) else 0.0, self.value, words, rest, upto))
        self.push(total(rest[n:]), self.value, 7, len(self.found) - 1, n, len(edges), frozenset())

    def result(self) -> list[tuple[np.ndarray, float, float, float]]:
        kappa = -self.queue[0][0] if self.queue else -np.inf
        return [(self.lattice.ids_of(e), lp, g, float(-np.expm1(-np.exp(min(700.0, lp - kappa))))) for e, lp, g, *_ in self.found]


def sample_many(lattice: Lattice, texts: list[str], k: int, seeds: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations: (ids, log p, perturbed log p, inclusion), by falling value."""
    pieces = lattice.pieces
    if lattice.nodes > KEPT:
        lattice.thin(KEPT // 2)
    split = [pieces.split(pieces.normal(t)) if t else [] for t in texts]
    known = lattice.nodes
    lattice.learn(set().union(*split))
    root = lattice.root.__getitem__
    searches = [Search(lattice, np.fromiter(map(root, words), np.int64, len(words)), k, seed) for words, seed in zip(split, seeds, strict=True)]
    for sample in range(k):
        jobs = [(s, *((s.roots, np.arange(len(s.roots))) if not sample else s.branch())) for s in searches if not sample or s.queue]
        if not jobs:
            break
        sizes = [len(starts) for _, starts, _ in jobs]
        words = np.concatenate([w for _, _, w in jobs]).astype(np.int64)
        of = np.repeat(np.array([s.seed for s, _, _ in jobs], np.uint64), sizes)
        starts = np.concatenate([x for _, x, _ in jobs]).astype(np.int64)
        if not sample:
            lattice.again[starts[starts < known]] = True
        edges, steps = lattice.walk(starts, of, sample, words)
        bounds = np.concatenate([[0], np.cumsum(steps)])[np.cumsum([0, *sizes])].tolist()
        word = np.repeat(words, steps)
        for (s, _, _), a, b in zip(jobs, bounds[:-1], bounds[1:], strict=True):
            s.expand(edges[a:b], word[a:b])
    return [s.result() for s in searches]


SAMPLES = "array<struct<ids:binary,log_p:double,value:double,inclusion:double>>"


def sample_batches(path: str, k: int, theta: float, seed: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        lattice = once_a_worker(f"lattice {path} {theta}", lambda: Lattice(Pieces(path, theta)))
        kind = pa.list_(pa.struct([("ids", pa.binary()), ("log_p", pa.float64()), ("value", pa.float64()), ("inclusion", pa.float64())]))
        for batch in slices(batches, BATCH, ("lattice ", "decoder ")):
            texts = [t.decode() for t in as_bytes(batch.column("__text"))]
            seeds = [xxhash.xxh64_intdigest(key, seed) for key in as_bytes(batch.column("__key"))]
            start = 0
            while start < len(texts):
                stop, held = start + 1, len(texts[start])
                while stop < len(texts) and held + len(texts[stop]) <= CHARACTERS:
                    held += len(texts[stop])
                    stop += 1
                own = sample_many(lattice, texts[start:stop], k, seeds[start:stop])
                got = [[{"ids": i.astype("<u4").tobytes(), "log_p": lp, "value": g, "inclusion": q} for i, lp, g, q in one] for one in own]
                yield pa.RecordBatch.from_arrays([batch.column("__doc").slice(start, stop - start), pa.array(got, kind)], names=["__doc", "__samples"])
                start = stop

    return run


def sampled(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", k: int = K, theta: float = THETA, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """docs (of its columns those in `keep`; all, if there is none) as a struct `__doc`, and `__samples`: ids (little-endian 32-bit), log p, perturbed value and inclusion score. No shuffle."""
    key = F.when(F.col(doc_id).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(doc_id).cast("string")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("__doc"), key.alias("__key"), F.col(text).alias("__text"))
    return packed.mapInArrow(sample_batches(model, k, theta, seed), T.StructType([packed.schema["__doc"], T.StructField("__samples", T._parse_datatype_string(SAMPLES))]))


class Decoder:
    """Ids to text by a table of bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model, table = sentencepiece.SentencePieceProcessor(model_file=path), []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                table.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_unknown(i):
                table.append(" \u2047 ".encode())
            else:
                table.append(b"" if model.is_control(i) else piece.replace(MARK, " ").encode())
        import pyarrow as pa

        self.table = pa.array(table, pa.large_binary())

    def texts(self, coded: list[bytes]) -> list[str]:
        """The texts of little-endian 32-bit ids, all at once."""
        import pyarrow as pa

        ids = np.frombuffer(b"".join(coded), "<u4")
        if len(ids) and ids.max() >= len(self.table):
            raise ValueError(f"no piece has the id {ids.max()}")
        _, ends, whole = self.table.take(pa.array(ids, pa.uint32())).buffers()
        ends = np.frombuffer(ends, np.int64)
        cuts = ends[np.cumsum([0, *(len(x) // 4 for x in coded)])].tolist() if len(ids) else [0] * (len(coded) + 1)
        whole = whole.to_pybytes() if whole else b""
        return [whole[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode_batches(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decoder = once_a_worker(f"decoder {path}", lambda: Decoder(path))
        for batch in slices(batches, BATCH, ("lattice ", "decoder ")):
            texts = decoder.texts([x or b"" for x in batch.column("ids").to_pylist()])
            names = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return run


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """rows with their column `ids` turned back into `text`; other columns pass through. Null ids are an empty text, bytes
    that are no UTF-8 become U+FFFD, ids beyond the model raise, and so does a column that is called text already."""
    if "text" in (c.lower() for c in rows.columns):
        raise ValueError("a column is called text already")
    rest = [f for f in rows.schema.fields if f.name != "ids"]
    return rows.mapInArrow(decode_batches(model), T.StructType([*rest, T.StructField("text", T.StringType())]))


def op7_gumbel_top_k(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = sampled(docs, model, keep=["doc_id"]).select("__doc.doc_id", F.posexplode("__samples").alias("rank", "s"))
    got = got.select("doc_id", "rank", (F.octet_length("s.ids") / 4).cast("long").alias("pieces"), F.crc32("s.ids").alias("ids_crc32"), F.round("s.log_p", 6).alias("log_p"), F.round("s.value", 6).alias("value"), F.col("s.inclusion").alias("inclusion"), F.col("s.ids").alias("ids"))
    return decoded(got, model).withColumn("decoded_crc32", F.crc32(F.col("text").cast("binary"))).drop("text")
