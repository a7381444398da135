"""Sampled sentencepiece segmentations without replacement, encoded and decoded.

Every way to cut a text into pieces of a model is a path in its lattice. A BPE
model lists pieces by rank only, so a piece of rank r weighs (r + 2) ** -alpha,
as word frequencies do; a character that no piece spells goes to its bytes.
Paths are sampled in proportion to their weight, k different ones per text, by
a perturbed best-first (A-star) search with Gumbel noise: the search keeps
open nodes with the largest perturbed value below them, follows the largest to
a full path, and opens the siblings that it passes with noise truncated at
their parent's value. Pieces never span two words (a run of spaces and what
follows), so a node is a prefix of words and its siblings are all other ways
to spell its last word, whose total weight is known from a forward pass.

The first k values and the one after give inclusion scores: log of the chance
that a path of its weight is above that threshold. All noise comes from a
counter-based hash of the row's key, so a row has the same samples anywhere.

The chance of what is left of a word is summed over its other spellings where
1 - p would lose it, and a spelling among the others is drawn from the lattice
without those taken, so no spelling is too unlikely to be found.

A null or empty text has one segmentation, of no pieces. A text with fewer
than k segmentations has as many samples, all with inclusion score 0.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.token_counts import SPACE, pre_tokens

_G = np.uint64(0x9E3779B97F4A7C15)
#: 64 steps of the counter: each word's noise has its own.
_STRIDE = np.uint64((64 * 0x9E3779B97F4A7C15) % (1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) by (seed, counter)."""
    return ((_mix(seed + counter.astype(np.uint64) * _G) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class PieceLattice:
    """Lattices of words over the pieces of a model, and a memory of them: `most` arcs and those of one batch."""

    def __init__(self, model_file: str, alpha: float = 1.0, most: int = 2_500_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces = [p.piece for p in proto.pieces]
        normal = sorted((-p.score, i) for i, p in enumerate(proto.pieces) if p.type in (1, 4))
        self.cost = np.zeros(len(self.pieces) + 1)
        for r, (_, i) in enumerate(normal):
            self.cost[i] = -alpha * math.log(r + 2)
        self.ids = {self.pieces[i]: i for _, i in normal}
        byte = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte = [byte[f"<0x{b:02X}>"] for b in range(256)] if byte else None
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b in range(256) if byte else ():
            self.raw[self.byte[b]] = bytes([b])
        self.rare = -alpha * math.log(len(normal) + 2)
        self._trie()
        self.most = most
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.at: dict[str, int] = {}  # last node << 32 | length, by word without the one space before it
        self.small: dict[tuple, float] = {}  # chance of a word's spellings but some, where it is small
        self.n_nodes = self.n_edges = 0
        # first arc of each node, arc lengths, pieces, cumulative chances, log chances; filled so far as counted
        self.tables = [np.zeros(1 << 12, t) for t in (np.int64, np.int16, np.int32, np.float64, np.float64)]

    def _trie(self) -> None:
        """The pieces as a trie: sorted (node, character) keys, what they lead to, and the piece that ends at each node."""
        edges: dict[tuple[int, int], int] = {}
        ends = [-1]
        for p, i in self.ids.items():
            node = 0
            for c in p:
                k = (node, ord(c))
                if k not in edges:
                    edges[k] = len(ends)
                    ends.append(-1)
                node = edges[k]
            ends[node] = i
        self.ends = np.array(ends, np.int64)
        # an open-addressed table of (node, character) -> next node, at most a quarter full
        bits = max(10, (4 * len(edges)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        todo_key = np.array([n << 21 | c for n, c in edges], np.int64)
        todo_next, at = np.array(list(edges.values()), np.int64), self._slot(np.array([n << 21 | c for n, c in edges], np.int64))
        while len(todo_key):
            free = self.slot_key[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = np.zeros(len(at), bool)
            put[first] = True
            put &= free
            self.slot_key[at[put]], self.slot_next[at[put]] = todo_key[put], todo_next[put]
            todo_key, todo_next, at = todo_key[~put], todo_next[~put], (at[~put] + 1) & (len(self.slot_key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _G) >> self.shift).astype(np.int64)

    def _follow(self, key: np.ndarray) -> np.ndarray:
        """The node that each (node, character) key leads to, -1 for none."""
        at = self._slot(key)
        have = self.slot_key[at]
        out = np.where(have == key, self.slot_next[at], -1)
        on = np.flatnonzero((have != key) & (have != -1))
        while len(on):
            at[on] = (at[on] + 1) & (len(self.slot_key) - 1)
            have = self.slot_key[at[on]]
            hit = have == key[on]
            out[on[hit]] = self.slot_next[at[on[hit]]]
            on = on[~hit & (have != -1)]
        return out

    def _arcs(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece, cost) of every piece at every character; left: characters to the word's end."""
        start, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found, depth, single = [], 0, np.zeros(len(codes), bool)
        while len(start):
            node = self._follow(node << 21 | codes[start + depth])
            hit = node >= 0
            start, node = start[hit], node[hit]
            depth += 1
            piece = self.ends[node]
            is_piece = piece >= 0
            found.append((start[is_piece], np.full(int(is_piece.sum()), depth), piece[is_piece], self.cost[piece[is_piece]]))
            if depth == 1:
                single[start[is_piece]] = True
            more = left[start] > depth
            start, node = start[more], node[more]
        odd = np.flatnonzero(~single)
        c = codes[odd]
        wide = np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
        found.append((odd, np.ones(len(odd), np.int64), -1 - c, self.rare * wide))
        # long pieces first: a word's likeliest last piece mostly is its longest
        return tuple(np.concatenate(x) for x in zip(*reversed(found), strict=True))

    def learn(self, names: list[str]) -> None:
        """Add the lattices of words not seen yet: for each end position its arcs with cumulative chances.

        A word's nodes are its positions 0..n; arcs into a node are drawn going
        backwards in proportion to the weight of all paths through them.
        """
        if not names:
            return
        words = [w if w[0] == SPACE else SPACE + w for w in names]
        n = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), n)
        pos = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
        start, k, piece, cost = self._arcs(codes, n[word] - pos)
        source = start + word[start]  # each word has one node more than characters
        target, at = source + k, pos[start] + k
        order = np.argsort(target, kind="stable")
        source, target, k, piece, cost, at = (x[order] for x in (source, target, k, piece, cost, at))
        # by position, so that what leads to a node is known before it
        turn = np.argsort(at.astype(np.int16), kind="stable") if n.max() < 1 << 15 else np.argsort(at, kind="stable")
        total = np.zeros(len(codes) + len(words))
        value = np.empty(len(source))
        bounds = np.flatnonzero(np.r_[True, np.diff(at[turn]) != 0, True])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            i = turn[lo:hi]
            v, t = total[source[i]] + cost[i], target[i]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            top = np.maximum.reduceat(v, first)
            size = np.diff(np.r_[first, hi - lo])
            total[t[first]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size)), first))
            value[i] = v
        value -= total[target]
        chance = np.exp(value)
        count = np.bincount(target, minlength=len(total))
        first = np.cumsum(count) - count
        run = np.cumsum(chance)
        cum = run - (run - chance)[np.minimum(first, len(run) - 1)][target]
        cum[(first + count - 1)[count > 0]] = 2.0
        ends = self.n_nodes + np.cumsum(n + 1) - 1
        self.at.update(zip(names, (ends << 32 | n).tolist(), strict=True))
        for i, x in enumerate((first + self.n_edges, k, piece, cum, value)):
            lo, have = self.n_edges if i else self.n_nodes, self.tables[i]
            if lo + len(x) > len(have):
                self.tables[i] = np.zeros(max(lo + len(x), len(have) * 3 // 2), have.dtype)
                self.tables[i][:lo] = have[:lo]
            self.tables[i][lo : lo + len(x)] = x
        self.n_nodes, self.n_edges = self.n_nodes + len(total), self.n_edges + len(cum)

    def draw(self, node: np.ndarray, length: np.ndarray, seed: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A spelling of each word, drawn by weight: how many pieces of each, all pieces in order, and each word's log chance.

        node: the words' last nodes; salt: counters of their noise.
        """
        first, back, piece, cum, share = self.tables
        live, left, at = np.arange(len(node)), length, node
        state = seed + salt * _STRIDE
        logp = np.zeros(len(node))
        n = np.zeros(len(node), np.int64)
        who, what = [], []
        while len(live):
            u = (_mix(state) >> np.uint64(11)).astype(np.float64) * (1 / (1 << 53))
            arc = first[at]
            go = np.flatnonzero(u > cum[arc])
            while len(go):
                arc[go] += 1
                go = go[u[go] > cum[arc[go]]]
            logp[live] += share[arc]
            n[live] += 1
            who.append(live)
            what.append(piece[arc])
            k = back[arc]
            left, at = left - k, at - k
            more = np.flatnonzero(left > 0)
            live, left, at, state = live[more], left[more], at[more], state[more] + _G
        out, end = np.empty(int(n.sum()), np.int32), np.cumsum(n) - 1
        for step, (w, x) in enumerate(zip(who, what, strict=True)):  # a word's pieces came from its end
            out[end[w] - step] = x
        return n, out, logp

    def _ways(self, node: int, left: int) -> list[tuple[int, int, float]]:
        """(piece, characters, chance) of the arcs into a node that is `left` characters into its word."""
        first, back, piece, cum, share = self.tables
        lo, out = int(first[node]), []
        while left:
            out.append((int(piece[lo]), int(back[lo]), math.exp(share[lo])))
            if cum[lo] == 2.0:
                break
            lo += 1
        return out

    def _left(self, node: int, left: int, taken: list[tuple[int, ...]], seen: dict) -> float:
        """Chance of the spellings up to a node other than those taken, all terms positive."""
        if not taken:
            return 1.0
        if not left:
            return 0.0  # what is taken is the whole of it
        key = (node, tuple(taken))
        if key not in seen:
            seen[key] = sum(p * self._left(node - k, left - k, [t[:-1] for t in taken if t[-1] == piece], seen) for piece, k, p in self._ways(node, left))
        return seen[key]

    def remaining(self, word: str, taken: list[tuple[int, ...]]) -> float:
        """Chance of all spellings of a word but those taken, without the loss of 1 - p."""
        at = self.at[word]
        return self._left(at >> 32, at & 0xFFFFFFFF, taken, {})

    def other(self, word: str, taken: list[tuple[int, ...]], seed: int, salt: int) -> tuple[np.ndarray, float]:
        """A spelling of a word, drawn by weight among those not taken, and its log chance."""
        node, left = self.at[word] >> 32, self.at[word] & 0xFFFFFFFF
        got, logp, seen, step = [], 0.0, {}, 0
        while left:
            ways = [(piece, k, p, [t[:-1] for t in taken if t[-1] == piece]) for piece, k, p in self._ways(node, left)]
            weight = [p * self._left(node - k, left - k, t, seen) for _, k, p, t in ways]
            u = float(_uniform(np.array([seed], np.uint64), np.array([salt + step], np.uint64))[0]) * sum(weight)
            i = next(i for i, c in enumerate(accumulate(weight)) if u <= c or i == len(weight) - 1)
            while not weight[i]:  # rounding at the end
                i -= 1
            piece, k, p, taken = ways[i]
            got.append(piece)
            logp += math.log(p)
            node, left, step = node - k, left - k, step + 1
        return np.array(got[::-1], np.int32), logp

    def bytes_of(self, what: np.ndarray) -> np.ndarray:
        """Piece ids, characters without a piece as those of their bytes (or as unknown)."""
        if not len(what) or what.min() >= 0:
            return what
        odd = np.flatnonzero(what < 0)
        spelt = [[self.byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] if self.byte else [self.unknown] for i in what[odd].tolist()]
        n = np.ones(len(what), np.int64)
        n[odd] = list(map(len, spelt))
        out = np.repeat(what, n)
        out[np.repeat(what < 0, n)] = [b for x in spelt for b in x]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that pieces spell, without the model's leading space."""
        out = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


#: Where a word's other spellings weigh less than this, their weight is summed up instead of taken as 1 - p.
SMALL = 1e-10
#: Characters of the texts that are sampled side by side; a longer text is alone.
AT_ONCE = 1 << 18
_LATTICES: dict[tuple[str, float, int], PieceLattice] = {}


class _Path:
    """One sampled segmentation: where each word's pieces end, pieces, and log chance of each word's spelling."""

    def __init__(self, end: np.ndarray, what: np.ndarray, logp: np.ndarray):
        self.end, self.what, self.logp = end, what, logp

    def before(self, i: int) -> int:
        """Pieces before word i."""
        return int(self.end[i - 1]) if i else 0

    def word(self, i: int) -> tuple[int, ...]:
        return tuple(self.what[self.before(i) : self.end[i]].tolist())


class _Search:
    """The open nodes and samples of one text."""

    def __init__(self, words: list[str], key: int, k: int):
        self.words, self.k = words, k
        self.seed = int(_mix(np.array([key & ((1 << 64) - 1)], np.uint64) + _G)[0])
        self.noise, self.tie = 0, 0
        self.out: list[tuple[_Path, float]] = []
        self.limit = -math.inf
        # (-value, tie, path whose prefix it takes, branching word, its spellings already out, their chance)
        self.heap: list[tuple[float, int, _Path | None, int, list[tuple[int, ...]], float]] = [(math.log(float(self.exponential(1)[0])), 0, None, -1, [], 0.0)]

    def exponential(self, n: int) -> np.ndarray:
        self.noise += 1
        return -np.log(_uniform(np.full(n, self.seed, np.uint64), np.uint64((1 << 62) + (self.noise << 36)) + np.arange(n, dtype=np.uint64)))

    def grown(self, lat: PieceLattice, value: float, path: _Path, word: int, taken: list[tuple[int, ...]], taken_p: float) -> None:
        """Keep a sample and open the siblings it passed: at its branching word and at every word after."""
        self.out.append((path, float(path.logp.sum())))
        start = max(word, 0)
        tail = np.minimum(path.logp[start:], 0.0)
        rest = -np.expm1(tail)
        if word >= 0:
            rest[0] = 1.0 - taken_p - math.exp(tail[0])
        for i in np.flatnonzero(rest < SMALL).tolist():
            known = (self.words[start + i], path.word(start + i), *(taken if word >= 0 and not i else ()))
            if known not in lat.small:
                lat.small[known] = lat.remaining(known[0], list(known[1:]))
            rest[i] = lat.small[known]
        before = path.logp[:start].sum() + np.cumsum(tail) - tail
        open_ = np.flatnonzero(rest > 0.0)
        if not len(open_):
            return
        place = before[open_] + np.log(rest[open_])
        x = place - np.log(self.exponential(len(open_)) + np.exp(np.minimum(place - value, 700)))
        best = np.argpartition(-x, self.k)[: self.k + 1] if len(x) > self.k + 1 else np.arange(len(x))
        for i in best[np.lexsort((best, -x[best]))].tolist():  # more can't be among the first k
            at = start + int(open_[i])
            first = word >= 0 and at == word
            self.tie += 1
            gone = [*taken, path.word(at)] if first else [path.word(at)]
            heapq.heappush(self.heap, (-float(x[i]), self.tie, path, at, gone, (taken_p if first else 0.0) + math.exp(min(path.logp[at], 0.0))))


def sample_batch(lat: PieceLattice, texts: list[str | None], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text up to k different (ids, log chance, log inclusion chance), by falling perturbed value.

    The searches run side by side, so that one draw serves a step of all of them.
    """
    split = [pre_tokens(t or "") for t in texts]
    if lat.n_edges > lat.most:
        lat.clear()
    lat.learn(list(set(chain.from_iterable(split)).difference(lat.at)))
    every = [_Search(ws, key, k) if ws else None for ws, key in zip(split, keys, strict=True)]
    live = [s for s in every if s]
    for s in live:
        s.at = np.fromiter(map(lat.at.__getitem__, s.words), np.int64, len(s.words))
    for r in range(k + 1):
        popped = [(s, heapq.heappop(s.heap)) for s in live if s.heap]
        if r == k:
            for s, node in popped:
                s.limit = -node[0]
            break
        if not popped:
            break
        begin = [max(n[3], 0) for _, n in popped]
        sizes = np.array([len(s.words) - b for (s, _), b in zip(popped, begin, strict=True)], np.int64)
        base = np.cumsum(sizes) - sizes
        at = np.concatenate([s.at[b:] for (s, _), b in zip(popped, begin, strict=True)])
        at, length = at >> 32, at & 0xFFFFFFFF
        seed = np.repeat(np.array([s.seed for s, _ in popped], np.uint64), sizes)
        salt = np.arange(len(at), dtype=np.uint64) - np.repeat(base, sizes).astype(np.uint64) + np.uint64((r + 1) << 40)
        n, what, logp = lat.draw(at, length, seed, salt)
        end = np.cumsum(n)
        lo = 0
        for (s, (value, _, parent, word, taken, taken_p)), start, size in zip(popped, base.tolist(), sizes.tolist(), strict=True):
            hi = int(end[start + size - 1])
            e, x, p = end[start : start + size] - lo, what[lo:hi], logp[start : start + size]
            lo = hi
            if word >= 0:
                head = int(e[0])
                if tuple(x[:head].tolist()) in taken:
                    got, q = lat.other(s.words[word], taken, s.seed, (1 << 52) + (r << 40))
                    e, x, p = e + (len(got) - head), np.concatenate([got, x[head:]]), np.concatenate([[q], p[1:]])
                cut = parent.before(word)
                e, x, p = np.concatenate([parent.end[:word], e + cut]), np.concatenate([parent.what[:cut], x]), np.concatenate([parent.logp[:word], p])
            s.grown(lat, -value, _Path(e, x, p), word, taken, taken_p)
    done = []
    for s in every:
        if s is None:
            done.append([(np.zeros(0, np.int32), 0.0, 0.0)])
            continue
        row = []
        for path, total in s.out:
            over = total - s.limit  # log(1 - exp(-exp(over))), without loss at either end
            row.append((lat.bytes_of(path.what), total, 0.0 if over > 6 else over if over < -30 else math.log(-math.expm1(-math.exp(over)))))
        done.append(row)
    return done


def sampled_pieces(docs: DataFrame, model_file: str, k: int = 2, alpha: float = 1.0, arcs: int = 2_500_000) -> DataFrame:
    """(doc_id, sample, n_pieces, log_prob, log_inclusion, ids_crc32, round_trip, ids) per text and sample.

    arcs: how many lattice arcs of words each Python worker remembers, at about
    40 bytes each; fewer mean learning words again more often, with the same
    results. round_trip: whether decoding the pieces gives the text back (a SPACE
    character in a text counts as the space that it means).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (model_file, alpha, arcs) not in _LATTICES:
            _LATTICES[model_file, alpha, arcs] = PieceLattice(model_file, alpha, arcs)
        lat = _LATTICES[model_file, alpha, arcs]
        for b in batches:
            whole, lo = [t or "" for t in b["text"]], 0
            run_of = np.cumsum([len(t) for t in whole])
            while lo < len(b):
                # so many texts at once, fewer if they are long
                hi = min(lo + 256, max(lo + 1, int(np.searchsorted(run_of, (run_of[lo - 1] if lo else 0) + AT_ONCE))))
                part, texts, rows = b.iloc[lo:hi], whole[lo:hi], []
                lo = hi
                for d, t, got in zip(part["doc_id"].tolist(), texts, sample_batch(lat, texts, part["key"].tolist(), k), strict=True):
                    want = t.replace(SPACE, " ").encode("utf-8", "surrogatepass")
                    for i, (x, p, q) in enumerate(got):
                        x = np.ascontiguousarray(x, np.int32)
                        rows.append((d, i, len(x), p, q, zlib.crc32(x), lat.decode(x) == want, x))
                yield pd.DataFrame(rows, columns=["doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "ids_crc32", "round_trip", "ids"])

    # an id travels as text: pandas would make floats of integers next to a null
    keyed = docs.select(F.col("doc_id").cast("string"), "text", F.xxhash64("doc_id").alias("key"))
    got = keyed.mapInPandas(run, "doc_id string, sample int, n_pieces long, log_prob double, log_inclusion double, ids_crc32 long, round_trip boolean, ids array<int>")
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))
