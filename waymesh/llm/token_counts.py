"""Token counts of a BPE piece model by rank-synchronous array merging.

Pre-tokens (a run of spaces and what follows it) are held as ragged numpy
arrays of symbol ids. In every round each sequence applies its lowest-rank
adjacent pair wherever it stands, from left to right, all sequences at once;
what survives is counted. Where a piece is part of one of lower rank than its
own, which could come between, a pair that makes it waits for the one before it
if that is within the longest piece's reach, so the result is that of one merge
after another. Pieces never span two pre-tokens, so the sum over a text's
pre-tokens is the count of the text. A bounded cache keeps the counts of
pre-tokens already seen by a worker.

Null and empty texts have 0 tokens; rows are never dropped, repeated rows each
get their own count, and only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_SHIFT = 20
_NONE = np.iinfo(np.int64).max
#: Pre-tokens longer than this aren't remembered.
LONG = 400


class PieceMerger:
    """The merge table of a sentencepiece BPE model, as sorted arrays."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        normal = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
        ids = {p: i for i, p in enumerate(normal)}
        for p in normal:
            for c in p:
                ids.setdefault(c, len(ids))
        self.char_id = {c: i for c, i in ids.items() if len(c) == 1}
        self.known = np.zeros(len(ids) + 1, bool)
        self.known[: len(normal)] = True
        self.n_bytes = np.zeros(len(ids) + 1, np.int64)
        for c, i in self.char_id.items():
            self.n_bytes[i] = len(c.encode("utf-8", "surrogatepass"))
        levels = {s: r for r, s in enumerate(sorted(set(normal.values()), reverse=True))}
        keys, ranks, made = [], [], []
        touching = set()
        for p, score in normal.items():
            for k in range(1, len(p)):
                touching.add((ids[p[k - 1]] << _SHIFT) | ids[p[k]])
                left, right = ids.get(p[:k]), ids.get(p[k:])
                if left is not None and right is not None:
                    keys.append((left << _SHIFT) | right)
                    ranks.append(levels[score])
                    made.append(ids[p])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int64)[order]
        self.made = np.array(made, np.int64)[order]
        self.touching = np.array(sorted(touching), np.int64)
        # pieces that no better piece is made of: all pairs that make one can be applied at once
        own = np.full(len(ids) + 1, -1, np.int64)
        for p, score in normal.items():
            own[ids[p]] = levels[score]
        left, right = self.keys >> _SHIFT, self.keys & ((1 << _SHIFT) - 1)
        self.reach = max(map(len, normal), default=1)
        self.calm = np.ones(len(ids) + 1, bool)
        self.calm[left[own[left] > self.ranks]] = False
        self.calm[right[own[right] > self.ranks]] = False
        self.byte_fallback = proto.trainer_spec.byte_fallback
        codes = np.full(0x110000, len(ids), np.int32)  # one id for characters that no piece has
        for c, i in self.char_id.items():
            codes[ord(c)] = i
        self.codes = codes
        self.other = len(ids)

    def _find(self, table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return at, table[at] == key

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, hit = self._find(self.keys, (left << _SHIFT) | right)
        return np.where(hit, self.ranks[at], _NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token (its spaces given as SPACE)."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        lens = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.codes[points].astype(np.int64)
        word = np.repeat(np.arange(len(words)), lens)
        # characters outside every piece fall back to their bytes and never merge
        odd = ~self.known[sym]
        if not len(sym):
            return out
        # cut where no piece has these two characters side by side: no merge crosses
        cut = np.ones(len(sym), bool)
        cut[1:] = (word[1:] != word[:-1]) | ~self._find(self.touching, (sym[:-1] << _SHIFT) | sym[1:])[1]
        seq = np.cumsum(cut) - 1
        size = np.bincount(seq)
        heads = np.flatnonzero(cut)
        alone = size[seq] == 1
        if self.byte_fallback:
            wide = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
            each = np.where(odd, wide, 1)
        else:
            each = np.ones(len(sym), np.int64)
        out += np.bincount(word[alone], weights=each[alone], minlength=len(words)).astype(np.int64)
        mine = ~alone
        self._rounds(sym[mine], word[mine], seq[mine], out)
        return out

    def _rounds(self, sym: np.ndarray, word: np.ndarray, seq: np.ndarray, out: np.ndarray) -> None:
        if not len(sym):
            return
        inner = np.empty(len(sym), bool)  # has a right neighbour in its sequence
        inner[:-1], inner[-1] = seq[1:] == seq[:-1], False
        rank = np.full(len(sym), _NONE)
        at = np.flatnonzero(inner)
        rank[at] = self._rank(sym[at], sym[at + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, first)
            n = np.diff(np.r_[first, len(sym)])
            done = low == _NONE
            if done.any():
                gone = np.repeat(done, n)
                odd = gone & ~self.known[sym]
                np.add.at(out, word[gone & ~odd], 1)
                np.add.at(out, word[odd], self.n_bytes[sym[odd]] if self.byte_fallback else 1)
                keep = ~gone
                sym, word, seq, rank = sym[keep], word[keep], seq[keep], rank[keep]
                n, low = n[~done], low[~done]
                if not len(sym):
                    return
            hit = np.flatnonzero(rank == np.repeat(low, n))
            at, _ = self._find(self.keys, (sym[hit] << _SHIFT) | sym[hit + 1])
            # of a run of overlapping pairs every second one, from its start
            nth = np.arange(len(hit))
            ok = (nth - np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) != 1], nth, 0))) % 2 == 0
            first = np.r_[True, (seq[hit[1:]] != seq[hit[:-1]]) | (np.diff(hit) > self.reach)]
            ok &= first | self.calm[self.made[at]]
            hit, at = hit[ok], at[ok]
            sym[hit] = self.made[at]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, seq, rank = sym[keep], word[keep], seq[keep], rank[keep]
            hit = place[hit]
            rank[hit] = _NONE
            right = hit[hit + 1 < len(sym)]
            right = right[seq[right + 1] == seq[right]]
            rank[right] = self._rank(sym[right], sym[right + 1])
            left = hit[hit > 0]
            left = left[seq[left - 1] == seq[left]]
            rank[left - 1] = self._rank(sym[left - 1], sym[left])

def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with what follows, after the model's leading space.

    Spaces are left out of the common case of one space; a longer run starts
    its pre-token with that many SPACE characters.
    """
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        if p:
            out.append(SPACE * run + SPACE + p if run else p)
            run = 0
        else:
            run += 1
    if run:
        out.append(SPACE * run)
    return out


_MERGERS: dict[str, tuple[PieceMerger, dict[str, int]]] = {}


def count_batch(texts: list[str | None], model_file: str, cache_size: int = 400_000) -> np.ndarray:
    """Tokens of each text; unseen pre-tokens of the batch are merged together."""
    if model_file not in _MERGERS:
        _MERGERS[model_file] = (PieceMerger(model_file), {})
    merger, cache = _MERGERS[model_file]
    out = np.zeros(len(texts), np.int64)
    for lo in range(0, len(texts), 500):
        split = [pre_tokens(t or "") for t in texts[lo : lo + 500]]
        new = list({w for ws in split for w in ws if w not in cache})
        if len(cache) + len(new) > cache_size:
            cache.clear()
            new = list({w for ws in split for w in ws})
        cache.update(zip(new, merger.counts([w if w[0] == SPACE else SPACE + w for w in new]).tolist(), strict=True))
        out[lo : lo + 500] = [sum(map(cache.__getitem__, ws)) for ws in split]
        for w in new:
            if len(w) > LONG:
                del cache[w]
    return out


def token_count(text: Column, model_file: str) -> Column:
    """Column of token counts, without begin or end tokens."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(count_batch(s.tolist(), model_file))

    return count(text)


def with_token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, model_file).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
