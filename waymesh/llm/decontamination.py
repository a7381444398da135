"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are lower-cased with single spaces. Benchmark items are cut into windows
of `window` characters that overlap by half (a shorter item is one window).
Two strings of w characters within k edits share at least w - q + 1 - k * q
q-grams whose diagonals lie within k of each other; so the shared q-grams of a
document and a window are counted in overlapping bands of diagonals, bands
that meet the bound are kept, and each is verified by a banded alignment of
the window against the region. A budget of k edits is allowed for `window`
characters and proportionally fewer for a shorter window.

The benchmark's q-gram index is broadcast in blocks of at most `block_chars`
characters; a larger benchmark takes several passes. An item of fewer than q
characters has no q-gram and never matches; null and empty texts match nothing.
Every row is judged by its own text: repeated rows match alike, rows without a
doc_id too. Work is taken by characters, so a batch of long texts is no larger
than one of short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.labelled import by_size
from waymesh.session import materialise

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def normalise(text: str | None) -> str:
    """Lower case, white space as single spaces, none at the ends."""
    return " ".join((text or "").lower().split())


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram of a character array, by doubling."""
    x = codes.astype(np.uint64) + np.uint64(1)
    have, size, out = x, 1, None
    power, done = np.uint64(1_000_003), 0
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    for bit in range(q.bit_length()):
        if q >> bit & 1:
            part = have[done : done + n]
            out = part if out is None else out * power + part
            done += size
        if bit < q.bit_length() - 1:
            have = have[:-size] * power + have[size:]
            size *= 2
            power = np.uint64(int(power) ** 2 % (1 << 64))
    return out


@dataclass
class GramIndex:
    """Windows of benchmark items and the places of their q-grams."""

    q: int
    items: np.ndarray
    offsets: np.ndarray
    windows: list[np.ndarray]
    budgets: np.ndarray
    needed: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    where: np.ndarray
    filter: np.ndarray

    @staticmethod
    def build(items: list[tuple[int, str]], window: int, edits: int, q: int) -> GramIndex:
        ids, offs, wins = [], [], []
        for i, text in items:
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(c) < q:
                continue
            starts = sorted({*range(0, max(len(c) - window, 0) + 1, window // 2), max(len(c) - window, 0)})
            for s in starts:
                ids.append(i)
                offs.append(s)
                wins.append(c[s : s + window])
        lens = np.array([len(w) for w in wins], np.int64)
        budgets = edits * lens // window
        budgets = np.maximum(np.minimum(budgets, (lens - q) // q), 0)
        gh = [gram_hashes(w, q) for w in wins]
        flat = np.concatenate(gh) if gh else np.zeros(0, np.uint64)
        place = np.concatenate([(np.int64(k) << 16) | np.arange(len(g), dtype=np.int64) for k, g in enumerate(gh)]) if gh else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        flat, place = flat[order], place[order]
        hashes, first = np.unique(flat, return_index=True)
        bits = np.zeros(1 << _BITS, bool)
        bits[(hashes * _MULT) >> np.uint64(64 - _BITS)] = True
        return GramIndex(q, np.array(ids, np.int64), np.array(offs, np.int64), wins, budgets, lens - q + 1 - budgets * q, hashes, np.r_[first, len(flat)], place, bits)

    def regions(self, codes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, lowest diagonal, highest) of the bands that meet the bound.

        codes: the texts of several documents end to end; doc: whose each character is.
        """
        if len(codes) < self.q or not len(self.hashes):
            return []
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.filter[(h * _MULT) >> np.uint64(64 - _BITS)])
        at = at[doc[at] == doc[at + self.q - 1]]
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[at]
        at, k = at[hit], k[hit]
        n = self.first[k + 1] - self.first[k]
        pos = np.repeat(at, n)
        place = self.where[np.repeat(self.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(n) else np.zeros(0, np.int64)
        win, off = place >> 16, place & 0xFFFF
        if not len(pos):
            return []
        # bands of 2 * b diagonals that overlap by b, b over the largest budget
        b = int(self.budgets.max()) + 1
        band = (pos - off + 0x10000) // b
        key = np.r_[band, band - 1].astype(np.int64) * len(self.windows) + np.r_[win, win]
        # a q-gram that recurs in one band counts once per place of the window
        pair = np.unique(np.stack([key, np.r_[off, off]]), axis=1)
        keys, count = np.unique(pair[0], return_counts=True)
        good = count >= self.needed[keys % len(self.windows)]
        low = keys[good] // len(self.windows) * b - 0x10000
        return [(int(w), int(x), int(x) + 2 * b - 1) for w, x in zip(keys[good] % len(self.windows), low, strict=True)]

    def verify(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, win: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best alignment (edits, start, end) of each region's window within its band, all regions at once.

        Costs are kept for the diagonals lo - k to hi + k only; a region's
        ends are free, within its document [begin, end). Edits over a window's
        budget are alignments that fail.
        """
        k = int(self.budgets.max())
        lens = np.array([len(self.windows[w]) for w in win], np.int64)
        pad = np.zeros((len(win), int(lens.max())), np.uint32)
        for r, w in enumerate(win.tolist()):
            pad[r, : lens[r]] = self.windows[w]
        width = int((hi - lo).max()) + 1 + 2 * k
        step = np.arange(width)
        d = (lo - k)[:, None] + step
        begin, end, big = begin[:, None], end[:, None], 1 << 20
        cost = np.where((d >= begin) & (d <= end), 0, big)  # before the window's first character
        start = d.copy()
        far = np.full((len(win), 1), big)
        for i in range(pad.shape[1]):
            j = d + i  # the text's character on this diagonal
            ok = (j >= begin) & (j < end)
            same = codes[np.clip(j, 0, len(codes) - 1)] == pad[:, i, None]
            diag = np.where(ok, cost + ~same, big)
            skip = np.concatenate([cost[:, 1:], far], 1) + 1  # the window's character is not in the text
            take = skip < diag
            new = np.where(take, skip, diag)
            src = np.where(take, np.concatenate([start[:, 1:], far], 1), start)
            # characters of the text that are not in the window: a running minimum along the row
            run = np.minimum.accumulate((new - step) * 4096 + step, axis=1)
            via = (run >> 12) + step
            best = via < new
            src = np.where(best, np.take_along_axis(src, run & 4095, 1), src)
            live = (i < lens)[:, None]
            cost, start = np.where(live, np.minimum(via, new), cost), np.where(live, src, start)
        stop = d + lens[:, None]
        cost = np.where((stop >= begin) & (stop <= end), cost, big)
        i = cost.argmin(1)
        r = np.arange(len(win))
        return cost[r, i], start[r, i], stop[r, i]


def _matches(index: GramIndex, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """(item, edits, start, end in the normalised text) of each text's verified windows."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    clean = [normalise(t) for t in texts]
    lens = np.array([len(t) for t in clean], np.int64)
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), lens)
    begin = np.cumsum(lens) - lens
    # a band may reach over the end of a text: each text that it touches is tried
    tries = []
    for win, lo, hi in index.regions(codes, doc):
        first, last = doc[min(max(lo, 0), len(doc) - 1)], doc[min(max(hi + len(index.windows[win]) - 1, 0), len(doc) - 1)]
        tries += [(d, win, lo, hi) for d in range(int(first), int(last) + 1) if lens[d]]
    for at in range(0, len(tries), 512):
        d, win, lo, hi = np.array(tries[at : at + 512], np.int64).T
        edits, start, stop = index.verify(codes, begin[d], begin[d] + lens[d], win, lo, hi)
        for r in np.flatnonzero(edits <= index.budgets[win]).tolist():
            out[d[r]].append((int(index.items[win[r]]), int(edits[r]), int(start[r] - begin[d[r]]), int(stop[r] - begin[d[r]])))
    return [sorted(set(m)) for m in out]


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    """The benchmark's items in blocks of about `block_chars` characters."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // block_chars))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]


def _index(block: DataFrame, window: int, edits: int, q: int):
    """One block's index, broadcast: its size is bounded by the block's."""
    return block.sparkSession.sparkContext.broadcast(GramIndex.build(sorted((r["item_id"], normalise(r["text"])) for r in block.collect()), window, edits, q))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 80, edits: int = 5, q: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, windows, edits, start, end) per row of docs and item with a verified window.

    start and end: the extent of the matches in the normalised text; edits: the
    fewest of one window. An item is in one block of the index, so a row's
    matches with it come together. Blocks are built, used and released one after
    another, each one's matches written, so memory doesn't grow with their number.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    blocks = _blocks(benchmark, block_chars)
    for block in blocks:
        index = _index(block, window, edits, q)

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids, texts, found = pdf["doc_id"].tolist(), pdf["text"].tolist(), []
                for part in by_size(texts, rows=400):
                    for d, ms in zip(ids[part], _matches(index.value, texts[part]), strict=True):
                        items: dict[int, list[tuple[int, int, int]]] = {}
                        for i, *m in ms:
                            items.setdefault(i, []).append(tuple(m))
                        found += [(d, i, len(v), min(x[0] for x in v), min(x[1] for x in v), max(x[2] for x in v)) for i, v in items.items()]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "windows", "edits", "start", "end"])

        # an id travels as text: pandas would make floats of integers next to a null
        part = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, item_id long, windows long, edits int, start int, end int")
        if len(blocks) > 1:
            part = materialise(part, "leaks")
            index.destroy()
        out = part if out is None else out.union(part)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 80, edits: int = 5, q: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs whose text holds no passage of the benchmark, whether they have a doc_id or not."""
    blocks = _blocks(benchmark, block_chars)
    if len(blocks) == 1:
        return docs.where(_clean("text", _index(blocks[0], window, edits, q)))
    # rows by a number of their own, and each block's leaking numbers written before the next block is built
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = materialise(docs.select(whole.alias("row")).withColumn("number", F.monotonically_increasing_id()), "numbered")
    bad = None
    for block in blocks:
        index = _index(block, window, edits, q)
        part = materialise(rows.where(~_clean("row.text", index)).select("number"), "leaks")
        index.destroy()
        bad = part if bad is None else bad.union(part)
    return rows.join(bad, "number", "left_anti").select("row.*")


def _clean(text: str, index) -> Column:
    """Whether a text holds no passage of a block of the index."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            yield pd.Series([not m for part in by_size(texts, rows=400) for m in _matches(index.value, texts[part])], dtype=bool)

    return run(text)
