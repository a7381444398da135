"""Toxic spans by a linear-chain conditional random field, and scores of documents.

Token labels for training come from document labels: a token is labelled toxic
where a clue it carries (its letters, or a prefix of them) is found in toxic
documents far more often than in others, in a toxic document. The field has
the states "other" and "toxic", clue weights as emissions and a transition
matrix, and is fitted to those labels by gradient ascent on the conditional
likelihood. Forward-backward marginals of a whole text give its toxic spans
with their offsets, and a logistic of the marginals' sum, maximum and share
gives its score.

The fit sees a bounded sample of labelled rows; its chain is fitted on all toxic
texts of it and `balance` times as many others, its document score on all.

A null or empty text has the score of a text without a toxic token. Without
labelled rows, or with one class only, every score is that class's share. Work
is taken by characters, so memory does not grow with a batch of long texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.labelled import by_size, fit_sample, held_out

_TOKEN = re.compile(r"[^\W\d_]+")
#: Tokens of one block of the scan over a text.
_BLOCK = 64
PREFIXES = (3, 4, 5, 6)


def clues(word: str) -> list[str]:
    """What is known of a lower-case word: its letters and prefixes of them."""
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) > k)]


class _Emissions(dict):
    """Emission of each word seen; a bounded memory that starts again when full."""

    def __init__(self, weight: dict[str, float], bias: float, most: int = 300_000):
        self.weight, self.bias, self.most = weight, bias, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        e = self[word] = self.bias + sum(self.weight.get(c, 0.0) for c in clues(word.lower()))
        return e


class ToxicField:
    """Two-state chain with clue weights."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.bias = -4.0  # of the state "toxic" against "other"
        self.turn = np.zeros((2, 2))
        self.doc = np.array([-3.0, 0.0, 0.0, 0.0])
        self.constant: float | None = None
        self._seen: _Emissions | None = None

    def emissions(self, text: str | None) -> np.ndarray:
        """The score of "toxic" against "other" of every token."""
        if self._seen is None:
            self._seen = _Emissions(self.weight, self.bias)
        words = _TOKEN.findall(text or "")
        return np.fromiter(map(self._seen.__getitem__, words), float, len(words))

    def marginals(self, e: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of every token of each sequence, by blocks: products within, a scan across, and back."""
        n = np.array([len(x) for x in e], np.int64)
        if not n.sum():
            return [np.zeros(0) for _ in e]
        blocks = (n + _BLOCK - 1) // _BLOCK
        width = int(min(_BLOCK, n.max()))
        row = np.repeat(np.cumsum(blocks) - blocks, n) + np.concatenate([np.arange(k) for k in n]) // _BLOCK
        col = np.concatenate([np.arange(k) for k in n]) % _BLOCK
        flat = np.concatenate(e)
        total = int(blocks.sum())
        score = np.zeros((total, width))
        valid = np.zeros((total, width), bool)
        score[row, col], valid[row, col] = np.exp(np.clip(flat, -30, 30)), True
        turn = np.exp(self.turn)
        # matrix of each step: from state i to j; steps beyond the end are the identity
        prod = np.tile(np.eye(2), (total, 1, 1))
        step = np.empty((total, 2, 2))
        for t in range(width):
            step[:, :, 0], step[:, :, 1] = turn[:, 0], turn[:, 1] * score[:, t, None]
            prod = np.where(valid[:, t, None, None], prod @ step, prod)
            prod /= prod.sum((1, 2), keepdims=True)
        first = np.cumsum(blocks) - blocks
        ahead, behind = np.ones((total, 2)), np.ones((total, 2))
        ahead /= 2
        for k in range(1, int(blocks.max())):
            at = first[blocks > k] + k
            v = np.einsum("ni,nij->nj", ahead[at - 1], prod[at - 1])
            ahead[at] = v / v.sum(1, keepdims=True)
        last = first + blocks - 1
        for k in range(1, int(blocks.max())):
            at = last[blocks > k] - k
            v = np.einsum("nij,nj->ni", prod[at + 1], behind[at + 1])
            behind[at] = v / v.sum(1, keepdims=True)
        alpha = np.empty((width, total, 2))
        v = ahead
        for t in range(width):
            w = v @ turn
            w[:, 1] *= score[:, t]
            v = np.where(valid[:, t, None], w / w.sum(1, keepdims=True), v)
            alpha[t] = v
        out = np.empty((total, width))
        v = behind
        for t in range(width - 1, -1, -1):
            g = alpha[t] * v
            out[:, t] = g[:, 1] / g.sum(1)
            w = v.copy()
            w[:, 1] *= score[:, t]
            w = w @ turn.T
            v = np.where(valid[:, t, None], w / w.sum(1, keepdims=True), v)
        return np.split(out[row, col], np.cumsum(n)[:-1])

    @staticmethod
    def summary(m: np.ndarray) -> list[float]:
        """What a document's score is made of."""
        if not len(m):
            return [1.0, 0.0, 0.0, 0.0]
        s = float(m.sum())
        return [1.0, math.log1p(s), float(m.max()), math.sqrt(s / len(m))]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Score and marginals of each text."""
        m = self.marginals([self.emissions(t) for t in texts])
        if self.constant is not None:
            return np.full(len(texts), self.constant), m
        x = np.array([self.summary(v) for v in m]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.doc, -30, 30))), m

    def spans(self, text: str, m: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
        """Offsets of runs of tokens that are likelier toxic than `least`."""
        out: list[tuple[int, int]] = []
        if not len(m) or m.max() < least:
            return out
        open_ = False
        for w, p in zip(_TOKEN.finditer(text), m.tolist(), strict=True):
            if p >= least and open_:
                out[-1] = (out[-1][0], w.end())
            elif p >= least:
                out.append((w.start(), w.end()))
            open_ = p >= least
        return out

    def fit(self, texts: list[str], y: np.ndarray, rounds: int = 60, balance: float = 1.0) -> ToxicField:
        """Fit clues, transitions and the document score to document labels.

        The chain sees all toxic texts and about `balance` times as many others.
        """
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.0
            return self
        words = [[w.lower() for w in _TOKEN.findall(t)] for t in texts]
        bad, good = Counter(), Counter()
        for ws, t in zip(words, y, strict=True):
            (bad if t else good).update({c for w in set(ws) for c in clues(w)})
        n1, n0 = float(y.sum()), float(len(y) - y.sum())
        odds = {c: math.log((k + 0.1) / (n1 + 1)) - math.log((good[c] + 0.1) / (n0 + 1)) for c, k in bad.items() if k >= 3}
        telling = {c: o for c, o in odds.items() if o > 2.5}
        strong = {c for c, o in telling.items() if o > 3.5 and bad[c] >= 5}
        other = np.flatnonzero(y == 0)
        rows = [*np.flatnonzero(y == 1), *other[:: max(1, len(other) // max(int(balance * n1), 1))]]
        index = {c: i for i, c in enumerate(sorted(telling))}
        w = np.array([0.5 * telling[c] for c in sorted(telling)])
        seqs, lab, at, ids = [], [], [], []
        n = 0
        for r in rows:
            ws = words[r]
            seqs.append(len(ws))
            for x in ws:
                have = [c for c in clues(x) if c in index]
                at += [n] * len(have)
                ids += [index[c] for c in have]
                lab.append(bool(y[r] and any(c in strong for c in have)))
                n += 1
        lab, at, ids, seqs = np.array(lab), np.array(at, np.int64), np.array(ids, np.int64), np.array(seqs)
        ends = np.cumsum(seqs)
        inner = np.ones(n, bool)
        inner[(ends - seqs)[seqs > 0]] = False
        prior = w.copy()
        pair = np.bincount(2 * lab[:-1][inner[1:]] + lab[1:][inner[1:]], minlength=4).reshape(2, 2) + 1.0
        self.turn = np.log(pair / pair.sum(1, keepdims=True))
        self.turn -= self.turn[:, :1]  # what state "other" leads to counts 0; the bias carries the rest
        self.bias = -1.0
        speed, scale = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, rounds + 1):
            e = self.bias + np.bincount(at, weights=w[ids], minlength=n)
            m = np.concatenate(self.marginals(np.split(e, ends[:-1])))
            gap = lab - m
            g = np.r_[np.bincount(ids, weights=gap[at], minlength=len(w)) - 0.05 * (w - prior), gap.sum()]
            speed, scale = 0.9 * speed + 0.1 * g, 0.99 * scale + 0.01 * g * g
            move = 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-6)
            w, self.bias = w + move[:-1], self.bias + move[-1]
        self.weight = {c: float(w[i]) for c, i in index.items()}
        self._seen = None
        x = np.array([self.summary(v) for v in self.marginals([self.emissions(t) for t in texts])])
        self.doc = np.zeros(4)
        for _ in range(50):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ self.doc, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
            self.doc = self.doc + np.linalg.solve(hess, x.T @ (y - p) - 0.1 * self.doc)
        self._seen = None
        return self


def fit_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, remainder: int = 2, most: int = 3000) -> ToxicField:
    """The field fitted on at most `most` labelled rows that are not held out."""
    rows = fit_sample(docs, labels, "toxic", mod, remainder, most).select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"], kind="stable")
    return ToxicField().fit(rows["text"].tolist(), rows["y"].to_numpy(float))


def toxicity(text: Column, field: ToxicField) -> Column:
    """Column of struct(score, spans: offsets of toxic spans in code points)."""

    @F.pandas_udf("score double, spans array<struct<start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts, score, spans = s.tolist(), [], []
            for part in by_size(texts, rows=300):
                p, m = field.scores(texts[part])
                score.append(p)
                spans += [[{"start": a, "end": b} for a, b in field.spans(t or "", v)] for t, v in zip(texts[part], m, strict=True)]
            yield pd.DataFrame({"score": np.concatenate(score) if score else np.zeros(0), "spans": spans})

    return run(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, remainder: int = 2, threshold: float = 0.3, most: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row of docs."""
    field = fit_toxicity(docs, labels, mod, remainder, most)
    out = docs.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), toxicity(F.col("text"), field).alias("t"))
    return out.select("doc_id", "held_out", "t.score", (F.col("t.score") >= threshold).cast("int").alias("predicted"), "t.spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 3000) -> DataFrame:
    """The rows of docs that score less than `threshold`."""
    field = fit_toxicity(docs, labels, most=most)
    return docs.where(toxicity(F.col("text"), field)["score"] < threshold)
