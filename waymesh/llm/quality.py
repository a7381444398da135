"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` words. A passage is read as its words
and neighbouring pairs of words, hashed to `BUCKETS` counts, next to statistics
of its surface; an encoder turns that into a hidden vector, gated attention
weighs the passages of a document, and the weighed sum is scored. Encoder,
attention and scorer are learnt together from document labels on a bounded
sample of labelled rows.

A null or empty text is a bag of one passage of zeros and has a score like any
other. Without labelled rows, or with one class only, every score is that
class's share (0.5 without rows).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.labelled import by_size, fit_sample, held_out

PASSAGE = 128
_MARKS = "!?.,;:|#$%&*@/=<>\"'()[]{}-_"
N_SURFACE = 18 + len(_MARKS)
#: Buckets of words, and of pairs of words.
BUCKETS = 128
N_FEATURES = N_SURFACE + 2 * BUCKETS


def passage_vector(words: list[str]) -> list[float]:
    """Surface statistics of one passage."""
    n = len(words)
    if not n:
        return [0.0] * N_SURFACE
    s = " ".join(words)
    m = len(s)
    lens = list(map(len, words))
    mean = sum(lens) / n
    sq = sum(x * x for x in lens) / n
    kinds = set(words)
    upper, lower = s.upper(), s.lower()
    capital = sum(map(str.istitle, words)) / n
    caps = sum(map(str.isupper, words)) / n
    digits = sum(map(str.isdigit, words)) / n
    alpha = sum(map(str.isalpha, words)) / n
    again = sum(map(str.__eq__, words, words[1:])) / n
    ends = sum(w[-1] in ".!?" for w in words) / n
    pairs = len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)
    ascii_share = len(s.encode("ascii", "ignore")) / m
    letters = len(set(lower)) / 64
    base = [
        math.log1p(n),
        mean,
        math.sqrt(max(sq - mean * mean, 0)),
        max(lens) / 20,
        len(kinds) / n,
        pairs,
        again,
        capital,
        caps,
        digits,
        alpha,
        ends,
        ascii_share,
        letters,
        float(s == upper),
        float(s == lower),
        sum(x <= 3 for x in lens) / n,
        sum(x >= 9 for x in lens) / n,
    ]
    return base + [math.log1p(100 * s.count(c) / m) for c in _MARKS]


class _Buckets(dict):
    """Bucket of each word seen; a bounded memory that starts again when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = crc32(word.lower().encode("utf-8", "surrogatepass"))
        return h


_HASH = _Buckets()


def bag(text: str | None) -> np.ndarray:
    """The passage vectors of a text: surface statistics, then square roots of the shares of hashed words and of hashed pairs."""
    words = (text or "").split()
    out = np.zeros((max(-(-len(words) // PASSAGE), 1), N_FEATURES), np.float32)
    if words:
        h = np.fromiter(map(_HASH.__getitem__, words), np.int64, len(words))
        at = np.arange(len(words)) // PASSAGE
        n = np.bincount(at)[:, None]
        one = np.bincount(at * BUCKETS + h % BUCKETS, minlength=len(out) * BUCKETS).reshape(-1, BUCKETS)
        pair = (h[:-1] * 31 + h[1:]) % 1_000_003 % BUCKETS
        two = np.bincount(at[:-1] * BUCKETS + pair, minlength=len(out) * BUCKETS).reshape(-1, BUCKETS)
        out[:, N_SURFACE : N_SURFACE + BUCKETS], out[:, N_SURFACE + BUCKETS :] = np.sqrt(one / n), np.sqrt(two / n)
    for i in range(len(out)):
        out[i, :N_SURFACE] = passage_vector(words[i * PASSAGE : (i + 1) * PASSAGE])
    return out


class AttentionModel:
    """Gated-attention scorer over bags of passage vectors, in numpy."""

    def __init__(self, hidden: int = 16, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "W": r.normal(0, 1 / math.sqrt(N_FEATURES), (N_FEATURES, hidden)),
            "b": np.zeros(hidden),
            "V": r.normal(0, 1 / math.sqrt(hidden), (hidden, gate)),
            "U": r.normal(0, 1 / math.sqrt(hidden), (hidden, gate)),
            "w": r.normal(0, 1 / math.sqrt(gate), gate),
            "c": r.normal(0, 1 / math.sqrt(hidden), hidden),
            "d": np.zeros(1),
        }
        self.mean, self.scale, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(np.r_[starts, len(x)])
        doc = np.repeat(np.arange(len(starts)), n)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        a = e / np.add.reduceat(e, starts)[doc]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"doc": doc, "h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss, by parameter."""
        p, f = self.p, self._forward(x, starts)
        h, t, s, a, doc = f["h"], f["t"], f["s"], f["a"], f["doc"]
        dy = (f["y"] - y) / len(y)
        dz = np.outer(dy, p["c"])[doc]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[doc])
        dg = np.outer(de, p["w"])
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.03, decay: float = 1e-3) -> AttentionModel:
        """Full-batch Adam on the mean logistic loss."""
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, rounds + 1):
            p, grad = self.p, self.gradient(x, starts, y)
            for k, g in grad.items():
                g = g + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        if not bags:
            return np.zeros(0)
        x, starts = stack(bags)
        return self._forward(np.clip((x - self.mean) / self.scale, -8, 8), starts)["y"]


def stack(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bags as one matrix and the first row of each."""
    sizes = np.fromiter(map(len, bags), np.int64, len(bags))
    return np.concatenate(bags).astype(np.float64), np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", mod: int = 3, remainder: int = 1, most: int = 3000) -> AttentionModel:
    """The model fitted on at most `most` labelled rows that are not held out."""

    @F.pandas_udf("array<float>")
    def bags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([bag(t).ravel() for t in s])

    rows = fit_sample(docs, labels, target, mod, remainder, most).select("doc_id", "y", bags("text").alias("x")).toPandas().sort_values(["doc_id", "y"], kind="stable")
    got = [np.asarray(v, np.float64).reshape(-1, N_FEATURES) for v in rows["x"]]
    if not got:
        return AttentionModel().fit(np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), np.zeros(0))
    starts = np.r_[0, np.cumsum([len(g) for g in got])[:-1]].astype(np.int64)
    return AttentionModel().fit(np.concatenate(got), starts, rows["y"].to_numpy(float))


def quality_score(text: Column, model: AttentionModel) -> Column:
    """Column of scores, higher for better texts."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            yield pd.Series(np.concatenate([np.zeros(0), *(model.score([bag(t) for t in texts[part]]) for part in by_size(texts))]))

    return run(text)


def score_quality(docs: DataFrame, labels: DataFrame, mod: int = 3, remainder: int = 1, threshold: float = 0.5, most: int = 3000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    model = fit_quality(docs, labels, "quality", mod, remainder, most)
    out = docs.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 3000) -> DataFrame:
    """The rows of docs that score at least `threshold`."""
    model = fit_quality(docs, labels, most=most)
    return docs.where(quality_score(F.col("text"), model) >= threshold)
