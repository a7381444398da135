"""Whitening of embeddings: a symmetric eigenproblem from one distributed covariance.

Entries become whole numbers, floor(scale * c). The fit list is every distinct
vector once; its sums are exact. The covariance is summed in centred products
per partition, which meet row by row of the matrix. On the driver, whose share
is the d x d matrix, Householder reflections make it tridiagonal, bisection on
Sturm counts finds the leading eigenvalues, inverse iteration their vectors,
made orthogonal within clusters. Every row is then projected with the few
components that all tasks hold.

Edge rows: null vectors and those with a null or non-finite entry are left out.
Vectors of each length are fitted by themselves; one of length d has at most d
components, an empty one none. A component without variance (all vectors alike,
fewer vectors than components) has a null whitened value and explains 0, or null
if no component has any variance; identity_error is over the components that
have it, null without one. Repeated vectors count once in the fit and each in
the result, a null id like any other. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.session import materialise

EPS = 2.0**-52


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and Householder vectors of a symmetric matrix; vector k acts on rows k + 1 and on."""
    a = np.array(a, float)
    d = len(a)
    vectors = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x[1:]).max(initial=0.0)
        if size == 0.0:
            vectors.append(np.zeros(0))
            continue
        scale = max(size, abs(x[0]))
        v = x / scale
        norm = math.copysign(math.sqrt(v @ v), v[0])
        v[0] += norm
        v /= math.sqrt(v @ v)
        sub = a[k + 1 :, k + 1 :]
        p = 2.0 * (sub @ v)
        q = p - (v @ p) * v
        sub -= np.outer(v, q) + np.outer(q, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0.0
        a[k + 1, k] = a[k, k + 1] = -norm * scale
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def below(diag: np.ndarray, off: np.ndarray, x: float) -> int:
    """How many eigenvalues of a tridiagonal matrix are less than x: negative pivots of the shifted matrix (a Sturm count)."""
    tiny = EPS * EPS * max(1.0, float(np.abs(off).max(initial=0.0)) ** 2) + np.finfo(float).tiny
    n, q = 0, 1.0
    for i, a in enumerate(diag.tolist()):
        q = a - x - (off[i - 1] * off[i - 1] / q if i else 0.0)
        if abs(q) < tiny:
            q = -tiny
        n += q < 0
    return n


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The k largest eigenvalues, falling, each bisected until its ends are neighbours or next to it."""
    d = len(diag)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = float((diag - reach).min()), float((diag + reach).max())
    pad = 4 * EPS * max(abs(low), abs(high)) + np.finfo(float).tiny
    low, high = low - pad, high + pad
    out = []
    for j in range(k):
        lo, hi = low, high
        while True:
            mid = lo + (hi - lo) / 2
            if mid <= lo or mid >= hi or hi - lo <= EPS * max(abs(lo), abs(hi)):
                break
            if below(diag, off, mid) > d - 1 - j:
                hi = mid
            else:
                lo = mid
        out.append(lo + (hi - lo) / 2)
        high = hi
    return out


def _factors(diag: np.ndarray, off: np.ndarray, x: float) -> tuple:
    """Rows of the upper factor, multipliers and swaps of a shifted tridiagonal matrix, pivoted by rows."""
    d = len(diag)
    size = max(float(np.abs(diag).max(initial=0.0)), float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    u0, u1, u2 = (diag - x).tolist(), [*off.tolist(), 0.0], [0.0] * d
    low, mult, swap = off.tolist(), [0.0] * d, [False] * d
    for i in range(d - 1):
        if abs(low[i]) > abs(u0[i]):
            swap[i] = True
            m = u0[i] / low[i]
            u0[i], u1[i], u2[i], u0[i + 1], u1[i + 1] = low[i], u0[i + 1], u1[i + 1], u1[i] - m * u0[i + 1], -m * u1[i + 1]
        else:
            if u0[i] == 0.0:
                u0[i] = EPS * size
            m = low[i] / u0[i]
            u0[i + 1] -= m * u1[i]
        mult[i] = m
    if abs(u0[-1]) < EPS * size:
        u0[-1] = EPS * size
    return u0, u1, u2, mult, swap


def _solve(f: tuple, y: np.ndarray) -> np.ndarray:
    u0, u1, u2, mult, swap = f
    y = y.tolist()
    d = len(y)
    for i in range(d - 1):
        if swap[i]:
            y[i], y[i + 1] = y[i + 1], y[i] - mult[i] * y[i + 1]
        else:
            y[i + 1] -= mult[i] * y[i]
    for i in range(d - 1, -1, -1):
        s = y[i]
        if i + 1 < d:
            s -= u1[i] * y[i + 1]
        if i + 2 < d:
            s -= u2[i] * y[i + 2]
        y[i] = s / u0[i]
    return np.array(y)


def vectors_of(diag: np.ndarray, off: np.ndarray, values: list[float], rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors (rows) of falling eigenvalues by inverse iteration; each is made orthogonal to those of its cluster every round."""
    d = len(diag)
    norm = max(float(np.abs(diag).max(initial=0.0)), float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    rng = np.random.default_rng(11)
    out: list[np.ndarray] = []
    cluster, shift = 0, None
    for j, e in enumerate(values):
        if j and values[j - 1] - e > 1e-3 * norm:
            cluster = j
        # equal eigenvalues are told apart by a few last places, so that their factors differ
        shift = e if j == cluster else min(e, shift - 10 * EPS * norm)
        f = _factors(diag, off, shift)
        y = rng.standard_normal(d)
        for _ in range(rounds):
            y /= np.abs(y).max()
            y = _solve(f, y)
            y /= np.abs(y).max()
            for _ in range(2):
                for z in out[cluster:]:
                    y -= (z @ y) * z
            y /= math.sqrt(y @ y)
        out.append(y)
    return np.array(out).reshape(len(values), d)


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows, the largest entry of each positive."""
    d = len(v)
    k = min(k, d)
    if not k:
        return np.zeros(0), np.zeros((0, d))
    diag, off, reflections = tridiagonal(v)
    values = leading_values(diag, off, k)
    y = vectors_of(diag, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        h = reflections[i]
        if len(h):
            y[:, i + 1 :] -= 2.0 * np.outer(y[:, i + 1 :] @ h, h)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    y *= np.sign(y[np.arange(k), np.abs(y).argmax(1)])[:, None]
    return np.array(values), y


@dataclass
class Fit:
    """What one vector length's fit list gives: n, exact sums, eigenvalues, components (rows), explained shares."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: list[float | None]
    wide: bool
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers on the components with variance."""
        r = self.values > 0
        return (x - self.mean) @ self.components[r].T / np.sqrt(self.values[r])

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distance of n * x from the sums; whole Python numbers where 64 bits could overflow."""
        if self.wide:
            rows = [[self.n * int(c) - s for c, s in zip(r, self.sums, strict=True)] for r in x]
            return np.array([sum(c * c for c in r) for r in rows], object)
        y = self.n * x - np.array(self.sums, np.int64)
        return (y * y).sum(1)


def whole_entries(vector: str, scale: int) -> Column:
    """floor(scale * c) of every entry as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(0).cast("long"))


def _stacked(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.int64)


def _products(fit_list: DataFrame, of: dict[int, Fit], whitened: bool) -> dict[int, np.ndarray]:
    """By vector length, the mean over the fit list of the products of centred rows, or of whitened ones and 1.

    Each partition adds up its own matrix; matrices meet row by row, in the order of partitions.
    """
    means = {d: f.mean for d, f in of.items()}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId(), {}
        for b in batches:
            for d, rows in b.groupby("d")["x"]:
                x = _stacked(rows)
                y = np.column_stack([of[d].whitened(x), np.ones(len(x))]) if whitened else x - means[d]
                sums[d] = sums.get(d, 0.0) + y.T @ y
        for d, m in sums.items():
            yield pd.DataFrame({"d": d, "row": range(len(m)), "part": part, "sums": list(m)})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.stack(pdf.sort_values("part")["sums"].to_numpy()).sum(0)
        return pd.DataFrame({"d": pdf["d"].iloc[:1], "row": pdf["row"].iloc[:1], "sums": [total]})

    kind = "d int, row int, sums array<double>"
    got = fit_list.mapInPandas(partial, "d int, row int, part int, sums array<double>").groupBy("d", "row").applyInPandas(meet, kind)
    rows: dict[int, dict[int, list[float]]] = {}
    for r in got.collect():  # d x d numbers
        rows.setdefault(r["d"], {})[r["row"]] = r["sums"]
    return {d: np.array([m[i] for i in range(len(m))]) / of[d].n for d, m in rows.items()}


def fitted(fit_list: DataFrame, k: int) -> dict[int, Fit]:
    """Fits of a list of distinct vectors (d, x), by vector length."""
    each = fit_list.select("d", F.posexplode("x").alias("i", "c"))
    sums: dict[int, dict[int, tuple]] = {}
    # d rows a length
    for r in each.groupBy("d", "i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.max(F.abs(F.col("c").cast("decimal(20,0)"))).alias("m")).collect():
        sums.setdefault(r["d"], {})[r["i"]] = (int(r["s"]), r["n"], int(r["m"]))
    fits = {}
    for d, s in sums.items():
        n = s[0][1]
        wide = d * (2 * n * max(m for _, _, m in s.values())) ** 2 >= 2**63
        fits[d] = Fit(n, [s[i][0] for i in range(d)], np.zeros(0), np.zeros((0, d)), [], wide)
    if not fits:
        return fits
    for d, v in _products(fit_list, fits, whitened=False).items():
        v = (v + v.T) / 2
        values, components = leading_components(v, k)
        trace = float(np.trace(v))
        values = np.where(values > d * EPS * max(float(np.abs(values).max()), 0.0), values, 0.0)
        fits[d].values, fits[d].components = values, components
        fits[d].explained = [float(e / trace) if trace > 0 else None for e in values]
    for d, m in _products(fit_list, fits, whitened=True).items():
        if len(m) > 1:
            # rows are centred before they are multiplied; what rounding leaves of their mean comes off
            c = m[:-1, :-1] - np.outer(m[:-1, -1], m[:-1, -1])
            fits[d].identity_error = float(np.abs(c - np.eye(len(c))).max())
    return fits


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 4, scale: int = 256) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with a sound vector and each of its up to k components."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    sound = rows.where(F.col(vector).isNotNull() & finite & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.size(vector).alias("d"), whole_entries(vector, scale).alias("x"))
    fits = fitted(materialise(sound.select("d", "x").distinct(), "fit"), k)
    kind = rows.schema[key].dataType
    exact = not any(f.wide for f in fits.values())
    deviation = pa.int64() if exact else pa.string()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("d").to_numpy(zero_copy_only=False)
            for d in sorted(set(lengths.tolist())):
                f, at = fits[d], np.flatnonzero(lengths == d)
                x = b.column("x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                w, has = f.whitened(x), f.values > 0
                dev = f.deviation(x)
                dev = pa.array(dev, pa.int64()) if exact else pa.array([str(v) for v in dev.tolist()], pa.string())
                place = np.cumsum(has) - 1
                for c in range(len(f.values)):
                    white = pa.array(w[:, place[c]]) if has[c] else pa.nulls(len(at), pa.float64())
                    once = lambda v, t: pa.array([v] * len(at), t)  # noqa: B023, E731
                    cols = [b.column("key").take(pa.array(at)), once(c + 1, pa.int32()), once(f.n, pa.int64()), dev, white, once(f.explained[c], pa.float64()), once(f.identity_error, pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    big = "long" if deviation == pa.int64() else "string"
    out = sound.mapInArrow(project, f"key {kind.simpleString()}, component int, n long, deviation {big}, whitened double, explained double, identity_error double")
    whole = F.col("deviation") if exact else F.col("deviation").cast("decimal(38,0)")
    return out.withColumn("deviation", whole).withColumnRenamed("key", key)
