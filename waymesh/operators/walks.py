"""Walks of images that a task can hold: searches, samples and their matches as arrays, a task some images.

The samples of a walk are thousands of times its start, so what only counts
them is counted where they are made; none is written, shuffled or numbered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from waymesh.operators import matching, regions
from waymesh.operators.iterate import Side

#: What a walk passes: the start's place, lat, lon, dlat, dlon, two_way; in that order, each once.
Samples = tuple[np.ndarray, ...]


def width(lat: np.ndarray) -> np.ndarray:
    """Of a degree of longitude, in degrees of latitude."""
    return np.cos(np.radians(lat))


class Roads:
    """The links of one image (u, v, l, lat1, lon1, lat2, lon2, hidden, two_way), as topology._links gives them."""

    def __init__(self, t: Side):
        order = np.lexsort((t["u"], t["v"]))
        self.nodes, ends = np.unique(np.concatenate([t["u"][order], t["v"][order]]), return_inverse=True)
        n = len(order)
        self.u, self.v = ends[:n], ends[n:]
        self.l = t["l"][order]
        self.place = [t[c][order] for c in ("lat1", "lon1", "lat2", "lon2")]
        self.hidden, self.two_way = t["hidden"][order].astype(bool), t["two_way"][order].astype(bool)
        self.at = np.flatnonzero(np.r_[True, self.v[1:] != self.v[:-1]]) if n else np.zeros(0, np.int64)
        self.into = self.v[self.at]
        self.group = np.cumsum(np.r_[False, self.v[1:] != self.v[:-1]]) if n else np.zeros(0, np.int64)
        self.key = self.v * len(self.nodes) + self.u  # rising
        self.back = self.link(self.v, self.u)

    def link(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Place of the link from u to v, -1 without one."""
        want = np.where((u >= 0) & (v >= 0), v * len(self.nodes) + u, -1)
        i = np.searchsorted(self.key, want)
        i[i == len(self.key)] = 0
        return np.where(self.key[i] == want, i, -1) if len(self.key) else np.full(len(want), -1)

    def index(self, ids: np.ndarray) -> np.ndarray:
        """Place of nodes, -1 without a link."""
        i = np.minimum(np.searchsorted(self.nodes, ids), max(len(self.nodes) - 1, 0))
        return np.where(self.nodes[i] == ids, i, -1) if len(self.nodes) else np.full(len(ids), -1)

    def reach(self, seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]], r: np.ndarray) -> np.ndarray:
        """Shortest distances of every start to all nodes, up to its radius r, from seeds (start, node, distance)."""
        dist = np.full((len(r), len(self.nodes)), np.inf)
        for s, x, d in seeds:
            ok = (x >= 0) & (d <= r[s])
            np.minimum.at(dist, (s[ok], x[ok]), d[ok])
        while len(self.l):
            way = dist[:, self.u] + self.l
            way[way > r[:, None]] = np.inf
            low = np.minimum(np.minimum.reduceat(way, self.at, axis=1), dist[:, self.into])
            if (low == dist[:, self.into]).all():
                break
            dist[:, self.into] = low
        return dist

    def walk(self, starts: Side, r: np.ndarray, step: float, tunnels: bool = False) -> Samples:
        """Samples of walks, as topology.walk describes them, from starts (n1, n2, d1, d2) or (at, node), start i with radius r[i]; tunnels: hidden roads give samples too."""
        own = "n1" in starts
        rows = np.arange(len(r))
        if own:
            x1, x2 = self.index(starts["n1"]), self.index(starts["n2"])
            seeds = [(rows, x1, starts["d1"]), (rows, x2, starts["d2"])]
        else:
            first = self.index(starts["node"])
            seeds = [(starts["at"], first, np.zeros(len(first)))]
        if not len(self.l):
            return tuple(np.zeros(0, k) for k in (np.int64, float, float, float, float, bool))
        dist = self.reach(seeds, r)
        far = dist[:, self.u]
        ok = np.isfinite(far)
        if own:
            ok &= (self.v != x1[:, None]) & (self.v != x2[:, None])
        # the neighbour that a node was reached from; a start's own nodes have none
        way = np.where(ok & np.isfinite(dist[:, self.v]), far + self.l, np.inf)
        low = np.minimum.reduceat(way, self.at, axis=1)
        least = np.where((way == low[:, self.group]) & np.isfinite(way), self.u, len(self.nodes))
        least = np.minimum.reduceat(least, self.at, axis=1)
        came = np.full(dist.shape, -1)
        with np.errstate(invalid="ignore"):
            came[:, self.into] = np.where(np.isfinite(low) & (low <= dist[:, self.into] * (1 + 1e-12)), least, -1)
        if not own:
            came[starts["at"][first >= 0], first[first >= 0]] = -1
        ok &= came[:, self.u] != self.v

        s, k = np.nonzero(ok)
        d, length = far[s, k], self.l[k]
        bias = step * np.ceil(d / step) - d
        n = np.maximum(np.floor((np.minimum(length - 1e-15, r[s] - d) - bias) / step + 1e-9), -1)
        # which way comes first: from the nearer end
        covered = np.zeros(ok.shape)
        covered[s, k] = bias + n * step
        other = self.back[k]
        met = (other >= 0) & ok[s, other]
        theirs = np.where(met, far[s, other], np.inf)
        first = ~met | (d < theirs) | (d == theirs) & (self.u[k] <= self.v[k])
        limit = np.where(first, length, length - covered[s, other])
        keep = n >= 0 if tunnels else (n >= 0) & ~self.hidden[k]
        s, k, d, bias, limit, length, n = (x[keep] for x in (s, k, d, bias, limit, length, n))
        out = [self._spread(s, k, n, lambda i, j: (bias[j] + i * step), lambda off, j: (off <= limit[j]) & (off < length[j]) & (d[j] + off <= r[s[j]] * (1 + 1e-12)), lambda off, j: off / length[j], False)]
        if own:
            e = self.link(x1, x2)
            s, k = rows[e >= 0], e[e >= 0]
            length = self.l[k]
            d1, d2 = starts["d1"][s], starts["d2"][s]
            out.append(self._spread(s, k, np.floor(length / step + 1e-9), lambda i, j: i * step / length[j], lambda al, j: self._near(al, k[j], d1[j], d2[j], r[s[j]]), lambda al, j: al, True))
        return distinct(tuple(np.concatenate(c) for c in zip(*out, strict=True)))

    def _near(self, al: np.ndarray, k: np.ndarray, d1: np.ndarray, d2: np.ndarray, r: np.ndarray) -> np.ndarray:
        lat1, lon1, lat2, lon2 = (c[k] for c in self.place)
        lat, lon = lat1 * al + lat2 * (1 - al), lon1 * al + lon2 * (1 - al)
        w = width(lat)
        gap = lambda a, b: np.sqrt((lat - a) * (lat - a) + ((lon - b) * w) * ((lon - b) * w))
        return (d1 - gap(lat1, lon1) < r) | (d2 - gap(lat2, lon2) < r)

    def _spread(self, s: np.ndarray, k: np.ndarray, n: np.ndarray, offset: Callable, holds: Callable, share: Callable, turned: bool) -> Samples:
        """Samples 0 to n on link k of start s at offset(i, row) where it holds."""
        n = n.astype(np.int64) + 1
        j = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
        off = offset(i, j)
        ok = holds(off, j)
        off, j = off[ok], j[ok]
        part = share(off, j)
        lat1, lon1, lat2, lon2 = (c[k[j]] for c in self.place)
        if turned:
            lat, lon = lat1 * part + lat2 * (1 - part), lon1 * part + lon2 * (1 - part)
        else:
            lat, lon = lat2 * part + lat1 * (1 - part), lon2 * part + lon1 * (1 - part)
        return s[j], lat, lon, lat2 - lat1, lon2 - lon1, self.two_way[k[j]]


def distinct(x: Samples) -> Samples:
    """Samples in order, each once."""
    order = np.lexsort(x[::-1])
    x = tuple(c[order] for c in x)
    new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in x])] if len(order) else np.zeros(0, bool)
    return tuple(c[new] for c in x)


def doubled(x: Samples, shift: float) -> Samples:
    """With a second sample, shifted, where a road goes both ways."""
    two = x[5]
    more = (x[0][two], x[1][two] + shift, x[2][two] + shift, x[3][two], x[4][two], x[5][two])
    return tuple(np.concatenate(c) for c in zip(x, more, strict=True))


def matches(x: Samples, y: Samples, threshold: float, angle: float, zero_rule: bool) -> tuple[np.ndarray, ...]:
    """(i, j, distance, angle) of x's and y's samples of one start, as topology.sample_matches."""
    parts = []
    cos40 = np.cos(np.radians(40.0))
    for i, j in regions.close_pairs(x[0], x[1], x[2], y[0], y[1], y[2], threshold * 1.8):
        a, b = x[1][i] - y[1][j], (x[2][i] - y[2][j]) * width(x[1][i])
        d = np.sqrt(a * a + b * b)
        i, j, d = (c[d < threshold] for c in (i, j, d))
        (adx, ady), (bdx, bdy) = (x[3][i], x[4][i]), (y[3][j], y[4][j])
        p, q = ady * cos40, bdy * cos40
        with np.errstate(invalid="ignore", divide="ignore"):
            m, n = np.sqrt(adx * adx + p * p), np.sqrt(bdx * bdx + q * q)
            off = 1 - np.abs((adx / m) * (bdx / n) + (p / m) * (q / n))
            if zero_rule:
                off = np.where((adx != ady) & (bdx != bdy), off, 0.0)
            ok = off < angle
        parts.append((i[ok], j[ok], d[ok], off[ok]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def any_match(x: Samples, y: Samples, threshold: float, turned: bool) -> np.ndarray:
    """Whether each of x's samples has one of y's nearer than the threshold; turned: the width of a degree is that of y's."""
    hit = np.zeros(len(x[0]), bool)
    for i, j in regions.close_pairs(x[0], x[1], x[2], y[0], y[1], y[2], threshold * 1.8):
        a, b = x[1][i] - y[1][j], (x[2][i] - y[2][j]) * width(y[1][j] if turned else x[1][i])
        hit[i[np.sqrt(a * a + b * b) < threshold]] = True
    return hit


def most_together(at: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """How many of pairs (i, j) of each start go together without a common end."""
    order = np.lexsort((j, i, at))
    at, i, j = at[order], i[order], j[order]
    stops = np.searchsorted(at, np.arange(n + 1))
    i, j = i.tolist(), j.tolist()
    return np.array([len(matching.largest_matching(list(zip(i[p:q], j[p:q], strict=True)))) if q > p else 0 for p, q in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], np.int64)


def taken_ascending(at: np.ndarray, i: np.ndarray, j: np.ndarray, cost: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and cost of pairs that a scan by (cost, i, j) takes, per start; no two with an end in common."""
    order = np.lexsort((j, i, cost))
    mine, theirs, keep = set(), set(), []
    for k, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        if a not in mine and b not in theirs:
            mine.add(a)
            theirs.add(b)
            keep.append(k)
    keep = np.array(keep, np.int64)
    return np.bincount(at[keep], minlength=n), np.bincount(at[keep], weights=cost[keep], minlength=n)


def blocks(n: int, links: int, most: int = 1_000_000) -> Iterator[np.ndarray]:
    """Places of starts, so many at a time that their searches hold some `most` numbers."""
    each = max(most // max(links, 1), 1)
    for p in range(0, n, each):
        yield np.arange(p, min(p + each, n))
