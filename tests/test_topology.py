"""Walks and the topology score against sequential twins."""

import heapq
import math

import pytest

from waymesh.operators import graph, iterate, matching, topology
from waymesh.sources.fixtures import table

SF = "/root/testdata/sf0.001"


def deg(p, q):
    return math.hypot(p[0] - q[0], (p[1] - q[1]) * math.cos(math.radians(p[0])))


def unit(a, b):
    b *= math.cos(math.radians(40))
    n = math.hypot(a, b)
    return a / n, b / n


class Road:
    """One image's graph: places, neighbours and edges by id."""

    def __init__(self, nodes, edges):
        self.at = {n["node_id"]: (n["lat"], n["lon"]) for n in nodes}
        self.edges = {e["edge_id"]: (e["n1"], e["n2"]) for e in edges}
        self.near = {n: set() for n in self.at}
        for a, b in self.edges.values():
            self.near[a].add(b)
            self.near[b].add(a)

    def reach(self, seeds, r, shut=()):
        """Final distances within r and where each node was reached from."""
        best, came = {}, {}
        heap = [(d, -1, n) for n, d in seeds.items() if d <= r]
        heapq.heapify(heap)
        while heap:
            d, u, n = heapq.heappop(heap)
            if n in best:
                continue
            best[n], came[n] = d, u
            for m in self.near[n]:
                if m not in shut and m not in best and d + deg(self.at[m], self.at[n]) <= r:
                    heapq.heappush(heap, (d + deg(self.at[m], self.at[n]), n, m))
        return best, came

    def walk(self, n1, n2, d1, d2, step, r):
        out = set()
        p, q = self.at[n1], self.at[n2]
        length = deg(q, p)
        for k in range(int(length / step + 1e-9) + 1):
            a = k * step / length
            s = (p[0] * a + q[0] * (1 - a), p[1] * a + q[1] * (1 - a))
            if d1 - deg(s, p) < r or d2 - deg(s, q) < r:
                out.add((*s, q[0] - p[0], q[1] - p[1]))
        best, came = self.reach({n1: d1, n2: d2}, r, (n1, n2))
        legs = [(best[u], u, v) for u in best for v in self.near[u] if v not in (n1, n2) and v != came[u]]
        covered = {}
        for d, u, v in sorted(legs):
            a, b = self.at[u], self.at[v]
            length = deg(b, a)
            at = step * math.ceil(d / step) - d
            limit = length - covered[v, u] if (v, u) in covered else length
            last = at - step
            while at < length - 1e-15 and d + at <= r + 1e-15:
                last = at
                if at <= limit:
                    f = at / length
                    out.add((b[0] * f + a[0] * (1 - f), b[1] * f + a[1] * (1 - f), b[0] - a[0], b[1] - a[1]))
                at += step
            covered[u, v] = last
        return out

    def gap(self, a, b, most):
        """Distance along roads of two positions."""
        if a[:2] == b[:2]:
            return abs(a[2] - b[2])
        if a[:2] == (b[1], b[0]):
            return abs(a[2] - b[3])
        best, _ = self.reach({a[0]: a[2], a[1]: a[2]}, most, a[:2])
        ways = [best[n] + off for n, far, off in ((b[0], b[1], b[2]), (b[1], b[0], b[3])) if n in best and far not in a[:2]]
        return min(ways, default=100000)


def largest(pairs):
    """Size of a largest matching, by depth-first augmenting."""
    near, of = {}, {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)

    def grow(a, seen):
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in of or grow(of[b], seen):
                    of[b] = a
                    return True
        return False

    return sum(grow(a, set()) for a in near)


def hits(a, b, thr):
    out = []
    for i, s in enumerate(a):
        for j, t in enumerate(b):
            if deg(s, t) < thr:
                u, v = unit(s[2], s[3]), unit(t[2], t[3])
                if (1 - abs(u[0] * v[0] + u[1] * v[1]) if s[2] != s[3] and t[2] != t[3] else 0) < 0.29:
                    out.append((i, j))
    return out


@pytest.fixture(scope="module")
def roads(spark):
    g = [tuple(iterate.cut(x) for x in graph.road_graph(table(spark, SF, t))) for t in ("fx_edge_pred", "fx_edge_gt")]
    by = []
    for n, e in g:
        ns, es = n.collect(), e.collect()
        by.append({i: Road([x for x in ns if x["image_id"] == i], [x for x in es if x["image_id"] == i]) for i in {x["image_id"] for x in ns}})
    return g, by


def close(got, want):
    """Samples equal but for rounding."""
    key = lambda s: sorted(tuple(round(v, 11) for v in x) for x in s)
    return key(got) == key(want)


def test_walks_equal_a_scan(spark, roads):
    (pred, truth), (_, twin) = roads
    rows = []
    for i, road in twin.items():
        for e in sorted(road.edges)[::37]:
            a, b = road.edges[e]
            d = deg(road.at[a], road.at[b])
            rows.append((i, e, a, b, d / 3, 2 * d / 3))
    starts = spark.createDataFrame(rows, "image_id long, start long, n1 long, n2 long, d1 double, d2 double")
    got = {}
    for x in topology.walk(*truth, starts, r=0.0009).collect():
        got.setdefault((x["image_id"], x["start"]), []).append((x["lat"], x["lon"], x["dlat"], x["dlon"]))
    for i, e, a, b, d1, d2 in rows:
        assert close(got[i, e], twin[i].walk(a, b, d1, d2, 0.00005, 0.0009)), (i, e)
    doubled = topology.walk(*truth, starts, r=0.0009, doubled=True).count()
    assert doubled == 2 * sum(map(len, got.values()))
    kept = topology.walk(*truth, starts, r=0.0009, keep=lambda lat, lon: lat > 40.999)
    assert kept.count() == sum(s[0] > 40.999 for v in got.values() for s in v)
    # a road in a tunnel gives no samples beyond the start's own
    low = topology.walk(truth[0], truth[1].selectExpr("*", "-1 layer"), starts, r=0.0009)
    assert 0 < low.count() < sum(map(len, got.values()))


def test_distance_between_positions(spark, roads):
    (_, truth), (_, twin) = roads
    rows, want = [], {}
    for i, road in twin.items():
        es = sorted(road.edges)
        for k, (e, f) in enumerate(zip(es[::5], es[3::5] + es[:1], strict=False)):
            (a, b), (c, d) = road.edges[e], road.edges[f]
            p, q = (a, b, deg(road.at[a], road.at[b]) / 4, 0.0), (c, d, 0.00002, 0.00007)
            rows.append((i, k, *p[:3], p[3], *q))
            want[i, k] = road.gap(p, q, 0.0008)
    pairs = spark.createDataFrame(rows, "image_id long, pair long, a1 long, a2 long, ad1 double, ad2 double, b1 long, b2 long, bd1 double, bd2 double")
    got = {(x["image_id"], x["pair"]): x["dist"] for x in topology.edge_position_distance(*truth, pairs, 0.0008).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert sum(v < 100000 for v in want.values()) > 20


def test_topology_score_equals_a_scan(spark, roads):
    (pred, truth), (tp, tt) = roads
    x = topology._Pair(pred, truth, 0.0001, 0.0005)
    starts = [r.asDict() for r in x.starts.collect()]
    window = {r["image_id"]: r for r in x.window.collect()}
    assert starts and all(abs(s["d1"] + s["d2"] - deg(tt[s["image_id"]].at[s["n1"]], tt[s["image_id"]].at[s["n2"]])) < 1e-12 for s in starts)
    for s in starts:  # 7 % off the window's sides
        w = window[s["image_id"]]
        assert s["lat"] - w["min_lat"] > 0.07 * (w["max_lat"] - w["min_lat"]) and w["max_lon"] - s["lon"] > 0.07 * (w["max_lon"] - w["min_lon"])
    pairs = {(r["image_id"], r["start"]): r for r in x.pairs.collect()}
    want = {}
    for s in starts:
        i, road = s["image_id"], tp[s["image_id"]]
        a, b = tt[i].at[s["n1"]], tt[i].at[s["n2"]]
        best = None
        for e, (m, n) in road.edges.items():
            p, q = road.at[m], road.at[n]
            c = math.cos(math.radians(p[0]))
            qx, qy, sx, sy = q[0] - p[0], (q[1] - p[1]) * c, s["lat"] - p[0], (s["lon"] - p[1]) * c
            t = min(1, max(0, (qx * sx + qy * sy) / (qx * qx + qy * qy)))
            d = math.hypot(sx - t * qx, sy - t * qy)
            u, v = unit(q[0] - p[0], q[1] - p[1]), unit(b[0] - a[0], b[1] - a[1])
            if d < 0.0001 and 1 - abs(u[0] * v[0] + u[1] * v[1]) < 0.04:
                best = min(best or (d, e), (d, e))
        if best:
            want[i, s["start"]] = best[1]
    assert {k: r["edge_id"] for k, r in pairs.items()} == want
    scores = topology.start_scores(x.pred, x.truth, x.pairs, x.starts)
    scores = iterate.cut(scores)
    got = {(r["image_id"], r["start"]): r for r in scores.collect()}
    by = {(s["image_id"], s["start"]): s for s in starts}
    for k in sorted(got)[::7]:
        s, p, r = by[k], pairs[k], window[k[0]]["radius"]
        marbles = sorted(tp[k[0]].walk(p["n1"], p["n2"], p["d1"], p["d2"], 0.00005, r))
        holes = sorted(tt[k[0]].walk(s["n1"], s["n2"], s["d1"], s["d2"], 0.00005, r))
        double = holes + [(a + 0.00001, o + 0.00001, c, d) for a, o, c, d in holes]
        assert abs(got[k]["precision"] - largest(hits(marbles, double, 0.0001)) / len(marbles)) < 1e-9
        assert abs(got[k]["recall"] - largest(hits(holes, marbles, 0.0001)) / len(holes)) < 1e-9
    kept = {}
    for i in tp:
        rows = sorted(((r["precision"], r["start"]) for k, r in got.items() if k[0] == i), reverse=True)
        marked = set()
        for p, s in rows:
            if s in marked and p < 0.9:
                continue
            kept[i, s] = got[i, s]
            me = pairs[i, s]
            for _, t in rows:
                o = pairs[i, t]
                near = abs(me["lat"] - o["lat"]) <= 0.000301 and abs(me["lon"] - o["lon"]) <= 0.0003 / math.cos(math.radians(me["lat"])) + 1e-6
                if near and tp[i].gap((me["n1"], me["n2"], me["d1"], me["d2"]), (o["n1"], o["n2"], o["d1"], o["d2"]), 0.0003) < 0.0002:
                    marked.add(t)
    thin = {(r["image_id"], r["start"]) for r in topology.thin(scores, *x.pred).collect()}
    assert thin == set(kept)
    # were every result unsure, those next to a better one would go
    unsure = iterate.cut(scores.withColumn("precision", scores["precision"] * 0.8))
    assert 0 < topology.thin(unsure, *x.pred, near=0.0006, reach=0.0008).count() < len(got)
    final = {r["image_id"]: r for r in topology.topo(pred, truth).collect()}
    for i in tt:
        mine = [r for k, r in kept.items() if k[0] == i]
        n = sum(s["image_id"] == i for s in starts)
        p = sum(r["precision"] for r in mine) / len(mine) if mine else 0
        q = sum(r["recall"] for r in mine) / n if n else 0
        assert abs(final[i]["precision"] - p) < 1e-9 and abs(final[i]["recall"] - q) < 1e-9


def test_a_graph_with_itself(spark, roads):
    (_, truth), _ = roads
    got = topology.topo(truth, truth).collect()
    assert all(r["precision"] > 0.9 and 0 < r["recall"] <= 1 for r in got)
    x = topology._Pair(truth, truth, 0.0001, 0.0005)
    soft = topology.soft_scores(truth, truth, x.pairs, x.starts).collect()
    assert all(r["n_marbles"] > 0 and 0 <= r["f"] <= 1 for r in soft)
    same = topology.list_scores(truth, truth, truth[0].where("node_id % 25 = 0").selectExpr("image_id", "node_id truth_node", "node_id node"), r=0.0008).collect()
    assert same and all(r["precision"] == r["recall"] == r["avg_precision"] == 1.0 for r in same)
    rnd = topology.random_scores(truth, truth, 5, 1, r=0.0008).collect()
    assert all(r["precision"] == 1.0 and 0.8 < r["recall"] <= 1 for r in rnd)


def test_matching_in_rounds_is_as_large(spark):
    import random

    r = random.Random(7)
    rows = [(g, a, b) for g in range(6) for a in range(25) for b in range(25) if r.random() < 0.06]
    pairs = spark.createDataFrame(rows, "g int, a long, b long")
    got = matching.matching_rounds(pairs, "g").collect()
    for g in range(6):
        mine = [(x["a"], x["b"]) for x in got if x["g"] == g]
        assert len({a for a, _ in mine}) == len({b for _, b in mine}) == len(mine) == largest([(a, b) for h, a, b in rows if h == g])
        assert set(mine) <= {(a, b) for h, a, b in rows if h == g}
        assert len(matching.largest_matching([(a, b) for h, a, b in rows if h == g])) == len(mine)
    sizes = matching.component_match(pairs.selectExpr("*", "0d cost"), "g", most=3).groupBy("g").count().collect()
    assert {x["g"]: x["count"] for x in sizes} == {g: sum(x["g"] == g for x in got) for g in range(6)}


def _close(a, b):
    """Rows of two tables alike, numbers up to rounding."""
    a, b = (sorted((r.asDict() for r in x.collect()), key=lambda r: (r["image_id"], r["start"])) for x in (a, b))
    assert len(a) == len(b) > 0
    for p, q in zip(a, b, strict=True):
        assert p.keys() == q.keys() and all(p[c] == q[c] or abs(p[c] - q[c]) < 1e-9 for c in p)


def test_walks_of_whole_images_equal_joins(spark, roads, monkeypatch):
    (pred, truth), _ = roads
    low = (truth[0], truth[1].selectExpr("*", "case when edge_id % 7 = 0 then -1 else 0 end layer"))
    x = topology._Pair(pred, low, 0.0001, 0.0005)
    x.starts = iterate.cut(x.starts.withColumn("r", x.starts["r"] * 0.4))
    x.pairs = iterate.cut(x.pairs.withColumn("r", x.pairs["r"] * 0.4))
    nodes = truth[0].join(pred[0].selectExpr("image_id", "lat", "lon", "node_id node"), ["image_id", "lat", "lon"]).where("node % 6 = 0").selectExpr("image_id", "node_id truth_node", "node")
    steps = [
        lambda: topology.start_scores(x.pred, x.truth, x.pairs, x.starts),
        lambda: topology.start_scores(x.pred, x.truth, x.pairs, x.starts, one_to_one=False),
        lambda: topology.soft_scores(x.pred, x.truth, x.pairs, x.starts),
        lambda: topology.matched_samples(x.pred, x.truth, x.pairs, x.starts, 0.0001, 0.0006),
        lambda: topology.list_scores(pred, truth, nodes, r=0.0006),
    ]
    whole = [iterate.cut(s()) for s in steps]
    one_way = topology.walk(*pred, x.pairs, r="r", directed=True).count()
    monkeypatch.setattr(topology, "MOST", 0)
    for a, s in zip(whole, steps, strict=True):
        _close(a, s())
    assert one_way == topology.walk(*pred, x.pairs, r="r", directed=True).count() > 0


def test_scores_of_starts_write_no_samples(spark, roads):
    (pred, truth), _ = roads
    x = topology._Pair(pred, truth, 0.0001, 0.0005)
    for t in (topology.start_scores(x.pred, x.truth, x.pairs, x.starts), topology.matched_samples(x.pred, x.truth, x.pairs, x.starts, 0.0001, 0.0006)):
        plan = t._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Aggregate" not in plan and "Generate" not in plan


def test_list_scores_query_takes_every_node(spark):
    from waymesh.plans import metric_queries

    d = "/root/testdata/sf0.001"
    got = {(r["image_id"], r["start"]) for r in metric_queries.Q["t12_list_scores"](spark, d).select("image_id", "start").collect()}
    (n, e), (tn, _) = (metric_queries._roads(spark, d, t) for t in ("fx_edge_pred", "fx_edge_gt"))
    want = {(r["image_id"], r["node_id"]) for r in tn.join(n.select("image_id", "lat", "lon"), ["image_id", "lat", "lon"]).collect()}
    assert got == want and len({s % 10 for _, s in got}) == 10
