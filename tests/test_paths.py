"""Loops and the path-length score against sequential twins."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.operators import graph, iterate, metrics, regions
from waymesh.sources.fixtures import table

SF = "/root/testdata/sf0.001"
COS = math.cos(math.radians(41.0))


def place(x, y):
    return 41.0 - y / 111111.0, -71.0 + x / 111111.0 / COS


def metres(p, q):
    return math.hypot(p[0] - q[0], (p[1] - q[1]) * math.cos(math.radians(p[0]))) * 111111.0


def dense(edges):
    """Nodes (by number) and neighbours of a densified graph, scanned edge by edge."""
    places, links = {}, set()
    for x1, y1, x2, y2 in edges:
        p, q = place(x1, y1), place(x2, y2)
        d = metres(p, q)
        n = int(d / 2) + 1 if d > 3 else 1
        pts = [p if i == 0 else q if i == n else (p[0] * (1 - i / n) + q[0] * (i / n), p[1] * (1 - i / n) + q[1] * (i / n)) for i in range(n + 1)]
        keys = [(round(a * 1e7), round(o * 1e7)) for a, o in pts]
        for k, at in zip(keys, pts, strict=True):
            places[k] = min(places.get(k, at), at)
        links |= {(a, b) for a, b in itertools.pairwise(keys) if a != b}
    order = {k: i for i, k in enumerate(sorted(places, key=lambda k: (k[1], -k[0])))}
    near = {i: set() for i in order.values()}
    for a, b in links:
        near[order[a]].add(order[b])
        near[order[b]].add(order[a])
    return {i: places[k] for k, i in order.items()}, near


def around(near, node, hops):
    seen, ring = {node}, {node}
    for _ in range(hops):
        ring = {m for n in ring for m in near[n]} - seen
        seen |= ring
    return seen


def inside(at, p):
    low, edge = 41.0 - p.region / 111111.0, p.margin / 111111.0
    return low + edge < at[0] < 41.0 - edge and -71.0 + edge / COS < at[1] < -71.0 + (p.region - p.margin) / 111111.0 / COS


def points_of(nodes, near, p):
    done, cells, covered, out = set(), set(), set(), []

    def offer(n, tip=False):
        cell = tuple(int(v * 111111.0 / p.cell) for v in nodes[n])
        if inside(nodes[n], p) and (n not in covered or tip) and cell not in cells:
            cells.add(cell)
            out.append(n)
            covered.update(around(near, n, p.cover))

    for n in sorted(nodes):
        if len(near[n]) == 2:
            continue
        for first in sorted(near[n]):
            if first in done:
                continue
            run = [n, first]
            while len(near[run[-1]]) == 2:
                run.append(next(m for m in near[run[-1]] if m != run[-2]))
            if len(run) > p.chain:
                k = int(len(run) / p.spacing) + 1
                for i in range(1, k):
                    offer(run[int(len(run) * (i / k))])
            done.update(run)
        offer(n, len(near[n]) == 1)
    return out


def distances(nodes, near, source):
    best, heap = {}, [(0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for m in near[n]:
                heapq.heappush(heap, (d + int(metres(nodes[n], nodes[m]) * 100), m))
    return best


def twin(a, b, p):
    """Count and score of one way, scanned in order."""
    (na, ea), (nb, eb) = dense(a), dense(b)
    cps = points_of(na, ea, p)
    taken, to = set(), {}
    for c in cps:
        ranked = sorted(nb, key=lambda n: (math.hypot(nb[n][0] - na[c][0], nb[n][1] - na[c][1]), n))[:10]
        for n in ranked:
            if n not in taken and metres(nb[n], na[c]) < p.match:
                to[c] = n
                taken |= around(eb, n, p.hops)
                break
    da = {c: distances(na, ea, c) for c in to}
    db = {n: distances(nb, eb, n) for n in to.values()}
    errs = []
    for c, d in itertools.combinations(sorted(cps), 2):
        if c not in to or d not in to:
            errs.append(1.0)
        elif (d1 := da[c].get(d, -100) / 100) > p.least:
            errs.append(min(1.0, abs(d1 - max(db[to[c]].get(to[d], -100) / 100, 0)) / d1))
    return len(errs), 1 - sum(errs) / len(errs) if errs else None


def by_image(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image_id"], []).append((r["x1"], r["y1"], r["x2"], r["y2"]))
    return out


def test_path_score_equals_a_scan(spark):
    t, q = iterate.cut(table(spark, SF, "fx_edge_gt")), iterate.cut(table(spark, SF, "fx_edge_pred"))
    a, b = by_image(t), by_image(q)
    for p in (metrics.PathParams(), metrics.PathParams(hops=3, match=35.0, margin=60.0, region=400.0, least=15.0)):
        got = {r["image_id"]: (r["n"], r["score"]) for r in metrics.one_way(t, q, p).collect()}
        for i in a:
            n, s = twin(a[i], b.get(i, []), p)
            assert got[i][0] == n and (s is None and got[i][1] is None or abs(got[i][1] - s) < 1e-9), (i, got[i], n, s)


def test_two_roads_of_which_one_is_missing(spark):
    e = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "image_id long, x1 int, y1 int, x2 int, y2 int")
    road, other = (100, 100, 110, 100), (400, 400, 410, 400)
    got = metrics.apls(e([road]), e([road, other])).collect()[0]
    # four ends make six pairs: five have an unmatched end, one path is too short to count
    assert got["truth_to_pred"] == 0.0 and got["pred_to_truth"] is None and got["apls"] is None
    assert metrics.apls(e([road, other]).limit(0), e([road]).limit(0)).count() == 0


def test_long_lines_are_walked_to_the_end(spark):
    n = 3000
    line = spark.range(n).selectExpr("1L image_id", "id a", "id + 1 b", "1L w")
    r = iterate.runs(line).collect()
    assert len(r) == n and {(x["pos"], x["a"]) for x in r} == {(i, i) for i in range(n)}
    short = line.where("a < 60")
    far = {x["node"]: x["dist"] for x in iterate.shortest_paths(short, short.selectExpr("image_id", "0L source").distinct()).collect()}
    assert far == {i: i for i in range(61)}
    comp = iterate.components(line.union(spark.range(5000, 5003).selectExpr("1L", "id", "id", "1L"))).collect()
    assert {x["component"] for x in comp} == {0, 5000, 5001, 5002} and len(comp) == n + 4


def test_simplify_keeps_every_road(spark):
    r = random.Random(3)
    pts = [(i * 7, 200 + r.randint(-60, 60)) for i in range(60)]
    rows = [(1, *p, *q) for p, q in itertools.pairwise(pts)]
    e = spark.createDataFrame(rows, "image_id long, x1 int, y1 int, x2 int, y2 int")

    def rdp(c):
        (ax, ay), (bx, by) = c[0], c[-1]
        n = math.hypot(bx - ax, by - ay)
        d = [math.hypot(x - ax, y - ay) if n == 0 else abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / n for x, y in c[1:-1]]
        if not d or max(d) <= 3:
            return [c[0], c[-1]]
        k = d.index(max(d)) + 1
        return rdp(c[: k + 1])[:-1] + rdp(c[k:])

    want = rdp(pts)
    got = {tuple(x)[1:] for x in graph.simplify(e, 3.0, raster=False).collect()}
    assert got == {(*min(p, q), *max(p, q)) for p, q in itertools.pairwise(want)}
    drawn = graph.simplify(e, 3.0).collect()
    assert 0.5 * len(want) < len(drawn) and {(x["x1"], x["y1"]) for x in drawn} >= {pts[0]}


def test_greedy_hand_over_and_long_chain(spark):
    n = 300
    items = spark.range(n).selectExpr("1 image_id", "id")
    chain = spark.range(n - 1).selectExpr("1 image_id", "id a", "id + 1 b")
    for most, region in ((30, lambda c: F.floor(c / 10)), (100, None)):
        got = iterate.ordered_greedy(items.where("id < 40"), chain.where("b < 40"), most=most, region=region).collect()
        assert {x["id"]: x["taken"] for x in got} == {i: i % 2 == 0 for i in range(40)}
    got = iterate.ordered_greedy(items, chain).collect()
    assert {x["id"]: x["taken"] for x in got} == {i: i % 2 == 0 for i in range(n)}


def test_key_paths_equal_plain_search(spark):
    t = iterate.cut(table(spark, SF, "fx_edge_gt").where("image_id = 1"))
    g = metrics._Dense(t)
    nodes, near = dense(by_image(t)[1])
    keys = random.Random(1).sample(sorted(nodes), 12)
    pairs = spark.createDataFrame([(1, a, b) for a in keys for b in keys], "image_id long, source long, node long")
    got = {(x["source"], x["node"]): x["dist"] for x in metrics.key_paths(g.nodes, g.runs, pairs).collect()}
    for a in keys:
        d = distances(nodes, near, a)
        assert all(got[a, b] == d.get(b, -1) for b in keys)


def test_paths_by_group_falls_back_for_large_graphs(spark):
    e = spark.createDataFrame([(1, i, i + 1, 5) for i in range(9)] + [(2, 1, 2, 7)], "image_id long, a long, b long, w long")
    pairs = spark.createDataFrame([(1, 0, 9), (1, 3, 4), (1, 4, 3), (2, 1, 2)], "image_id long, source long, node long")
    for most in (1, 500):
        got = {tuple(x) for x in iterate.paths_by_group(e, pairs, most=most).collect()}
        assert got == {(1, 0, 9, 45), (1, 3, 4, 5), (2, 1, 2, 7)}


def test_bounds_use_the_anchor(spark):
    row = spark.range(1).select(geo.in_bounds(*(v for v in geo.rowcol_to_latlon(20, 20)), 100, 20).alias("edge"), geo.in_bounds(*(v for v in geo.rowcol_to_latlon(21, 21)), 100, 20).alias("in")).first()
    assert not row["edge"] and row["in"]


def scanned(n, conflicts):
    taken, before = {}, {}
    for a, b in conflicts:
        if a != b:
            before.setdefault(b, set()).add(a)
    for i in range(n):
        taken[i] = not any(taken[a] for a in before.get(i, ()))
    return taken


def test_scans_of_1000_random_conflict_graphs(spark):
    r = random.Random(5)
    graphs = {}
    for k in range(1000):
        n = r.randint(1, 40)
        graphs[k] = n, [tuple(sorted((r.randrange(n), r.randrange(n)))) for _ in range(r.randint(0, 3 * n))]
    items = spark.createDataFrame([(k, i) for k, (n, _) in graphs.items() for i in range(n)], "image_id long, id long")
    conflicts = spark.createDataFrame([(k, a, b) for k, (_, c) in graphs.items() for a, b in c], "image_id long, a long, b long")
    for how in ({}, {"most": 15}, {"most": 10, "region": lambda c: F.floor(c / 7)}):
        some = F.col("image_id") < (200 if how else 1000)
        got = {}
        for x in iterate.ordered_greedy(items.where(some), conflicts.where(some), **how).collect():
            got.setdefault(x["image_id"], {})[x["id"]] = x["taken"]
        assert got == {k: scanned(*v) for k, v in graphs.items() if k in got} and len(got) == (200 if how else 1000)
    named = F.struct((F.col("id") % 5).alias("y"), F.col("id").alias("x"))
    end = lambda c: F.struct((F.col(c) % 5).alias("y"), F.col(c).alias("x")).alias(c)
    few = iterate.ordered_greedy(items.where("image_id < 50").select("image_id", named.alias("id")), conflicts.where("image_id < 50").select("image_id", end("a"), end("b")), most=15, region=lambda c: c["y"])
    assert all(x["taken"] == scanned(*graphs[x["image_id"]])[x["id"]["x"]] for x in few.collect())


def test_circles_of_conflicts_are_an_error(spark):
    items = spark.range(3).selectExpr("1L image_id", "id")
    circle = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0)], "image_id long, a long, b long")
    with pytest.raises(ValueError, match="circle"):
        iterate.ordered_greedy(items, circle, most=1).collect()


def test_groups_at_once_equal_rounds(spark):
    r = random.Random(2)
    rows = {(k, *sorted((r.randrange(n), r.randrange(n)))) for k in range(60) for n in [r.randint(2, 25)] for _ in range(r.randint(1, 30))}
    rows |= {(99, i, (i + 1) % 6) for i in range(6)} | {(98, 3, 3)}
    e = spark.createDataFrame(sorted(rows), "image_id long, a long, b long")
    placed = e.select("image_id", *(F.struct((F.col(c) % 4).cast("int").alias("x"), F.col(c).alias("y")).alias(c) for c in "ab"))
    for t in (e, placed):
        for f in (iterate.components, iterate.runs):
            one, more = f(t), f(t, most=4)
            cols = one.columns
            assert sorted(map(str, one.collect())) == sorted(map(str, more.select(*cols).collect()))
        whole = iterate.components(t)
        place = (lambda c: c["y"] % 5) if t is placed else (lambda c: c % 5)
        assert sorted(map(str, whole.collect())) == sorted(map(str, iterate.components(t, most=4, region=place).collect()))
    source = e.select("image_id", F.col("a").alias("source"))
    near = {tuple(x) for x in iterate.within_hops(e, source, 3).collect()}
    assert near == {tuple(x) for x in iterate.within_hops(e, source, 3, most=4).collect()}


def test_quad_cells_hold_what_they_may(spark):
    r = random.Random(4)
    pts = [(g, i, r.gauss(0, 30), r.gauss(0, 1)) for g in (1, 2) for i in range(400 * g)] + [(3, i, 5.0, 5.0) for i in range(50)] + [(4, 0, -7.5, 2.0)]
    df = spark.createDataFrame(pts, "image_id long, id long, x double, y double")
    got = regions.quad_cells(df, 0.5, 40).collect()
    assert sorted((x["image_id"], x["id"]) for x in got) == sorted((p[0], p[1]) for p in pts)
    cells = {}
    for x in got:
        cells.setdefault((x["image_id"], x["_cell"]), []).append((x["x"], x["y"]))
    for (_, c), inside in cells.items():
        assert len(inside) <= 40 or c["k"] == 0
        if c["k"] < 24:
            side = 0.5 * 2 ** c["k"]
            assert all((math.floor(x / side), math.floor(y / side)) == (c["cx"], c["cy"]) for x, y in inside)


def test_overlay_of_a_grid_with_one_way_links(spark):
    n, r = 200, random.Random(6)
    edges = []
    for i in range(n):
        for j in range(n):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < n and b < n:
                    u, v, w = i * n + j, a * n + b, r.randint(1, 9)
                    way = r.random()
                    edges += [(1, u, v, w)] * (way < 0.8) + [(1, v, u, w)] * (way > 0.2)
    near = {}
    for _, a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    sources, targets = r.sample(range(n * n), 6), r.sample(range(n * n), 12)
    want = {}
    for s in sources:
        best, heap = {}, [(0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if x not in best:
                best[x] = d
                for m, w in near.get(x, ()):
                    heapq.heappush(heap, (d + w, m))
        want |= {(s, t): best[t] for t in targets if t in best}
    e = spark.createDataFrame(edges, "image_id long, a long, b long, w long").repartition(4)
    pairs = spark.createDataFrame([(1, s, t) for s in sources for t in targets], "image_id long, source long, node long")
    places = spark.range(n * n).selectExpr("1L image_id", "id node", f"double(id % {n}) x", f"double(id div {n}) y")
    over = iterate.overlay(e, pairs, places, 1.0, 6000)
    assert over.agg(F.count_distinct("a")).first()[0] < n * n / 5
    got = {(x["source"], x["node"]): x["dist"] for x in iterate.paths_by_group(e, pairs, most=140_000, places=places, per_cell=6000).collect()}
    assert got == want


def test_distance_rows_of_large_groups(spark):
    e = spark.createDataFrame([(1, i, i + 1, 5) for i in range(9)] + [(1, 9, 0, 2), (2, 1, 2, 7)], "image_id long, a long, b long, w long")
    points = spark.createDataFrame([(1, 0, 0), (1, 1, 4), (1, 2, 9), (2, 0, 1), (2, 1, 2), (3, 0, 8)], "image_id long, idx long, node long")
    places = spark.range(10).selectExpr("1L image_id", "id node", "double(id) x", "0.0D y")
    for how in ({}, {"most": 3}, {"most": 3, "places": places, "per_cell": 3}):
        got = {(x["image_id"], x["idx"]): x["dists"] for x in iterate.distance_rows(e, points, **how).collect()}
        assert got[1, 0] == [0, 20, 45] and got[1, 1] == [27, 0, 25] and got[1, 2] == [2, 22, 0] and got[2, 0] == [0, 7] and got[2, 1] == [-1, 0]
