"""Directions, linking, losses and sources against sequential twins and hand rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.operators import directions, graph, jobs, losses, matching, raster
from waymesh.sources import io
from waymesh.sources.fixtures import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dirs(spark):
    d = directions.with_vectors(table(spark, SF, "fx_direction").withColumnRenamed("dir_idx", "slot")).where("patch_id < 12")
    by = {}
    for r in d.orderBy("patch_id", "kp_seq", "slot").collect():
        by.setdefault(r["patch_id"], []).append(r)
    return d, by


def line(p, o, d):
    """Distance of p to the ray from o, 10000 behind it."""
    c = (p[0] - o[0], p[1] - o[1])
    return 10000.0 if c[0] * d[0] + c[1] * d[1] < 0 else abs(c[0] * d[1] - c[1] * d[0])


def angle(u, v):
    n = max(math.hypot(*u) * math.hypot(*v), 1e-8)
    return math.degrees(math.acos(max(-1, min(1, (u[0] * v[0] + u[1] * v[1]) / n))))


def lerp(d, a, b, x, y):
    return x if d <= a else y if d >= b else x + (d - a) / (b - a) * (y - x)


def sums(r, s):
    p, q, a, b = (r["x"], r["y"]), (s["x"], s["y"]), (r["cos"], r["sin"]), (s["cos"], s["sin"])
    u = (q[0] - p[0], q[1] - p[1])
    return math.hypot(*u), angle(u, a) + angle((-u[0], -u[1]), b), line(q, p, a) + line(p, q, b)


def costs(rows):
    """Cost of each pair of directions of different keypoints that may be linked."""
    out = {}
    for r, s in itertools.combinations(rows, 2):
        d, ang, lin = sums(r, s)
        if r["kp_seq"] != s["kp_seq"] and d > 0 and (s["deg"] // 60 - r["deg"] // 60) % 6 in (2, 3, 4):
            if ang < lerp(d, 0, 448, 44.99, 45) and lin < lerp(d, 0, 448, 70, 140):
                out[(r["kp_seq"], r["slot"]), (s["kp_seq"], s["slot"])] = round(lin * lerp(d, 0, 448, 0, 1), 9)
    return out


def test_greedy_links(dirs):
    d, by = dirs
    got = {}
    for x in matching.link_greedy(matching.pair_costs(d)).collect():
        got.setdefault(x["patch_id"], set()).add(((x["i"], x["si"]), (x["j"], x["sj"])))
    found = 0
    for p, rows in by.items():
        used, want = set(), set()
        for (a, b), _ in sorted(costs(rows).items(), key=lambda t: (t[1], t[0])):
            if a not in used and b not in used:
                want.add((a, b))
                used |= {a, b}
        assert got.get(p, set()) == want
        found += len(want)
    assert found > 10


def test_closest_links(dirs):
    d, by = dirs
    got = {}
    for x in matching.link_closest(matching.line_costs(d)).collect():
        got.setdefault(x["patch_id"], set()).add(((x["i"], x["si"]), (x["j"], x["sj"])))
    for p, rows in by.items():
        kps = {r["kp_seq"]: [s for s in rows if s["kp_seq"] == r["kp_seq"]] for r in rows}
        used, want = set(), set()
        apart = {(i, j): math.hypot(kps[i][0]["x"] - kps[j][0]["x"], kps[i][0]["y"] - kps[j][0]["y"]) for i, j in itertools.combinations(sorted(kps), 2)}
        for (i, j), dist in sorted(apart.items(), key=lambda t: (t[1], t[0])):
            limit = lerp(dist, 30, 448, 50, 140)
            free = [(round(sums(r, s)[2], 9), r["slot"], s["slot"]) for r in kps[i] for s in kps[j] if (i, r["slot"]) not in used and (j, s["slot"]) not in used and sums(r, s)[2] <= limit]
            if free:
                _, a, b = min(free)
                want.add(((i, a), (j, b)))
                used |= {(i, a), (j, b)}
        assert got.get(p, set()) == want


def test_assigned_links_cost_least(dirs):
    d, by = dirs
    got = {}
    for x in matching.link_assign(matching.pair_costs(d)).collect():
        got.setdefault(x["patch_id"], {})[x["a"], x["b"]] = x["cost"]
    for p, rows in by.items():
        c = costs(rows)
        ids = sorted({k[0] * 6 + k[1] for pair in c for k in pair})
        if not ids:
            assert p not in got
            continue
        m = np.full((len(ids), len(ids)), 1000.0)
        for (a, b), v in c.items():
            i, j = ids.index(a[0] * 6 + a[1]), ids.index(b[0] * 6 + b[1])
            m[i, j] = m[j, i] = v
        best = matching.assignment(m)
        total = m[np.arange(len(ids)), best].sum()
        mine = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in enumerate(best) if m[i, j] < 500}
        assert total < 1000 * len(ids)
        assert set(got[p]) == mine or abs(sum(got[p].values()) - sum(m[ids.index(a), ids.index(b)] for a, b in mine)) < 1e-6


def cleaned(slots, degrees):
    """Probabilities after one pass, slot by slot."""
    live = [i for i, s in enumerate(slots) if s[0] > 0]
    norm = lambda s: math.sqrt(sum(v * v for v in s))
    done, groups = set(), []
    for i in live:
        mine = [i] + [j for j in live if j != i and j not in done and sum(a * b for a, b in zip(slots[i], slots[j], strict=True)) / (norm(slots[i]) * norm(slots[j])) >= math.cos(math.radians(degrees))]
        done |= set(mine)
        groups.append(mine)
    probs = [s[0] for s in slots]
    for g in groups:
        best = max(g, key=lambda j: (probs[j], -g.index(j)))
        for j in g:
            probs[j] = probs[j] if j == best else 0.0
    return probs


def test_cleaning_keeps_the_likeliest(spark):
    r = random.Random(5)
    rows = []
    for k in range(80):
        slots = []
        for _ in range(r.choice([0, 1, 6])):
            a = math.radians(r.choice([0, 10, 20, 40, 180, 190, 300]))
            slots.append((r.choice([0.0, 0.4, 0.6, 0.6, 0.9]), math.sin(a), math.cos(a)))
        rows.append((k, slots, r.choice([5, 100]), 100))
    kind = "array<struct<prob:double,sin:double,cos:double>>"
    d = spark.createDataFrame(rows, f"k int, a {kind}, x int, y int")
    got = d.select("k", directions.clean(F.col("a"), 30.0).alias("c"), directions.clean_border(F.col("a"), F.col("x"), F.col("y"), 200, 200, 30.0).alias("b")).collect()
    for x in got:
        _, slots, at, _ = rows[x["k"]]
        want = cleaned(slots, 30.0)
        assert [s["prob"] for s in x["c"]] == want
        assert [s["prob"] for s in x["b"]] == (want if at == 5 else [s[0] for s in slots])
        assert [(s["sin"], s["cos"]) for s in x["c"]] == [s[1:] for s in slots]


def test_allocation_of_more_than_six(spark):
    r = random.Random(2)
    rows = [(k, i, a) for k in range(12) for i, a in enumerate(r.sample(range(360), 7 + k % 2))] + [(99, i, a) for i, a in enumerate([330, 10, 60, 110, 170, 230, 290])]
    got = {}
    for x in directions.allocate(spark.createDataFrame(rows, "k int, dir_idx int, deg int"), ["k"]).collect():
        got.setdefault(x["k"], []).append((x["sector"], x["deg"]))
    for k in {x[0] for x in rows}:
        a = sorted(x[2] for x in rows if x[0] == k)
        best = min(sum(abs(v - (60 * i + 30)) for i, v in enumerate(c)) for c in itertools.combinations(a, 6))
        assert len(got[k]) == 6 and sum(abs(v - (60 * s + 30)) for s, v in got[k]) == best
    assert 330 in dict((v, s) for s, v in got[99])


def test_augmented_directions_turn_with_their_patch(spark):
    rows = [(p, 0, 10, 20, 0, 45) for p in range(40)]
    d = spark.createDataFrame(rows, "patch_id int, kp_seq int, x int, y int, dir_idx int, deg int")
    keys = ["patch_id", "kp_seq"]
    turned = directions.random_rotate(d, keys, ["patch_id"], 100, 1).collect()
    assert {(x["x"], x["y"], x["deg"]) for x in turned} == {(10, 20, 45), (79, 10, 135), (89, 79, 225), (20, 89, 315)}
    mirrored = directions.random_flip(d, keys, ["patch_id"], 100, 100, 1).collect()
    assert {(x["x"], x["y"], x["deg"]) for x in mirrored} == {(10, 20, 45), (89, 20, 135), (10, 79, 315), (89, 79, 225)}
    assert len(turned) == len(mirrored) == 40


def test_losses_of_hand_rows(spark):
    rows = [("s", "loc", 0.0, 0.0, 0.0, 1), ("s", "loc", 2.0, 1.0, 1.0, 1), ("s", "prob", 0.0, 1.0, 0.0, 1), ("s", "vec", 3.0, 0.0, 0.0, 1), ("s", "vec", 5.0, 0.0, 1.0, 0), ("s", "vec", 1.0, 0.0, 1.0, 1)]
    d = spark.createDataFrame(rows, "g string, part string, pred double, gt double, w double, valid int")
    got = losses.detector(d, "g", ("mse", "mse", "mse"), channels=(1, 1, 1)).first()
    # zero weights count as 0.002 but in the vector part, where they count nothing
    assert abs(got["loss_loc"] - 1.0 / 1.002) < 1e-12 and abs(got["loss_prob"] - 1.0) < 1e-12 and abs(got["loss_vec"] - 1.0) < 1e-12
    big = spark.createDataFrame([("s", 1000.0, 0.0, 1.0, 1)], "g string, pred double, gt double, w double, valid int")
    assert losses.mse(big, "g").first()["loss"] == 100.0 and losses.bce(big, "g", "sum").first()["loss"] < 19
    p = 1 / (1 + math.exp(-0.3))
    one = spark.createDataFrame([("s", 0.3, 0.5, 2.0, 1), ("s", 0.3, 0.5, 4.0, 0)], "g string, pred double, gt double, w double, valid int")
    t = 0.5 - 0.001
    row = -((1 - p) ** 2 * t**4 * math.log(p) + p**2 * (1 - t) ** 4 * math.log(1 - p))
    assert abs(losses.focal(one, "g").first()["loss"] - row) < 1e-12
    assert abs(losses.focal(one, "g", "none").first()["loss"] - row) < 1e-12
    assert abs(losses.focal(one, "g", weight=None, valid=None).first()["loss"] - 10 * row) < 1e-12
    assert abs(losses.dice(one, "g").first()["loss"] - (1 - 2 * p / (1 + 2 * p))) < 1e-12


def test_forest_redirects_children_only(spark):
    rows = [(0, 0, 0, 1.0, 1.0, None, None, 0), (0, 1, 0, 2.0, 1.0, 1, 0, 0), (0, 2, 1, 3.0, 1.0, None, None, 1), (1, 0, 0, 9.0, 9.0, None, None, 0), (1, 1, 0, 50.0, 9.0, None, None, 0)]
    f = spark.createDataFrame(rows, "tree_id int, id int, parent int, lat double, lon double, sim_tree int, sim_id int, out_region int")
    edges, ends = io.forest_edges(f, (0, 0, 10, 10))
    got = {((x["n1"]["t"], x["n1"]["i"]), (x["n2"]["t"], x["n2"]["i"])): (x["lat1"], x["lat2"]) for x in edges.collect()}
    # the parent of (0, 2) is the tree's own node 1, though that stands for (1, 0) as a child
    assert got == {((0, 0), (0, 0)): (1.0, 1.0), ((0, 0), (1, 0)): (1.0, 9.0), ((0, 1), (0, 2)): (2.0, 3.0), ((1, 0), (1, 0)): (9.0, 9.0)}
    assert [(x["node"]["t"], x["node"]["i"]) for x in ends.collect()] == [(0, 1)]


def test_roads_of_several_images_stay_apart(spark):
    rows = [(i, 0, s, 100 * i + 10 * s, 5) for i in (1, 2) for s in (0, 1)]
    got = graph.edges_from_vertices(spark.createDataFrame(rows, "image_id int, road_id int, seq int, x int, y int")).collect()
    assert {(x["image_id"], x["x1"], x["x2"]) for x in got} == {(1, 100, 110), (2, 200, 210)}


def test_lines_that_are_no_numbers(spark):
    d = spark.createDataFrame([("0.1 0.2 0.123456789012",), ("a b 1e-7",), ("1 2 NaN",), ("1 2 x",), ("",)], "s string")
    got = [r[0] for r in d.select(io.parse_path_line(F.col("s"))).collect()]
    assert got[:2] == [0.123456789012, 1e-7] and math.isnan(got[2]) and got[3:] == [None, None]
    p, r = io.parse_topology_line(F.lit("precision=1e-3 recall=bad"))
    assert tuple(d.limit(1).select(p, r).first()) == (0.001, 0.0)


def test_raster_tiles(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    np.save(tmp_path / "a.npy", a)
    got = io.read_tiles(spark, f"file://{tmp_path}/*.npy").collect()
    assert {(x["row_"], x["col_"]): (x["band0"], x["band1"], x["band2"]) for x in got} == {(i, j): tuple(a[i, j]) for i in range(2) for j in range(4)}
    np.save(tmp_path / "b.npy", np.zeros((2, 2, 5)))
    with pytest.raises(Exception, match="shape"):
        io.read_tiles(spark, f"file://{tmp_path}/*.npy").collect()


def test_border_ends_move_apart(spark):
    rows = [(1, 3, 10, 60, 60), (1, 5, 14, 60, 90), (1, 200, 200, 220, 220)]
    e = spark.createDataFrame(rows, "image_id int, x1 int, y1 int, x2 int, y2 int")
    got = graph.separate_border_ends(e, 300, 300, 20, 12, 1).collect()
    ends = [(x["x1"], x["y1"]) for x in got if (x["x2"], x["y2"]) in ((60, 60), (60, 90))]
    assert len(got) == 3 and 12 <= math.dist(*ends) <= 21.6 and all(x >= 0 and y >= 0 for x, y in ends)
    assert graph.separate_border_ends(e, 300, 300, 20, 12, 1).collect() == got
    alone = e.where("x1 = 200")
    assert graph.separate_border_ends(alone, 300, 300, 20, 12).collect() == alone.collect()


def test_rings_are_halved(spark):
    ring = [(10, 0, 20, 0), (20, 0, 20, 10), (10, 10, 20, 10), (10, 0, 10, 10)]
    e = spark.createDataFrame([(1, *r) for r in [*ring, (20, 10, 40, 10)]], "image_id int, x1 int, y1 int, x2 int, y2 int")
    got = sorted((x["half"], x["pos"], x["x"], x["y"]) for x in graph.ring_halves(e).collect())
    assert [g[1] for g in got] == [0, 1, 2, 2, 3, 4] and got[0][2:] == got[-1][2:] == (20, 10) and got[2][2:] == got[3][2:] == (10, 0)


def test_patch_cells_cover_as_rectangles_do(spark):
    for w, h, crop, overlap in ((50, 40, 16, 6), (16, 16, 16, 4), (33, 20, 12, 0)):
        px = spark.range(w * h).selectExpr("1L image_id", f"cast(id / {w} as int) row_", f"cast(id % {w} as int) col_")
        got = raster.assign_patches(px, w, h, crop, overlap).select("row_", "col_", "patch_seq").collect()
        grid = raster.patches(spark, w, h, crop, overlap).collect()
        want = {(r, c, g["patch_seq"]) for g in grid for r in range(g["top"], g["bottom"]) for c in range(g["left"], g["right"])}
        assert {tuple(x) for x in got} == want and len(got) == len(want)
        own = {(x["row_"], x["col_"]): x["patch_seq"] for x in raster.ownership(px, w, h, crop, overlap).collect()}
        rects = {r["patch_seq"]: r for r in raster.valid_rects(spark, w, h, crop, overlap).collect()}
        assert len(own) == w * h
        for (r, c), p in own.items():
            q = rects[p]
            assert q["left"] <= c - q["x0"] <= q["right"] and q["top"] <= r - q["y0"] <= q["bottom"]


def test_stitching_joins_a_road_over_a_seam(spark):
    # one straight road through both patches of an image: keypoints at its ends and in the overlap
    at = {0: [(20, 60), (90, 60)], 1: [(10, 60), (100, 60)]}
    rows = []
    for p, pts in at.items():
        for x, y in pts:
            left, right = (0.9, 0.0, -1.0), (0.9, 0.0, 1.0)
            dirs = [right] if (p, x) == (0, 20) else [left] if (p, x) == (1, 100) else [left, right]
            rows.append((1, p, y, x, 0.9, dirs))
    heat = spark.createDataFrame(rows, f"image_id long, patch_seq int, row_ int, col_ int, loc double, dirs {jobs.DIRS}")
    got = jobs.stitch(heat, 208, 128, 128, 48, logits=False, least=20)
    assert [tuple(x) for x in got.collect()] == [(1, 20, 60, 180, 60)]
    thin = [(1, 0, 60, c) for c in range(20, 128)] + [(1, 1, 60, c) for c in range(0, 101)]
    px = spark.createDataFrame(thin, "image_id long, patch_seq int, row_ int, col_ int")
    line = jobs.stitch_centrelines(px, 208, 128, 128, 48).collect()
    assert line and min(x["x1"] for x in line) == 20 and max(x["x2"] for x in line) == 180


def test_datasets(spark):
    v = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 0, 1, 50, 0), (1, 0, 2, 100, 1), (2, 0, 0, 5, 5), (2, 0, 1, 9, 9)], "image_id long, road_id int, seq int, x int, y int")
    records, lone = jobs.image_dataset(v, spark.createDataFrame([(1,), (3,)], "image_id long"))
    got = {(r["x"], r["y"]): r["flat"] for r in records.collect()}
    assert set(got) == {(0, 0), (100, 1)} and {(x["image_id"], x["side"]) for x in lone.collect()} == {(3, "pred"), (2, "truth")}
    assert all(sum(x is not None for x in f) == 2 for f in got.values())
    e = graph.edges_from_vertices(v.where("image_id = 1"))
    px = spark.range(128 * 64).selectExpr("1L image_id", "cast(id / 128 as int) row_", "cast(id % 128 as int) col_", "if(id % 128 < 60, 5, 9) b", "5 g", "5 r")
    records, mask = jobs.cropped_dataset(e, px, 128, 64, 64)
    assert {r["tile"] for r in records.collect()} == {1} and mask.where("x < 0 or x > 63").count() == 0 < mask.count()
    kp = spark.createDataFrame([(1, 0, 0, 30)], "patch_id int, kp_seq int, x int, y int")
    d = spark.createDataFrame([(1, 0, 0, 90)], "patch_id int, kp_seq int, dir_idx int, deg int")
    out = jobs.training_samples(kp, d, [1, 2, 3], 64, 1, 5).collect()
    assert {x["patch"]["epoch"] for x in out} == {1, 2, 3} and max(x["loc"] for x in out) == 1.0 and len(out) == 3 * 9 * 6


def test_skeleton_keypoints(spark):
    dirs = [(0.9, 3.0, 4.0), (0.1, 0.0, 1.0)]
    rows = [(1, 0, c, 0.6, dirs) for c in range(12)] + [(1, 9, 9, 0.7, dirs), (1, 9, 10, 0.8, dirs)]
    px = spark.createDataFrame(rows, f"image_id long, row_ int, col_ int, loc double, dirs {jobs.DIRS}")
    kp, road = jobs.skeleton_keypoints(px)
    got = {(x["x"], x["y"]): x["dirs"] for x in kp.collect()}
    assert set(got) == {(0, 0), (11, 0), (10, 9)} and road.count() == 12
    assert tuple(got[0, 0][0]) == (0.9, 0.6, 0.8) and tuple(got[0, 0][1]) == (0.0, 0.0, 0.0)


def test_streams(spark, tmp_path):
    from waymesh.streaming.scores import current_scores, keep_running, latest_scores, score_on_arrival

    s = spark.createDataFrame([(1, 0.5), (1, float("nan")), (2, 1.0), (1, 1.0), (2, 0.0)], "run_id int, apls double")
    e = spark.createDataFrame([(i % 4, i, i + 1) for i in range(20)] + [(9, 0, 0)], "image_id int, a int, b int")
    metric = lambda t: t.where("image_id < 9").groupBy("image_id").agg(F.count("*").alias("n"))
    for parts in (1, 5):  # the same in one micro-batch and in five
        home = f"file://{tmp_path}/{parts}"
        s.repartition(parts).write.parquet(f"{home}/s")
        e.repartition(parts).write.parquet(f"{home}/e")
        stream = lambda name, like: spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/{name}")  # noqa: E731, B023
        keep_running(stream("s", s), f"{home}/out", f"{home}/log1").awaitTermination()
        assert {x["run_id"]: (x["n"], x["mean"]) for x in current_scores(spark, f"{home}/out").collect()} == {1: (2, 0.75), 2: (2, 0.5)}
        score_on_arrival(stream("e", e), metric, f"{home}/scored", f"{home}/log2").awaitTermination()
        assert {x["image_id"]: x["n"] for x in latest_scores(spark, f"{home}/scored").collect()} == {0: 5, 1: 5, 2: 5, 3: 5, 9: None}
        # nothing new: nothing is scored again
        e.where("a = 3").write.mode("append").parquet(f"{home}/e")
        before = spark.read.parquet(f"{home}/scored/scores").count()
        score_on_arrival(stream("e", e), metric, f"{home}/scored", f"{home}/log2").awaitTermination()
        assert spark.read.parquet(f"{home}/scored/scores").count() == before
        # a late edge after a restart: its image alone is scored again, with all that came before
        spark.createDataFrame([(2, 77, 78)], e.schema).write.mode("append").parquet(f"{home}/e")
        score_on_arrival(stream("e", e), metric, f"{home}/scored", f"{home}/log2").awaitTermination()
        assert spark.read.parquet(f"{home}/scored/scores").count() == before + 1
        assert {x["image_id"]: x["n"] for x in latest_scores(spark, f"{home}/scored").collect()}[2] == 6
    # with truth: edges found among those that stay
    truth = e.where("a < 8")
    hits = lambda t, same: t.join(same, ["image_id", "a", "b"]).groupBy("image_id").agg(F.count("*").alias("hits"))
    score_on_arrival(stream("e", e), hits, f"{home}/with", f"{home}/log3", truth).awaitTermination()
    assert {x["image_id"]: x["hits"] for x in latest_scores(spark, f"{home}/with").collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 9: 1}


def test_sinks_hold_each_batch_once(spark, tmp_path):
    one = spark.createDataFrame([("apls", 0.5)], "name string, value double")
    for job in ("a", "b", "a"):
        io.append_summary(one, f"file://{tmp_path}/s", job)
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/s").collect()] == ["apls: 0.5"] * 2

    def broken(x):
        raise RuntimeError("lost half-way")

    scores = spark.createDataFrame([(k % 3, k, k / 10) for k in range(30)], "run_id int, image_id int, apls double")
    path = f"file://{tmp_path}/scores"
    for name, k in (("first", 0), ("second", 1), ("second", 1)):
        io.write_scores(scores.where(F.col("image_id") % 2 == k), path, name)
    before = sorted(tuple(x) for x in spark.read.parquet(path).select("image_id", "batch").collect())
    assert before == sorted((k, ("first", "second")[k % 2]) for k in range(30))
    bad = F.udf(lambda x: broken(x) if x == 28 else x, "double")
    with pytest.raises(Exception, match="lost half-way"):
        io.write_scores(scores.withColumn("apls", bad("image_id")), path, "third")
    assert sorted(tuple(x) for x in spark.read.parquet(path).select("image_id", "batch").collect()) == before
    io.write_scores(scores.withColumn("apls", F.col("apls") + 1), path, "third")
    assert spark.read.parquet(path).count() == 60


def test_tiles_of_two_sizes_are_cleaned_by_their_own(spark):
    r = random.Random(8)
    pts = [(r.randint(0, 199), r.randint(0, 99)) for _ in range(50)]
    e = spark.createDataFrame([(1, *p, *q) for p, q in itertools.pairwise(pts) if p != q], "image_id long, x1 int, y1 int, x2 int, y2 int")
    tiles = [(1, 0, 0, 0, 99, 99), (1, 1, 100, 0, 149, 99)]
    frame = lambda rows: spark.createDataFrame(rows, "image_id long, tile int, left int, top int, right int, bottom int")
    got = {tuple(x) for x in graph.crop(e, frame(tiles), clean=True, merge=6, band=8, d=6).collect()}
    apart = {tuple(x) for t in tiles for x in graph.crop(e, frame([t]), clean=True, merge=6, band=8, d=6).collect()}
    assert got == apart and {x[1] for x in got} == {0, 1}
    assert all(0 <= v < (100, 50)[t] for _, t, x1, _, x2, _ in got for v in (x1, x2))


def test_auction_costs_as_little_as_the_solver(spark):
    r = random.Random(9)
    rows = [(k, a, b, float(r.randint(0, 9))) for k in range(200) for a in range(r.randint(1, 4)) for b in r.sample(range(4), r.randint(1, 3))]
    pairs = spark.createDataFrame(rows, "image_id long, a long, b long, cost double").coalesce(1)
    exact, got, cost = {}, {}, {(k, a, b): c for k, a, b, c in rows}
    for x in matching.component_match(pairs, "image_id", 6.0).collect():
        exact.setdefault(x["image_id"], []).append((x["a"], x["b"]))
    for x in matching.component_match(pairs, "image_id", 6.0, most=0, unit=1.0).collect():
        got.setdefault(x["image_id"], []).append((x["a"], x["b"]))
    for k in range(200):
        mine = got.get(k, [])
        assert len({a for a, _ in mine}) == len({b for _, b in mine}) == len(mine)
        # a row alone costs the filler
        assert sum(cost[k, a, b] - 6.0 for a, b in mine) == sum(cost[k, a, b] - 6.0 for a, b in exact.get(k, []))


def test_large_keys_are_matched_in_rounds(spark):
    r = random.Random(10)
    rows = list({(k % 3, k, r.randrange(7), r.randrange(7)) for k in range(6) for _ in range(12)})
    pairs = spark.createDataFrame(rows, "image_id long, start long, a long, b long")
    sizes = [{(x["image_id"], x["start"]): x["matched"] for x in matching.matching_sizes(pairs, ["image_id", "start"], most=m).collect()} for m in (2_000_000, 11)]
    assert sizes[0] == sizes[1] and len(sizes[0]) == 6
