"""Steps whose tasks must not grow with the table, against plain versions."""

import itertools
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.operators import directions, graph, iterate, jobs, matching, metrics, raster
from waymesh.session import dealt
from waymesh.sources import io


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _run(df):
    """The physical plan of a table that has been read."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_allocation_stays_in_its_row(spark):
    r = random.Random(8)
    rows = [(k, i, r.randrange(360)) for k in range(60) for i in range(k % 7)] + [(99, 0, None), (None, 0, 50)]
    d = spark.createDataFrame(rows, "k int, dir_idx int, deg int")
    out = directions.allocate(d, ["k"])
    assert "Join" not in _plan(out) and _plan(out).count("Aggregate") == 1
    got = {}
    for x in out.collect():
        got.setdefault(x["k"], []).append((x["deg"], x["sector"]))
    want = {}
    for k in {x[0] for x in rows if x[2] is not None}:
        a = sorted(x[2] for x in rows if x[0] == k)
        best = min((sum(abs(v - (60 * s + 30)) for v, s in zip(a, c, strict=True)), c) for c in itertools.combinations(range(6), len(a)))
        want[k] = list(zip(a, best[1], strict=True))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_augmentation_joins_nothing(spark):
    r = random.Random(9)
    rows = [(p, k, 10 * k, 5 * k, i, r.randrange(360)) for p in range(30) for k in range(3) for i in range(1 + (p + k) % 6)]
    d = spark.createDataFrame(rows, "patch_id int, kp_seq int, x int, y int, dir_idx int, deg int")
    keys = ["patch_id", "kp_seq"]
    for mode in ("allocate", "order", "without_order"):
        flipped = directions.random_flip(d, keys, ["patch_id"], 100, 100, 1, mode=mode)
        turned = directions.random_rotate(d, keys, ["patch_id"], 100, 1, mode=mode)
        assert "Join" not in _plan(flipped) and "Union" not in _plan(turned) and turned.count() == flipped.count() == len(rows)
        hit = d.where(directions.draw(1, 4, F.lit("turn"), "patch_id") == 3)
        moved = directions.reslot(directions.rotate(hit, 100, 3), keys, mode).select(*keys, F.col("sector").alias("dir_idx"), "deg")
        got = turned.join(hit.select("patch_id").distinct(), "patch_id").select(*keys, "dir_idx", "deg")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, moved.collect())) != []


def test_pixels_meet_a_keypoint_not_its_slots(spark):
    kp = spark.createDataFrame([(1, 0, 2, 2), (1, 1, 3, 2), (2, 0, 9, 9)], "patch_id long, kp_seq long, x int, y int")
    d = spark.createDataFrame([(1, 0, 1, 0.5, 0.6, 0.8), (1, 0, 3, None, 1.0, 0.0), (2, 5, 0, 1.0, 1.0, 0.0)], "patch_id long, kp_seq long, slot int, prob double, sin double, cos double")
    maps = raster.gaussian_maps(kp, 1, 10, 10)
    out = raster.direction_maps(maps, d, False)
    plan = _plan(out)
    assert plan.index("Generate") < plan.index("Join")  # slots are rows only after the join
    place = {(x["patch_id"], x["row_"], x["col_"]): x["kp_seq"] for x in maps.collect()}
    got = {(x["patch_id"], x["row_"], x["col_"], x["slot"]): (x["prob"], x["sin"], x["cos"]) for x in out.collect()}
    own = {(1, 0, 1): (0.5, 0.6, 0.8), (1, 0, 3): (0.0, 1.0, 0.0)}
    assert got == {(p, r, c, s): own.get((p, k, s), (0.0, 0.0, 0.0)) for (p, r, c), k in place.items() for s in range(6)}


def test_training_samples_are_dealt_once(spark):
    kp = spark.createDataFrame([(p, k, 7 * k + p, 5 * k) for p in range(6) for k in range(4)], "patch_id long, kp_seq long, x int, y int")
    d = spark.createDataFrame([(p, k, i, 60 * i + p) for p in range(6) for k in range(4) for i in range(1 + k)], "patch_id long, kp_seq long, dir_idx int, deg int")
    out = jobs.training_samples(kp, d, [1, 2], 40, 1, 9)
    plan = _run(out)
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len([x for x in shuffles if "patch#" in x]) == 1 and not any("row_" in x for x in shuffles)
    pixels = out.select("patch", "row_", "col_").distinct().count()
    assert out.count() == 6 * pixels and out.where("prob > 0").select("patch").distinct().count() == 12


def test_tasks_of_a_number_of_rows(spark):
    t = spark.range(1000).selectExpr("id", "id % 90 g")
    sizes = dealt(t, 50, "g").select(F.spark_partition_id().alias("p"), "g").groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("g").alias("k")).collect()
    assert dealt(t, 50, "g").rdd.getNumPartitions() == 20 and sum(x["k"] for x in sizes) == 90
    assert dealt(t, 50, "g", of=t.limit(100), each=10).rdd.getNumPartitions() == 20


def test_masks_are_unique_where_they_are_drawn(spark):
    rows = [(1, 250, 250, 262, 262), (1, 250, 250, 262, 250), (1, -3, 2, 4, 2), (2, 255, 0, 256, 600), (None, 5, 5, 9, 5)]
    e = spark.createDataFrame(rows, "image_id long, x1 int, y1 int, x2 int, y2 int")
    out = raster.thick_mask(e, 5.0)
    shuffles = [x for x in _run(out).splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 1 and "_tx" in shuffles[0]
    want = set()
    for g, x1, y1, x2, y2 in rows:
        for x in range(min(x1, x2) - 4, max(x1, x2) + 5):
            for y in range(min(y1, y2) - 4, max(y1, y2) + 5):
                f = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
                if (x - x1 - f * (x2 - x1)) ** 2 + (y - y1 - f * (y2 - y1)) ** 2 <= 2.5**2:
                    want.add((g, x, y))
    got = list(map(tuple, out.collect()))
    assert len(got) == len(set(got)) and set(got) == want
    line = raster.centerline(e)
    assert len([x for x in _run(line).splitlines() if "Exchange hashpartitioning" in x]) == 1
    got = list(map(tuple, line.collect()))
    assert len(got) == len(set(got)) and set(got) >= {(1, 250 + k, 250 + k) for k in range(13)} | {(2, 256, 600), (2, 255, 0), (1, -3, 2), (1, 4, 2)}


def test_pairs_of_keypoints_are_dealt_by_patch(spark):
    r = random.Random(3)
    rows = [(p, k, 3 * k, k * k, s, r.uniform(-1, 1), r.uniform(-1, 1)) for p in range(5) for k in range(6) for s in range(1 + k % 3)]
    d = spark.createDataFrame(rows, "patch_id long, kp_seq long, x int, y int, slot int, sin double, cos double")
    out = matching.designed_distances(d, 100, 100)
    assert "REPARTITION_BY_NUM" in _run(out) and out.count() == 5 * 15


def test_matching_of_whole_groups_and_rounds(spark):
    r = random.Random(5)
    rows = sorted({(g, r.randrange(12), r.randrange(12)) for g in range(4) for _ in range(30)})
    pairs = spark.createDataFrame([*rows, rows[0]], "g int, a long, b long")
    got = [{x["g"]: x["count"] for x in matching.matching_rounds(pairs, "g", most=m).groupBy("g").count().collect()} for m in (1000, 31, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 4
    cost = pairs.selectExpr("*", "cast((a * 7 + b) % 5 as double) cost")
    whole = matching.component_match(cost, "g")
    assert {x["g"]: x["count"] for x in whole.groupBy("g").count().collect()} == got[0]
    # pairs are put in order in their task: the table has no place of each
    assert "_id" not in _plan(matching.select_ascending(cost, "g"))


def test_forest_edges_are_unique_where_their_parent_is(spark):
    f = spark.createDataFrame([(1, 0, 0, 5.0, 5.0, None, None, 0), (1, 1, 0, 6.0, 5.0, 2, 0, 1), (1, 2, 0, 6.5, 5.0, 2, 0, 0), (2, 0, 0, 7.0, 7.0, None, None, 0)], "tree_id long, id long, parent long, lat double, lon double, sim_tree long, sim_id long, out_region int")
    edges, _ = io.forest_edges(f, (0, 0, 10, 10))
    assert not any("t2" in x for x in _run(edges).splitlines() if "Exchange" in x)
    got = sorted((x["n1"]["t"], x["n1"]["i"], x["n2"]["t"], x["n2"]["i"], x["lat2"]) for x in edges.collect())
    assert got == [(1, 0, 1, 0, 5.0), (1, 0, 2, 0, 7.0), (2, 0, 2, 0, 7.0)]


def test_runs_are_simplified_in_their_row(spark, monkeypatch):
    r = random.Random(11)
    at = lambda: (r.randrange(90), r.randrange(90))
    rows = []
    for g in (1, 2, None):
        line = [at() for _ in range(25)]
        ring = [(200, 0), (240, 9), (230, 50), (190, 30), (200, 0)]
        rows += [(g, *p, *q) for p, q in [*itertools.pairwise(line), *itertools.pairwise(ring)]]
    e = graph.canonical(spark.createDataFrame(rows, "image_id long, x1 int, y1 int, x2 int, y2 int"))
    written = []
    own = iterate.cut
    monkeypatch.setattr(iterate, "cut", lambda t: written.append(1) or own(t))
    whole = graph.simplify(e, 3.0)
    assert len(written) <= 3  # no round of tables a level
    for most in (0, 60):  # all runs, or the long ones, by levels
        assert sorted(map(str, graph.simplify(e, 3.0, most=most).collect())) == sorted(map(str, whole.collect())) != []


def test_road_graph_reads_its_edges_once(spark):
    e = spark.createDataFrame([(1, 0, 0, 3, 4), (1, 3, 4, 9, 9), (2, 5, 5, 6, 6)], "image_id long, x1 int, y1 int, x2 int, y2 int")
    nodes, edges = graph.road_graph(e)
    assert nodes.inputFiles() and set(nodes.inputFiles()) == set(edges.inputFiles())  # both come from one written table
    assert sorted(map(tuple, edges.collect())) == [(1, 0, 0, 1), (1, 1, 1, 0), (1, 2, 1, 2), (1, 3, 2, 1), (2, 0, 0, 1), (2, 1, 1, 0)]
    assert nodes.count() == 5


def test_pairs_of_directions_carry_what_their_costs_need(spark):
    r = random.Random(6)
    rows = [(p, k, s, r.randrange(448), r.randrange(448), r.randrange(360)) for p in range(3) for k in range(6) for s in range(3)] + [(0, 9, None, 5, 5, 40), (None, 0, 0, 1, 1, 0)]
    d = directions.with_vectors(spark.createDataFrame(rows, "patch_id int, kp_seq int, slot int, x int, y int, deg int"))
    for costs in (matching.pair_costs(d), matching.line_costs(d)):
        # one join makes the pairs; none looks up their ends
        assert _plan(costs).count("Join ") == 1
        assert costs.where("si is null or sj is null or patch_id is null").isEmpty() and not costs.isEmpty()


def _dense_edges(spark):
    r = random.Random(31)
    at = [(x, y) for x in range(0, 60, 12) for y in range(0, 60, 12)]
    rows = [(g, *a, *b) for g in range(4) for a in at for b in r.sample(at, 1 + g % 2) if a != b and r.random() < 0.6]
    rows += [(7, 0, 0, 30, 0), (7, 30, 0, 30, 30), (7, 30, 30, 0, 0), (7, 80, 80, 90, 90), (8, 5, 5, 9, 9)]  # a ring, lone roads
    return spark.createDataFrame(rows + [(None, 0, 0, 9, 9)], "image_id long, x1 int, y1 int, x2 int, y2 int")


def test_dense_images_are_made_whole_as_by_joins(spark):
    e = _dense_edges(spark)
    placed = iterate.cut(metrics._placed(e).where("image_id is not null"))
    want = sorted(metrics._steps_by_joins(placed).collect(), key=str)
    for at_once in (1, 500, 200_000):
        got = metrics._steps_by_tasks(placed, at_once)
        assert sorted(got.collect(), key=str) == want
    # one shuffle by image, of edges
    assert _plan(got).count("Repartition") == 1 and "Join" not in _plan(got)
    for most in (0, 100, 10_000):
        rows = metrics._dense_rows(e, most)
        assert rows.count() == len(want) and rows.where("ring").count() > 0
    # what follows makes its proposals from these rows alone
    assert _plan(metrics.control_points(*metrics._views(rows))).count("Join ") == 1


def test_pairs_of_points_are_written_by_the_search(spark):
    e = metrics._views(metrics._dense_rows(_dense_edges(spark).where("image_id in (0, 7)")))
    p = e[0].where("degree <> 2").select("image_id", "node")
    found = [sorted(map(tuple, metrics.all_key_paths(*e[::2], p, 10_000, many).collect())) for many in (1_000, 3)]
    assert found[0] == found[1] and any(x[3] > 0 for x in found[0]) and any(x[3] == -1 for x in found[0])


def test_all_paths_make_no_table_of_pairs(spark):
    links = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 3, 0), (1, 3, 1, 9), (2, 4, 5, 1)], "image_id long, a long, b long, w long")
    p = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 9), (2, 5), (2, 4), (3, 1), (3, 2)], "image_id long, node long")
    got = iterate.all_paths(links, p)
    assert "Join" not in _plan(got)
    got = {tuple(x) for x in got.collect()}
    assert got == {(1, 1, 2, 5), (1, 1, 3, 5), (1, 2, 3, 0), (1, 1, 9, -1), (1, 2, 9, -1), (1, 3, 9, -1), (2, 4, 5, 1), (3, 1, 2, -1)}
    assert {tuple(x) for x in iterate.all_paths(links, p, many=1).collect()} == got


def test_radius_join_meets_sides_that_are_dealt_by_group_and_cut_apart(spark):
    """Both sides come dealt by group from a window, one much larger, so that adaptive execution closes their parts up differently."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.shuffle.partitions": "32"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        w = Window.partitionBy("image_id").orderBy("x")
        side = lambda n, c: spark.range(n).select((F.col("id") % 100).alias("image_id"), F.floor(F.col("id") / 100).alias("x")).withColumn(f"id{c}", F.row_number().over(w)).select("image_id", f"id{c}", F.col("x").alias(f"{c}x"), F.lit(0).alias(f"{c}y"))
        got = iterate.grid_join(side(40_000, "a"), side(1_000, "b"), 1).count()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == 100 * (10 * 3 - 1)


def _turned(spark, g="patch_id"):
    r = random.Random(11)
    rows = [(p, k, s, float(r.randrange(448)), float(r.randrange(448)), r.randrange(360)) for p in range(6) for k in range(12) for s in range(r.randrange(1, 6))]
    rows += [(None, 0, 0, 1.0, 1.0, 5), (7, 0, 0, 5.0, 5.0, 10), (7, 1, 0, 5.0, 5.0, 190), (7, 2, 0, 9.0, 5.0, None)]
    d = spark.createDataFrame(rows, "p long, kp_seq int, slot int, x double, y double, deg int")
    return directions.with_vectors(d).withColumnRenamed("p", g)


def test_pair_costs_are_worked_out_for_pairs_in_reach_alone(spark):
    d = _turned(spark)
    got = matching.pair_costs(d)
    join = _plan(got).split("MapInArrow")[1]
    assert "ACOS" in _plan(got).split("MapInArrow")[0] and "ACOS" not in join and "Join " in join
    q = matching._with_sums(matching._facing(d, "patch_id", *matching._sides("i", "j"))).where("dist > 0")
    want = q.withColumn("cost", F.round(geo.pair_cost("dist", "angle_sum", "line_sum"), 9)).where("cost < 1000").select(got.columns)
    a, b = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert a == b and len(a) > 20
    of = matching.pair_costs(d.withColumn("patch_id", F.struct(F.col("patch_id").alias("image_id"), F.lit(1).alias("patch_seq"))))
    assert sorted((*x[:1][0][:1], *x[1:]) for x in of.where("patch_id.image_id is not null").collect()) == a


def test_assignment_of_small_groups_needs_no_components(spark):
    r = random.Random(12)
    rows = [(g, r.randrange(20), r.randrange(20), r.randrange(1, 1000) / 10) for g in range(30) for _ in range(g)]
    p = spark.createDataFrame(rows, "g long, a long, b long, cost double")
    got = matching.component_match(p, "g", 60.0)
    assert "MapInArrow" in _plan(got) and "FlatMapGroups" not in _plan(got)
    want = matching._by_component(iterate.cut(p), "g", 60.0, 200_000, 1e-9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 50


def test_direction_arrays_equal_direction_maps(spark):
    r = random.Random(13)
    kp = spark.createDataFrame([(p, k, r.randrange(60), r.randrange(60)) for p in range(4) for k in range(9)], "patch_id long, kp_seq int, x int, y int")
    d = spark.createDataFrame([(p, k, s, r.random(), r.random(), r.random()) for p in range(4) for k in range(8) for s in range(6) if r.random() < 0.5], "patch_id long, kp_seq int, slot int, prob double, sin double, cos double")
    maps = iterate.cut(raster.gaussian_maps(kp, 2, 60, 60))
    got = raster.direction_arrays(maps, d)
    assert "Generate" not in _plan(got)
    want = {}
    for x in raster.direction_maps(maps, d, False).collect():
        want.setdefault((x["patch_id"], x["row_"], x["col_"]), {})[x["slot"]] = (x["prob"], x["sin"], x["cos"])
    rows = {(x["patch_id"], x["row_"], x["col_"]): [tuple(s) for s in x["dirs"]] for x in got.collect()}
    assert rows == {k: [v[s] for s in range(6)] for k, v in want.items()} and len(rows) == maps.count()
