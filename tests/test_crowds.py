"""Radius joins of crowded cells and the image side of training samples, against plain loops."""

import math
import random

from pyspark.sql import functions as F

from waymesh.operators import iterate, jobs

A, B = "image_id long, ida int, ax double, ay double", "image_id long, idb int, bx double, by double"


def _near(a, b, radius):
    return sorted((g, i, j) for g, i, x, y in a for h, j, u, v in b if g == h and math.sqrt((x - u) ** 2 + (y - v) ** 2) <= radius)


def _joined(spark, a, b, radius, most):
    out = iterate.grid_join(spark.createDataFrame(a, A), spark.createDataFrame(b, B), radius, most=most)
    assert out.columns == ["image_id", "ida", "ax", "ay", "idb", "bx", "by", "dist"]
    return sorted((r["image_id"], r["ida"], r["idb"]) for r in out.collect())


def _cases(rng):
    """Points spread about, crowded in one spot, at one place, and around corners of cells."""
    spread = [(g, rng.uniform(-40, 40), rng.uniform(-40, 40)) for g in (1, 2) for _ in range(60)]
    crowd = [(1, rng.uniform(9, 13), rng.uniform(-3, 3)) for _ in range(150)]
    one = [(2, 5.0, 5.0)] * 70
    corners = [(1, 10.0 * i + e, 10.0 * j + f) for i in (-1, 0, 1) for j in (0, 1) for e in (0, 1e-12, -1e-12) for f in (0, -1e-12)]
    return spread + crowd + one + corners


def test_crowded_cells(spark):
    rng = random.Random(5)
    for most in (7, 40, 10_000):
        a = [(g, i, x, y) for i, (g, x, y) in enumerate(_cases(rng))]
        b = [(g, i, x, y) for i, (g, x, y) in enumerate(_cases(rng))]
        assert _joined(spark, a, b, 10.0, most) == _near(a, b, 10.0)
    # a crowd on one side only, repeated rows, nulls and empty tables
    few = [(1, 1, 10.0, 0.0), (1, 1, 10.0, 0.0), (None, 2, 10.0, 0.0), (1, 3, None, 0.0)]
    plain = [r for r in few if None not in r]
    assert _joined(spark, few, b, 10.0, 7) == _near(plain, b, 10.0)
    assert _joined(spark, a, few, 10.0, 7) == _near(a, plain, 10.0)
    assert _joined(spark, [], b, 10.0, 7) == [] == _joined(spark, a, [], 10.0, 7)


def test_no_key_holds_a_crowd(spark):
    """Of 1500 x 1500 pairs around one spot no join key has a tenth, and each is found once."""
    rng = random.Random(6)
    pts = [(1, i, rng.gauss(5, 0.3), rng.gauss(5, 0.3)) for i in range(1500)] + [(1, i, rng.uniform(0, 4000), rng.uniform(0, 4000)) for i in range(1500, 3000)]
    a, b = spark.createDataFrame(pts, A), spark.createDataFrame(pts, B)
    at = lambda t, x, y: t.select("*", F.floor(F.col(x) / 10).alias("cx"), F.floor(F.col(y) / 10).alias("cy"))
    left, right, keys = at(a, "ax", "ay"), at(b, "bx", "by"), ["image_id", "cx", "cy"]
    full = iterate.regions.crowded_cells(left, right, keys, 150)
    pairs = iterate._crowded(left, right, full, 10.0, keys, 150)
    n = left.join(full, keys, "left_semi").count()
    got = pairs.select(F.count("*").alias("n"), F.count_distinct("ida", "idb").alias("d")).first()
    assert full.count() == 1 and got["n"] == got["d"] == n * n
    # keys dealt out by a shuffle, as on tables too large to broadcast: no task makes a tenth of the pairs
    want = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    had = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        parts = iterate._crowded(left, right, full, 10.0, keys, 150).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["count"] for r in parts) == n * n and max(r["count"] for r in parts) < n * n / 10


def test_sample_pixels(spark):
    n, rng = 32, random.Random(7)
    spots = {(p, k): (rng.randrange(3, n - 3), rng.randrange(3, n - 3)) for p in range(12) for k in range(1)}
    kp = spark.createDataFrame([(p, k, x, y) for (p, k), (x, y) in spots.items()], "patch_id long, kp_seq int, x int, y int")
    dirs = spark.createDataFrame([(p, k, 0, 30.0) for p, k in spots], "patch_id long, kp_seq int, dir_idx int, deg double")
    rows = [(p, r, c, *((9, 8, 7) if (c, r) == spots[p, 0] else (5, 5, 5) if r == 0 else (5, 5, c + 6))) for p in range(12) for r in range(n) for c in range(n)]
    px = spark.createDataFrame(rows, "patch_id long, row_ int, col_ int, b int, g int, r int")
    out = jobs.sample_pixels(px, [1, 2, 3], n, 11)
    got = [(r["patch"]["patch_id"], r["patch"]["epoch"], r["row_"], r["col_"], r["b"], r["valid"]) for r in out.collect()]
    # every place once, and the band that marks a keypoint is where its target map has its peak
    assert len({g[:4] for g in got}) == len(got) == 12 * 3 * n * n and all(0 <= g[2] < n and 0 <= g[3] < n for g in got)
    target = jobs.training_samples(kp, dirs, [1, 2, 3], n, 1, 11).where("loc = 1").select("patch.*", "row_", "col_").distinct().collect()
    assert {g[:4] for g in got if g[4] == 9} == {(t["patch_id"], t["epoch"], t["row_"], t["col_"]) for t in target}
    assert len({(g[2], g[3]) for g in got if g[0] == 0 and g[4] == 9}) > 1
    blank = {(p, e): {(g[2], g[3]) for g in got if g[:2] == (p, e) and g[5] == 0} for p in (0, 1) for e in (1, 2, 3)}
    assert all(len({r for r, _ in s}) == 1 or len({c for _, c in s}) == 1 for s in blank.values())
    assert all(len(s) >= n for s in blank.values())
    few = spark.createDataFrame([(1, 0, 0, None, 5, 5), (1, 0, 1, 5, 5, 5)], px.schema)
    assert sorted(r["valid"] for r in jobs.sample_pixels(few, [1], n, 1).collect()) == [0.0, 1.0] and jobs.sample_pixels(px.limit(0), [1], n, 1).count() == 0


def test_small_groups_are_joined_where_they_lie(spark):
    r = random.Random(4)
    key = lambda: r.choice([(1, 2), (2, None), (None, 1), None])
    at = lambda: r.choice([r.uniform(-9, 9), float(r.randrange(-3, 3)), None, float("nan")])
    a, b = ([(key(), i, at(), r.uniform(-3, 3)) for i in range(700)] for _ in "ab")
    p = spark.createDataFrame(a, "k struct<u:long,v:long>, ida long, ax double, ay double")
    q = spark.createDataFrame(b, "k struct<u:long,v:long>, idb long, bx double, by double")
    out = iterate.grid_join(p, q, 1.0, "k")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row goes to nine cells
    want = {(i, j) for k, i, x, y in a for m, j, u, v in b if k is not None and k == m and None not in (x, u) and (x - u) ** 2 + (y - v) ** 2 <= 1}
    got = [(x["ida"], x["idb"]) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want != set()
    assert sorted((x["ida"], x["idb"]) for x in iterate.grid_join(p, q, 1.0, "k", most=100).collect()) == sorted(got)
