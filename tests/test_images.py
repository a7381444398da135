"""Heat export, noise and colour changes against plain loops."""

import colorsys
import math
import random

from pyspark.sql import functions as F

from waymesh.operators import jobs, raster


def test_heat_export(spark):
    random.seed(3)
    px = [(1, r, c, random.uniform(-6, 6), [(random.uniform(-6, 6), 0.0, 1.0) for _ in range(6)]) for r in range(9) for c in range(9)]
    t = spark.createDataFrame(px, "image_id long, row_ int, col_ int, loc double, dirs array<struct<prob:double,sin:double,cos:double>>")
    level = lambda v: math.floor(255 / (1 + math.exp(-v)))
    starts = [0, 3, 4]  # every 5 - 2 pixels, and flush with the far side
    want = set()
    for i, (y, x) in enumerate((y, x) for y in starts for x in starts):
        for _, r, c, loc, dirs in px:
            if y <= r < y + 5 and x <= c < x + 5:
                want |= {(i, m, r - y, c - x, level(v)) for m, v in enumerate([loc, *(d[0] for d in dirs)])}
    got = [tuple(r)[1:] for r in jobs.heat_export(t, 9, 9, 5, 2).collect()]
    assert set(got) == want and len(got) == len(want)
    # an image no larger than a patch; no directions; no value
    few = spark.createDataFrame([(1, 0, 0, 0.0, None), (2, 0, 0, None, None)], t.schema)
    assert sorted(tuple(r) for r in jobs.heat_export(few, 9, 9, 9, 2).collect()) == [(1, 0, 0, 0, 0, 127), (2, 0, 0, 0, 0, None)]
    assert jobs.heat_export(t.limit(0), 9, 9, 5, 2).count() == 0


def test_noise_and_colours(spark):
    random.seed(4)
    px = [(i, r, 0, *(random.randrange(256) for _ in range(3))) for i in range(60) for r in range(30)] + [(99, k, 0, v, v, v) for k, v in enumerate((0, 5, 255))]
    t = spark.createDataFrame(px, "image_id long, row_ int, col_ int, b int, g int, r int")
    noisy = {(r["image_id"], r["row_"]): r["b"] for r in raster.noise(t, "b", 10.0, 0.5, 7).collect()}
    moved = {i for i, r, _, b, _, _ in px if noisy[i, r] != b}
    assert all(0 <= noisy[i, r] <= 255 and abs(noisy[i, r] - b) <= 10 for i, r, _, b, _, _ in px) and 15 < len(moved) < 45
    assert all(noisy[i, r] == b for i, r, _, b, _, _ in px if i not in moved)
    assert noisy == {(r["image_id"], r["row_"]): r["b"] for r in raster.noise(t.repartition(5), "b", 10.0, 0.5, 7).collect()}
    # hue, saturation and value as the standard library has them, and back again
    h, s, v = raster.hsv(F.col("r"), F.col("g"), F.col("b"))
    for row in t.select("r", "g", "b", h.alias("h"), s.alias("s"), v.alias("v")).collect():
        want = colorsys.rgb_to_hsv(row["r"] / 255, row["g"] / 255, row["b"] / 255)
        assert all(abs(a - b) < 1e-9 for a, b in zip((row["h"] / 360, row["s"], row["v"]), want))
    same = raster.hsv_jitter(t, 0.0, 0.0, 0.0, 7).collect()
    assert sorted((x["image_id"], x["row_"], x["b"], x["g"], x["r"]) for x in same) == sorted((i, r, b, g, q) for i, r, _, b, g, q in px)
    # one factor of each an image: all its pixels turn by one hue
    jit = raster.hsv_jitter(t, 0.0, 0.0, 10.0, 7).select("image_id", "row_", raster.hsv(F.col("r"), F.col("g"), F.col("b"))[0].alias("to"))
    base = t.select("image_id", "row_", h.alias("from"), s.alias("s"), v.alias("v"))
    turn = {}
    for x in jit.join(base, ["image_id", "row_"]).where("s > 0.8 and v > 0.8").collect():
        turn.setdefault(x["image_id"], []).append((x["to"] - x["from"] + 180) % 360 - 180)
    assert len(turn) > 20 and all(max(ts) - min(ts) < 2 and max(map(abs, ts)) < 11 for ts in turn.values())
