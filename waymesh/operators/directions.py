"""Operators on the directions of keypoints: arrays of up to six (prob, sin, cos) structs."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTORS = 6


def _subsets() -> Column:
    """Arrays of the subsets of k sectors (sorted sectors), k from 1 to six."""
    whole = lambda c: F.array(*(F.lit(v) for v in c))
    return F.array(*(F.array(*(whole(c) for c in itertools.combinations(range(SECTORS), k))) for k in range(1, SECTORS + 1)))


def _six_of(angles: Column) -> Column:
    """struct(cost, subset, a): six of more than six sorted angles for the six sectors at least cost, the smallest six at a tie.

    Angle by angle, the best way to fill the first k sectors is kept for every k.
    """
    empty = F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<double>").alias("a"))
    none = F.struct(F.lit(float("inf")).alias("cost"), F.array().cast("array<double>").alias("a"))

    def step(best: Column, x: Column) -> Column:
        def fill(k: int) -> Column:
            before = best[k - 1]
            return F.least(best[k], F.struct((before["cost"] + F.abs(x - (60 * k - 30))).alias("cost"), F.concat(before["a"], F.array(x)).alias("a")))

        return F.array(empty, *(fill(k) for k in range(1, SECTORS + 1)))

    full = F.element_at(F.aggregate(F.transform(angles, lambda x: x.cast("double")), F.array(empty, *[none] * SECTORS), step), -1)
    return F.struct(full["cost"].alias("cost"), F.array(*(F.lit(k) for k in range(SECTORS))).alias("subset"), full["a"].alias("a"))


def _allocated(angles: Column) -> Column:
    """Array of (deg, sector) of sorted angles, as allocate gives them; all subsets are tried within the row."""

    def cost(subset: Column) -> Column:
        return F.aggregate(F.zip_with(angles, subset, lambda x, s: F.abs(x - (s * 60 + 30))), F.lit(0.0), lambda acc, c: acc + c)

    few = F.array_min(F.transform(F.get(_subsets(), F.size(angles) - 1), lambda s: F.struct(cost(s).alias("cost"), s.alias("subset"))))["subset"]
    pairs = lambda a, s: F.zip_with(a, s, lambda x, k: F.struct(x.alias("deg"), k.alias("sector")))
    six = _six_of(angles)
    none = F.array().cast("array<struct<deg:double,sector:int>>")
    return F.when(F.size(angles) == 0, none).when(F.size(angles) <= SECTORS, pairs(angles, few)).otherwise(pairs(six["a"], six["subset"]))


def allocate(dirs: DataFrame, keys: list[str], angle: str = "deg") -> DataFrame:
    """(keys, deg, sector): angles of a key to sectors with middles 30, 90, ..., 330, least total |angle - middle|.

    Costs on a line keep order, so the sorted angles meet each subset of
    sectors in order; the smallest subset wins a tie. Of more than six angles
    the six that fit best are taken, whatever their number.
    """
    kind = dirs.schema[angle].dataType.simpleString()
    angles = dirs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(angle).cast("double"))).alias("a"))
    out = angles.select(*keys, F.explode(_allocated(F.col("a"))).alias("z"))
    return out.select(*keys, F.col("z.deg").cast(kind).alias("deg"), "z.sector")


def in_order(dirs: DataFrame, keys: list[str], angle: str = "deg") -> DataFrame:
    """(keys, deg, sector): slots by rising angle; equal angles both stay, by their index."""
    w = Window.partitionBy(*keys).orderBy(angle, "dir_idx")
    return dirs.withColumn("sector", F.row_number().over(w) - 1).where(F.col("sector") < SECTORS).select(*keys, F.col(angle).alias("deg"), "sector")


def without_order(dirs: DataFrame, keys: list[str], angle: str = "deg") -> DataFrame:
    """(keys, deg, sector): slots in the order given."""
    w = Window.partitionBy(*keys).orderBy("dir_idx")
    return dirs.withColumn("sector", F.row_number().over(w) - 1).where(F.col("sector") < SECTORS).select(*keys, F.col(angle).alias("deg"), "sector")


def reslot(dirs: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """allocate, in_order or without_order by name."""
    return {"allocate": allocate, "order": in_order, "without_order": without_order}[mode](dirs, keys)


def flip(dirs: DataFrame, w: int, h: int, horizontal: bool) -> DataFrame:
    """Keypoints and angles of mirrored patches."""
    if horizontal:
        return dirs.withColumns({"x": w - 1 - F.col("x"), "deg": F.pmod(540 - F.col("deg"), F.lit(360))})
    return dirs.withColumns({"y": h - 1 - F.col("y"), "deg": F.pmod(360 - F.col("deg"), F.lit(360))})


def rotate(dirs: DataFrame, n: int, turns: int) -> DataFrame:
    """Keypoints and angles of n x n patches turned clockwise by quarter turns."""
    for _ in range(turns % 4):
        dirs = dirs.withColumns({"x": n - 1 - F.col("y"), "y": F.col("x"), "deg": F.pmod(F.col("deg") + 90, F.lit(360))})
    return dirs


def draw(seed: int, n: int, *keys: str | Column) -> Column:
    """A seeded number of 0 .. n - 1 per key."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n).cast("long")).cast("int")


def coin(seed: int, share: float, *keys: str | Column) -> Column:
    """Seeded choice per key: true for about `share` of them."""
    return draw(seed, 1 << 20, *keys) < int(share * (1 << 20))


def _slots_of(dirs: Column, mode: str, kind: str) -> Column:
    """Array of (dir_idx, deg) of a keypoint's directions (deg, dir_idx), sorted into slots as reslot does."""
    if mode == "allocate":
        degs = F.array_sort(F.transform(F.filter(dirs, lambda d: d["deg"].isNotNull()), lambda d: d["deg"].cast("double")))
        return F.transform(_allocated(degs), lambda z: F.struct(z["sector"].cast("int").alias("dir_idx"), z["deg"].cast(kind).alias("deg")))
    order = ("deg", "dir_idx") if mode == "order" else ("dir_idx", "deg")
    ranked = F.slice(F.array_sort(F.transform(dirs, lambda d: F.struct(*(d[c].alias(c) for c in order)))), 1, SECTORS)
    return F.transform(ranked, lambda d, i: F.struct(i.cast("int").alias("dir_idx"), d["deg"].alias("deg")))


def _moved(dirs: DataFrame, keys: list[str], hit: Column, places: dict[str, Column], deg: Column, mode: str) -> DataFrame:
    """Directions (keys, x, y, dir_idx, deg) with those of keypoints that are hit moved to places and sorted into slots anew.

    One aggregation, and no join: a keypoint, which has one place, is one row in between.
    """
    kind, slot = (dirs.schema[c].dataType.simpleString() for c in ("deg", "dir_idx"))
    own = F.struct(F.when(hit, deg).otherwise(F.col("deg")).cast(kind).alias("deg"), "dir_idx")
    at = [F.first(F.when(hit, places[c]).otherwise(F.col(c))).alias(c) if c in places else F.first(c).alias(c) for c in ("x", "y")]
    one = dirs.groupBy(*keys).agg(*at, F.first(hit).alias("_hit"), F.collect_list(own).alias("_d"))
    wide = lambda a: F.transform(a, lambda d: F.struct(d["dir_idx"].cast(slot).alias("dir_idx"), d["deg"].alias("deg")))
    every = F.when(F.col("_hit"), wide(_slots_of(F.col("_d"), mode, kind))).otherwise(wide(F.col("_d")))
    return one.select(*keys, "x", "y", F.explode(every).alias("_d")).select(*keys, "x", "y", "_d.dir_idx", "_d.deg")


def random_flip(dirs: DataFrame, keys: list[str], image: list[str], w: int, h: int, seed: int, share_horizontal: float = 0.5, share_vertical: float = 0.5, mode: str = "allocate") -> DataFrame:
    """Directions (keys, x, y, dir_idx, deg) of patches mirrored by a seeded coin of each image (and epoch, if that is part of `image`), slots sorted anew."""
    for name, share, c, size, turn in (("h", share_horizontal, "x", w, 540), ("v", share_vertical, "y", h, 360)):
        dirs = _moved(dirs, keys, coin(seed, share, F.lit(name), *image), {c: size - 1 - F.col(c)}, F.pmod(turn - F.col("deg"), F.lit(360)), mode)
    return dirs


def random_rotate(dirs: DataFrame, keys: list[str], image: list[str], n: int, seed: int, mode: str = "allocate") -> DataFrame:
    """Directions (keys, x, y, dir_idx, deg) of n x n patches turned by a seeded 0 to 3 quarter turns of each image, slots sorted anew where turned."""
    turn, last = draw(seed, 4, F.lit("turn"), *image), n - 1
    by = lambda *to: F.when(turn == 1, to[0]).when(turn == 2, to[1]).otherwise(to[2])
    x, y = F.col("x"), F.col("y")
    return _moved(dirs, keys, turn > 0, {"x": by(last - y, last - x, y), "y": by(x, last - y, last - x)}, F.pmod(F.col("deg") + 90 * turn, F.lit(360)), mode)


def normalise(dirs: DataFrame, threshold: float) -> DataFrame:
    """(prob, sin, cos) with unit (sin, cos); all zero where prob is under the threshold."""
    n = F.greatest(F.sqrt(F.col("sin") ** 2 + F.col("cos") ** 2), F.lit(1e-8))
    keep = F.col("prob") >= threshold
    return dirs.withColumns({"sin": F.when(keep, F.col("sin") / n).otherwise(0.0), "cos": F.when(keep, F.col("cos") / n).otherwise(0.0), "prob": F.when(keep, F.col("prob")).otherwise(0.0)})


def clean(slots: Column, degrees: float) -> Column:
    """Array of (prob, sin, cos) slots in which directions that point nearly the same way keep the likeliest one only.

    Each live slot in turn, claimed itself or not, claims the others that none
    has claimed and whose three-vector's cosine with its own reaches that of
    `degrees`. Then in each of these groups, in turn, the first slot of the
    largest probability left keeps it and the others' becomes 0; places, sines
    and cosines stay.
    """
    limit = F.cos(F.radians(F.lit(float(degrees))))
    places = F.sequence(F.lit(0), F.size(slots) - 1)

    def norm(d: Column) -> Column:
        return F.sqrt(d["prob"] ** 2 + d["sin"] ** 2 + d["cos"] ** 2)

    def alike(a: Column, b: Column) -> Column:
        return (a["prob"] * b["prob"] + a["sin"] * b["sin"] + a["cos"] * b["cos"]) / (norm(a) * norm(b)) >= limit

    live = F.filter(places, lambda i: F.get(slots, i)["prob"] > 0)

    def claim(acc: Column, i: Column) -> Column:
        mine = F.filter(live, lambda j: (j != i) & ~F.array_contains(acc["done"], j) & alike(F.get(slots, i), F.get(slots, j)))
        group = F.concat(F.array(i), mine)
        return F.struct(F.concat(acc["done"], group).alias("done"), F.concat(acc["groups"], F.array(group)).alias("groups"))

    start = F.struct(F.array().cast("array<int>").alias("done"), F.array().cast("array<array<int>>").alias("groups"))
    groups = F.aggregate(live, start, claim)["groups"]

    def settle(probs: Column, group: Column) -> Column:
        top = F.array_max(F.transform(group, lambda j: F.get(probs, j)))
        best = F.get(F.filter(group, lambda j: F.get(probs, j) == top), F.lit(0))
        return F.transform(probs, lambda p, j: F.when(F.array_contains(group, j) & (j != best), 0.0).otherwise(p))

    probs = F.aggregate(groups, F.transform(slots, lambda d: d["prob"]), settle)
    return F.when(F.size(slots) > 0, F.transform(F.arrays_zip(slots.alias("d"), probs.alias("p")), lambda z: F.struct(z["p"].alias("prob"), z["d"]["sin"].alias("sin"), z["d"]["cos"].alias("cos")))).otherwise(slots)


def clean_border(slots: Column, x: Column, y: Column, w: int, h: int, degrees: float = 15.0, band: int = 20) -> Column:
    """clean for keypoints less than `band` from a side of the patch; others stay."""
    inner = x.between(band, w - band) & y.between(band, h - band)
    return F.when(~inner & (x >= 0) & (y >= 0), clean(slots, degrees)).otherwise(slots)


def pack(dirs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, flat): twelve doubles per key, (sin, cos) of each sector or nulls."""
    got = dirs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("sector", F.struct("sin", "cos")))).alias("m"))
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SECTORS - 1)), lambda i: F.array(F.try_element_at(F.col("m"), i)["sin"], F.try_element_at(F.col("m"), i)["cos"])))
    return got.select(*keys, flat.alias("flat"))


def unpack(packed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sector, prob, sin, cos) of the slots that aren't null."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(SECTORS - 1)), lambda i: F.struct(i.alias("sector"), F.lit(1.0).alias("prob"), F.get("flat", 2 * i).alias("sin"), F.get("flat", 2 * i + 1).alias("cos")))
    return packed.select(*keys, F.explode(F.filter(pairs, lambda p: p["sin"].isNotNull())).alias("p")).select(*keys, "p.*")


def shift_border(kp: DataFrame, radius: int, w: int, h: int, seed: int, keys: tuple[str, ...] = ("patch_id", "kp_seq")) -> DataFrame:
    """Keypoints exactly on the border moved inward by a seeded 1..radius pixels."""
    by = lambda n: draw(seed, radius, F.lit(n), *keys) + 1

    def move(c: str, last: int) -> Column:
        return F.when(F.col(c) == 0, by(c)).when(F.col(c) == last, last - by(c)).otherwise(F.col(c))

    return kp.withColumns({"x": move("x", w - 1), "y": move("y", h - 1)})


def with_vectors(dirs: DataFrame) -> DataFrame:
    """dirs with sin and cos of deg."""
    return dirs.withColumns({"sin": F.sin(F.radians("deg")), "cos": F.cos(F.radians("deg"))})
