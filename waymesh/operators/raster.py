"""Operators on pixel tables (image_id, row_, col_, bands or heat)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.session import cut, dealt

G = "image_id"


def min_max(px: DataFrame, value: str, g: str = G) -> DataFrame:
    """px with `scaled`: value from its group's minimum (0) to maximum (1); null for one value."""
    w = Window.partitionBy(g)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return px.withColumn("scaled", (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)))


def rescale8(px: DataFrame, bands: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """Bands from their image's minimum to maximum as 0..255, truncated; 0 for a flat band."""
    ends = px.groupBy(G).agg(*(f(c).alias(f"{n}_{c}") for c in bands for n, f in (("lo", F.min), ("hi", F.max))))
    out = px.join(ends, G)
    for c in bands:
        out = out.withColumn(c, F.coalesce(((F.col(c) - F.col(f"lo_{c}")) * 255.0 / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0))).cast("int"), F.lit(0)))
    return out.select(px.columns)


def clahe(px: DataFrame, value: str, tile: int, clip: float = 4.0) -> DataFrame:
    """Contrast-limited adaptive equalisation of a band of 0..255 over tiles of an image, whose size is that of its pixels.

    Counts over the clip limit are dealt evenly to all values; each pixel
    blends the cumulative maps of the four tile centres around it.
    """
    n, limit = tile * tile, max(1.0, clip * tile * tile / 256)
    sizes = px.groupBy(G).agg(F.max(F.floor(F.col("row_") / tile)).alias("last_r"), F.max(F.floor(F.col("col_") / tile)).alias("last_c"))
    tiled = px.select(G, F.floor(F.col("row_") / tile).alias("tr"), F.floor(F.col("col_") / tile).alias("tc"), F.col(value).alias("v"))
    hist = tiled.groupBy(G, "tr", "tc", "v").agg(F.count("*").alias("c"))
    over = hist.groupBy(G, "tr", "tc").agg(F.sum(F.greatest(F.col("c") - limit, F.lit(0.0))).alias("over"))
    run = Window.partitionBy(G, "tr", "tc").orderBy("v")
    cum = hist.join(over, [G, "tr", "tc"]).withColumn("m", 255.0 / n * (F.sum(F.least("c", F.lit(limit))).over(run) + F.col("over") * (F.col("v") + 1) / 256))
    fr, fc = (F.col("row_") + 0.5) / tile - 0.5, (F.col("col_") + 0.5) / tile - 0.5
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    p = px.join(sizes, G).select(G, "row_", "col_", F.col(value).alias("v"), "last_r", "last_c", corner.alias("o"))
    wr = F.when(F.col("o.i") == 1, fr - F.floor(fr)).otherwise(1 - (fr - F.floor(fr)))
    wc = F.when(F.col("o.j") == 1, fc - F.floor(fc)).otherwise(1 - (fc - F.floor(fc)))
    clamp = lambda x, last: F.greatest(F.lit(0), F.least(F.col(last), x))
    p = p.select(G, "row_", "col_", "v", clamp(F.floor(fr) + F.col("o.i"), "last_r").alias("tr"), clamp(F.floor(fc) + F.col("o.j"), "last_c").alias("tc"), (wr * wc).alias("w"))
    # a tile may lack a pixel's value: the map of the next lower value holds there, with its share of what was over
    cover = cum.groupBy(G, "tr", "tc").agg(F.array_sort(F.collect_list(F.struct("v", "m"))).alias("map"), F.first("over").alias("over"))  # at most 256 entries
    at = F.filter("map", lambda e: e["v"] <= F.col("v"))
    low = F.element_at(at, -1)
    m = F.when(F.size(at) > 0, low["m"] + F.col("over") * 255.0 / n * (F.col("v") - low["v"]) / 256).otherwise(F.col("over") * 255.0 / n * (F.col("v") + 1) / 256)
    return p.join(cover, [G, "tr", "tc"]).groupBy(G, "row_", "col_").agg(F.least(F.lit(255), F.rint(F.sum(m * F.col("w"))).cast("int")).alias(value))


def valid_ratio(px: DataFrame, nodata: int = 5) -> DataFrame:
    """(image_id, valid_ratio): share of pixels whose bands aren't all nodata."""
    bad = (F.col("b") == nodata) & (F.col("g") == nodata) & (F.col("r") == nodata)
    return px.groupBy(G).agg(F.avg(F.when(bad, 0.0).otherwise(1.0)).alias("valid_ratio"))


def starts(size: int, crop: int, overlap: int) -> list[int]:
    """Where the patches along one side begin; the last is flush with the end."""
    return sorted({*range(0, max(size - crop, 0), crop - overlap), max(size - crop, 0)})


def patches(spark: SparkSession, w: int, h: int, crop: int, overlap: int) -> DataFrame:
    """The grid of patches of an image: patch_seq, left, top, right, bottom, the last ones flush with its sides."""
    rows = [(i, x, y, x + crop, y + crop) for i, (y, x) in enumerate((y, x) for y in starts(h, crop, overlap) for x in starts(w, crop, overlap))]
    return spark.createDataFrame(rows, "patch_seq int, left int, top int, right int, bottom int")


def _covering(at: Column, size: int, crop: int, overlap: int) -> Column:
    """Array of (nth, start) of the patches along one side that cover a place: at most a few, by arithmetic."""
    step, last = crop - overlap, len(starts(size, crop, overlap)) - 1
    flush = max(size - crop, 0)
    low = F.greatest(F.lit(0), F.floor((at - crop) / step) + 1)
    high = F.least(F.lit(last - 1), F.floor(at / step))
    regular = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    regular = F.transform(regular, lambda k: F.struct(k.cast("int").alias("nth"), (k * step).cast("int").alias("start")))
    end = F.struct(F.lit(last).alias("nth"), F.lit(flush).alias("start"))
    return F.filter(F.concat(regular, F.array(end)), lambda p: (p["start"] <= at) & (at < p["start"] + crop))


def assign_patches(px: DataFrame, w: int, h: int, crop: int, overlap: int) -> DataFrame:
    """px with patch_seq, left and top of every patch of the grid that covers a pixel."""
    across = len(starts(w, crop, overlap))
    p = px.withColumn("_x", F.explode(_covering(F.col("col_"), w, crop, overlap))).withColumn("_y", F.explode(_covering(F.col("row_"), h, crop, overlap)))
    return p.withColumns({"patch_seq": (F.col("_y.nth") * across + F.col("_x.nth")).cast("int"), "left": F.col("_x.start"), "top": F.col("_y.start")}).drop("_x", "_y")


def ownership(px: DataFrame, w: int, h: int, crop: int, overlap: int) -> DataFrame:
    """(image_id, row_, col_, patch_seq): the first patch whose core holds a pixel.

    A core is a patch trimmed by half the overlap on its sides within the image.
    """
    half = overlap // 2

    def within(at: str, start: str, size: int) -> Column:
        low = F.when(F.col(start) == 0, 0).otherwise(F.col(start) + half)
        high = F.when(F.col(start) == max(size - crop, 0), F.col(start) + crop).otherwise(F.col(start) + crop - half)
        return (F.col(at) >= low) & (F.col(at) < high)

    p = assign_patches(px.select(G, "row_", "col_"), w, h, crop, overlap)
    return p.where(within("col_", "left", w) & within("row_", "top", h)).groupBy(G, "row_", "col_").agg(F.min("patch_seq").alias("patch_seq"))


def _valid_spans(size: int, crop: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, first, last) of what each patch along one side owns: its core without its predecessors' cores."""
    half, out, taken = overlap // 2, [], 0
    for s in starts(size, crop, overlap):
        low = max(s + half if s else 0, taken)
        taken = s + crop if s == max(size - crop, 0) else s + crop - half
        out.append((s, low, taken - 1))
    return out


def valid_rects(spark: SparkSession, w: int, h: int, crop: int, overlap: int) -> DataFrame:
    """(patch_seq, x0, y0, left, top, right, bottom): a patch's corner in the image, and the rectangle that it owns in its own coordinates, sides included."""
    xs, ys = _valid_spans(w, crop, overlap), _valid_spans(h, crop, overlap)
    rows = [(i, x, y, x1 - x, y1 - y, x2 - x, y2 - y) for i, ((y, y1, y2), (x, x1, x2)) in enumerate((a, b) for a in ys for b in xs)]
    return spark.createDataFrame(rows, "patch_seq int, x0 int, y0 int, left int, top int, right int, bottom int")


def seams(spark: SparkSession, w: int, h: int, crop: int, overlap: int) -> DataFrame:
    """(seam, vertical, at, lo, hi): the lower and right sides of what patches own, but for the image's own border."""
    xs, ys = _valid_spans(w, crop, overlap), _valid_spans(h, crop, overlap)
    rows = []
    for _, y1, y2 in ys:
        for _, x1, x2 in xs:
            rows += [(False, y2, x1, x2)] * (y2 != h - 1) + [(True, x2, y1, y2)] * (x2 != w - 1)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seam int, vertical boolean, at int, lo int, hi int")


def border_penalty(px: DataFrame, w: int, h: int, band: int, penalty: float = 0.1, values: tuple[str, ...] = ("heat",), dirs: str | None = None) -> DataFrame:
    """values, and the probabilities of an array column of directions (prob, sin, cos), less a penalty within `band` pixels of the border."""
    near = (F.col("col_") < band) | (F.col("col_") >= w - band) | (F.col("row_") < band) | (F.col("row_") >= h - band)
    out = px.withColumns({v: F.when(near, F.col(v) - penalty).otherwise(F.col(v)) for v in values})
    if dirs:
        less = F.transform(dirs, lambda d: F.struct((d["prob"] - penalty).alias("prob"), d["sin"].alias("sin"), d["cos"].alias("cos")))
        out = out.withColumn(dirs, F.when(near, less).otherwise(F.col(dirs)))
    return out


def suppress(px: DataFrame, size: int, value: str = "heat", g: str = G) -> DataFrame:
    """value where it is the largest of its size x size window, else 0: one maximum along rows, one along columns."""
    h = size // 2
    rows = px.withColumn("_m", F.max(value).over(Window.partitionBy(g, "row_").orderBy("col_").rangeBetween(-h, h)))
    best = F.max("_m").over(Window.partitionBy(g, "col_").orderBy("row_").rangeBetween(-h, h))
    return rows.withColumn("_b", best).withColumn(value, F.when(F.col(value) == F.col("_b"), F.col(value)).otherwise(0.0)).drop("_m", "_b")


def top_k(px: DataFrame, k: int, threshold: float, value: str = "heat", g: str = G) -> DataFrame:
    """Of the k largest values per image those that reach a threshold, with their rank; ties by row and column."""
    w = Window.partitionBy(g).orderBy(F.desc(value), "row_", "col_")
    return px.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col(value) >= threshold))


def gather(peaks: DataFrame, maps: DataFrame, g: str = G) -> DataFrame:
    """peaks with the channels of maps at their pixels."""
    return peaks.join(maps, [g, "row_", "col_"])


def decode_keypoints(px: DataFrame, size: int, k: int, threshold: float) -> DataFrame:
    """Peaks of a heat map: suppression, top k, and the bands there."""
    peaks = top_k(suppress(px.select(G, "row_", "col_", "heat"), size), k, threshold)
    return gather(peaks, px.select(G, "row_", "col_", "b", "g", "r"))


def gaussian_maps(kp: DataFrame, radius: int, w: int, h: int, k: float = 1.0, g: str = "patch_id") -> DataFrame:
    """(g, row_, col_, loc, kp_seq): Gaussian weights around keypoints, and whose is the largest (the first at a tie).

    The standard deviation is a sixth of the diameter 2 r + 1; weights that
    vanish at single precision are none. Keypoints are dealt by g before they
    are drawn, so no pixel is shuffled.
    """
    return drawn(dealt(kp.select(g, "kp_seq", "x", "y"), 2_000_000 // (2 * radius + 1) ** 2, g), radius, w, h, k, g)


def drawn(kp: DataFrame, radius: int, w: int, h: int, k: float = 1.0, g: str = "patch_id", also: tuple[str, ...] = ()) -> DataFrame:
    """gaussian_maps where the keypoints lie, with other columns of the keypoint whose weight is the largest."""
    sigma = (2 * radius + 1) / 6
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    at = kp.select(g, "kp_seq", "x", "y", *also, F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy"))
    at = at.select(g, "kp_seq", *also, (F.col("y") + F.col("dy")).alias("row_"), (F.col("x") + F.col("dx")).alias("col_"), F.exp(-(F.col("dx") ** 2 + F.col("dy") ** 2) / (2 * sigma * sigma)).alias("wt"))
    at = at.where(F.col("row_").between(0, h - 1) & F.col("col_").between(0, w - 1) & (F.col("wt") >= 2.0**-52))
    first = F.struct("wt", (-F.col("kp_seq")).alias("n"))
    return at.groupBy(g, "row_", "col_").agg((k * F.max("wt")).alias("loc"), (-F.max(first)["n"]).alias("kp_seq"), *(F.max_by(c, first).alias(c) for c in also))


def slot_arrays(dirs: DataFrame, keys: list[str], *also: Column) -> DataFrame:
    """(keys, dirs) of dirs(keys, slot, prob, sin, cos): one row a keypoint."""
    one = F.struct(F.col("slot").cast("int").alias("slot"), "prob", "sin", "cos")
    return dirs.groupBy(*keys).agg(*also, F.collect_list(one).alias("dirs"))


def _every_slot(dirs: Column, slots: int) -> Column:
    """Array of (slot, prob, sin, cos) of all slots; one that is lacking is zero."""
    zero = lambda k: F.struct(k.alias("slot"), *(F.lit(0.0).alias(c) for c in ("prob", "sin", "cos")))
    own = lambda k: F.filter(dirs, lambda d: d["slot"] == k)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.when(F.size(own(k)) > 0, own(k)).otherwise(F.array(zero(k)))))


def at_slots(pixels: DataFrame, weighted: bool, g: str = "patch_id", slots: int = 6, also: tuple[str, ...] = ()) -> DataFrame:
    """(g, row_, col_, slot, prob, sin, cos, also) of all slots at pixels (g, row_, col_, loc, dirs, also)."""
    e = pixels.select(g, "row_", "col_", "loc", *also, F.explode(_every_slot(F.col("dirs"), slots)).alias("d"))
    zero = lambda c: F.coalesce(f"d.{c}", F.lit(0.0)).alias(c)
    return e.select(g, "row_", "col_", "d.slot", F.col("loc").alias("prob") if weighted else zero("prob"), zero("sin"), zero("cos"), *also)


def direction_maps(maps: DataFrame, dirs: DataFrame, weighted: bool, g: str = "patch_id", slots: int = 6) -> DataFrame:
    """(g, row_, col_, slot, prob, sin, cos) of all slots at the pixels of gaussian_maps, from the keypoint with the largest weight.

    dirs: (g, kp_seq, slot, prob, sin, cos); a slot that the keypoint lacks is
    zero. Weighted, every slot's probability is the pixel's weight. Pixels meet
    their keypoint's slots as one row, and become a row a slot after that.
    """
    j = maps.join(slot_arrays(dirs, [g, "kp_seq"]), [g, "kp_seq"], "left").withColumn("dirs", F.coalesce("dirs", F.array()))
    return at_slots(j, weighted, g, slots)


def direction_arrays(maps: DataFrame, dirs: DataFrame, g: str = "patch_id", slots: int = 6) -> DataFrame:
    """maps(g, row_, col_, loc, kp_seq) with dirs: an array of (prob, sin, cos) of all slots in order, as direction_maps gives them a row a slot.

    A pixel stays one row: its slots are neither made rows nor collected again,
    and are put in order once a keypoint.
    """
    whole = lambda d: F.transform(_every_slot(d, slots), lambda x: F.struct(*(F.coalesce(x[c], F.lit(0.0)).alias(c) for c in ("prob", "sin", "cos"))))
    one = slot_arrays(dirs, [g, "kp_seq"])
    none = whole(F.array().cast(one.schema["dirs"].dataType))
    j = maps.join(one.select(g, "kp_seq", whole(F.col("dirs")).alias("dirs")), [g, "kp_seq"], "left")
    return j.select(g, "row_", "col_", "loc", F.coalesce("dirs", none).alias("dirs"))


def keypoint_mask(px: DataFrame, kp: DataFrame) -> DataFrame:
    """px's pixels with 1 at keypoints (image_id, x, y), else 0."""
    marks = kp.select(G, F.col("y").alias("row_"), F.col("x").alias("col_"), F.lit(1).alias("m")).distinct()
    return px.join(marks, [G, "row_", "col_"], "left").select(G, "row_", "col_", F.coalesce("m", F.lit(0)).alias("mask"))


def _by_tiles(edges: DataFrame, margin: int, rows: int, side: int = 256) -> DataFrame:
    """edges with every tile (_tx, _ty) that their box, widened by a margin, touches, dealt by tile over tasks of about `rows` edges.

    So what an edge draws in a tile is made unique where it is, and a task's
    table of pixels doesn't grow with the images.
    """
    e = cut(edges)
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - margin) / side), F.floor((F.greatest(a, b) + margin) / side))
    tiled = e.select("*", F.explode(span("x1", "x2")).alias("_tx")).select("*", F.explode(span("y1", "y2")).alias("_ty"))
    return dealt(tiled, rows, G, "_tx", "_ty", of=e)


def centerline(edges: DataFrame) -> DataFrame:
    """Pixels of a graph drawn one pixel thick, both ends included."""
    from waymesh.functions.geo import line_pixels

    e = _by_tiles(edges, 1, 200_000)
    p = e.select(G, "_tx", "_ty", "x2", "y2", F.explode(F.concat(line_pixels("x1", "y1", "x2", "y2"), F.array(F.lit(None)))).alias("p"))
    p = p.select(G, "_tx", "_ty", F.coalesce("p.x", "x2").alias("x"), F.coalesce("p.y", "y2").alias("y"))
    own = (F.floor(F.col("x") / 256) == F.col("_tx")) & (F.floor(F.col("y") / 256) == F.col("_ty"))
    return p.where(own).distinct().select(G, "x", "y")


def thick_mask(edges: DataFrame, thickness: float) -> DataFrame:
    """Pixels at most half the thickness from an edge; each edge looks at its own bounding box only."""
    from waymesh.functions.geo import point_segment_distance

    t = thickness / 2
    m = int(t) + 1
    e = _by_tiles(edges, m, 8_000)
    span = lambda a, b, k: F.sequence(F.greatest(F.least(a, b) - m, (F.col(k) * 256).cast("int")), F.least(F.greatest(a, b) + m, (F.col(k) * 256 + 255).cast("int")))
    p = e.select("*", F.explode(span("x1", "x2", "_tx")).alias("x")).select("*", F.explode(span("y1", "y2", "_ty")).alias("y"))
    return p.where(point_segment_distance("x", "y", "x1", "y1", "x2", "y2") <= t).select(G, "_tx", "_ty", "x", "y").distinct().select(G, "x", "y")


def flip(px: DataFrame, w: int, h: int, horizontal: bool) -> DataFrame:
    """Pixels mirrored."""
    return px.withColumn("col_", w - 1 - F.col("col_")) if horizontal else px.withColumn("row_", h - 1 - F.col("row_"))


def rotate(px: DataFrame, n: int, turns: int) -> DataFrame:
    """Pixels of an n x n image turned clockwise by quarter turns."""
    for _ in range(turns % 4):
        px = px.withColumns({"row_": F.col("col_"), "col_": n - 1 - F.col("row_")})
    return px


def noise(px: DataFrame, value: str, scale: float, share: float, seed: int) -> DataFrame:
    """value with additive noise on a seeded share of images, clipped to 0..255."""
    u = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 20)) / float(1 << 20)
    hit = u(F.lit("image"), G) < share
    moved = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(value) + (u(G, "row_", "col_") - 0.5) * 2 * scale))
    return px.withColumn(value, F.when(hit, moved).otherwise(F.col(value).cast("double")))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 360), saturation and value in [0, 1] of 8-bit bands."""
    r, g, b = (c / 255.0 for c in (r, g, b))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(hi - lo, F.lit(0.0))
    hue = F.when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return F.coalesce(hue, F.lit(0.0)), F.coalesce((hi - lo) / F.nullif(hi, F.lit(0.0)), F.lit(0.0)), hi


def rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """8-bit bands of hue, saturation and value."""

    def band(n: int) -> Column:
        k = F.pmod(n + h / 60.0, F.lit(6.0))
        return F.rint((v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255).cast("int")

    return band(5), band(3), band(1)


def hsv_jitter(px: DataFrame, brightness: float, saturation: float, hue: float, seed: int) -> DataFrame:
    """Brightness, saturation and hue of an image varied by seeded factors of its own."""
    u = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), G), F.lit(1 << 20)) / float(1 << 20) * 2 - 1
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    r, g, b = rgb(F.pmod(h + u("h") * hue, F.lit(360.0)), unit(s * (1 + u("s") * saturation)), unit(v * (1 + u("v") * brightness)))
    return px.withColumns({"r": r, "g": g, "b": b})


def heat_overlay(px: DataFrame, share: float = 0.2) -> DataFrame:
    """`heat8`: the sigmoid heat as 0..255, and `overlay`: that over the grey image."""
    h = 255.0 / (1 + F.exp(-F.col("heat")))
    return px.withColumns({"heat8": h, "overlay": share * (F.col("b") + F.col("g") + F.col("r")) / 3 + (1 - share) * h})


def one_hot(label: Column, n: int, eps: float = 0.0) -> Column:
    """Array of n with 1 - eps at the label and eps / (n - 1) elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == label, 1 - eps).otherwise(eps / (n - 1)))
