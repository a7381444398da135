"""Walks on road graphs, and the topology score that compares what two graphs' walks pass.

A graph is nodes (image_id, node_id, lat, lon) and directed edges (image_id,
edge_id, n1, n2[, layer]); roads are walked both ways. A position on an edge is
(n1, n2, d1, d2), the distances to both ends in degrees. Samples and distances
use final shortest distances, so no order of visits shows in them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.operators import iterate, matching, regions, walks

G = "image_id"

#: Links of images that one task walks (walks.Roads); images with more go by joins. Starts that a task has.
MOST = 50_000
STARTS = 2_000


def _links(nodes: DataFrame, dedges: DataFrame, directed: bool = False) -> DataFrame:
    """(image_id, u, v, l, lat1, lon1, lat2, lon2[, hidden], two_way): steps along roads, each once; l takes its width from v."""
    layer = F.col("layer") if "layer" in dedges.columns else F.lit(0)
    e = dedges.where("n1 <> n2").select(G, "n1", "n2", layer.alias("layer"))
    both = e.select(G, F.col("n1").alias("u"), F.col("n2").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("back"), "layer")
    both = both.union(e.select(G, "n2", "n1", F.lit(0), F.lit(1), "layer"))
    one = both.groupBy(G, "u", "v").agg(F.max("out").alias("out"), F.max("back").alias("back"), (F.min("layer") < 0).alias("hidden"))
    if directed:
        one = one.where("out = 1")
    p = nodes.select(G, "node_id", "lat", "lon")
    j = one.join(p.toDF(G, "u", "lat1", "lon1"), [G, "u"]).join(p.toDF(G, "v", "lat2", "lon2"), [G, "v"])
    return j.select(G, "u", "v", geo.deg_distance("lat2", "lon2", "lat1", "lon1").alias("l"), "lat1", "lon1", "lat2", "lon2", "hidden", ((F.col("out") == 1) & (F.col("back") == 1)).alias("two_way"))


def edge_position_distance(nodes: DataFrame, dedges: DataFrame, pairs: DataFrame, max_dist: float) -> DataFrame:
    """(image_id, pair, dist): network distance between two positions of pairs(image_id, pair, a1, a2, ad1, ad2, b1, b2, bd1, bd2).

    On one edge the difference of offsets, whichever way round it is given;
    else the least way from either end of the first position's edge, both at
    its first offset, over nodes at most max_dist off, to an end of the second's
    and on to its offset there; 100000 where there is none. The ends of the
    first edge are never entered again.
    """
    same = (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))
    turned = (F.col("a1") == F.col("b2")) & (F.col("a2") == F.col("b1"))
    pairs = iterate.cut(pairs)
    links = iterate.cut(_links(nodes, dedges))
    other = pairs.where(~same & ~turned)
    seeds = other.select(G, F.struct("a1", "a2", "ad1").alias("source"), F.explode(F.array("a1", "a2")).alias("node"), F.col("ad1").alias("dist")).distinct()
    near = iterate.shortest_paths(links.select(G, F.col("u").alias("a"), F.col("v").alias("b"), F.col("l").alias("w")), seeds, G, max_dist=max_dist, directed=True)
    ends = other.select(G, "pair", F.struct("a1", "a2", "ad1").alias("source"), F.explode(F.array(F.struct(F.col("b1").alias("node"), F.col("b2").alias("far"), F.col("bd1").alias("off")), F.struct(F.col("b2").alias("node"), F.col("b1").alias("far"), F.col("bd2").alias("off")))).alias("e"), "a1", "a2")
    ends = ends.select(G, "pair", "source", "e.node", "e.far", "e.off", "a1", "a2").where("far <> a1 and far <> a2")
    linked = ends.join(links.select(G, F.col("u").alias("node"), F.col("v").alias("far")), [G, "node", "far"], "left_semi")
    best = linked.join(near, [G, "source", "node"]).groupBy(G, "pair").agg(F.min(F.col("dist") + F.col("off")).alias("way"))
    on_edge = F.when(same, F.abs(F.col("ad1") - F.col("bd1"))).when(turned, F.abs(F.col("ad1") - F.col("bd2")))
    return pairs.join(best, [G, "pair"], "left").select(G, "pair", F.coalesce(on_edge, "way", F.lit(100000.0)).alias("dist"))


def walk(nodes: DataFrame, dedges: DataFrame, starts: DataFrame, step: float = 0.00005, r: float | str = 0.003, doubled: bool = False, directed: bool = False, keep: Callable[[Column, Column], Column] | None = None, shift: float = 0.00001) -> DataFrame:
    """(image_id, start, lat, lon, dlat, dlon): samples every `step` along all roads within network distance r of starts.

    starts: (image_id, start, n1, n2, d1, d2), or (image_id, start, node) for a
    walk from a node. The start's own edge is sampled from n2 on. Every other
    road is sampled from the nearer end (the smaller node at a tie) at whole
    multiples of step, and from the other end as far as that left it open; the
    road by which a node was reached is not walked back. doubled: a second
    sample, shifted, where a road goes both ways. r: a number or a column of
    starts. keep: a condition on (lat, lon). Roads of a layer below 0 give no
    samples, but their own start does.
    """
    radius = F.col(r) if isinstance(r, str) else F.lit(float(r))
    starts = starts.select(G, "start", *(("n1", "n2", "d1", "d2") if "n1" in starts.columns else ("node",)), radius.alias("_r"))
    pts = _by_size([(nodes, dedges)], [starts], lambda links, x: _walk_whole(*links, *x, step), lambda g, x: _walk_joined(*g[0], *x, step, directed), directed)
    if doubled:
        pts = iterate.cut(pts)
        pts = pts.union(pts.where("two_way").select(G, "start", F.col("lat") + shift, F.col("lon") + shift, "dlat", "dlon", "two_way"))
    pts = pts.drop("two_way")
    return pts.where(keep(F.col("lat"), F.col("lon"))) if keep else pts


def _by_size(graphs: list[tuple[DataFrame, DataFrame]], tables: list[DataFrame], small: Callable[[list[DataFrame], list[DataFrame]], DataFrame], large: Callable[[list[tuple[DataFrame, DataFrame]], list[DataFrame]], DataFrame], directed: bool = False) -> DataFrame:
    """small(links of the graphs, tables) of images with at most MOST links in all graphs, large(graphs, tables) of the others."""
    links = [iterate.cut(_links(*g, directed)) for g in graphs]
    if not all(regions.countable(x.schema[c].dataType) for x, c in [*((x, "u") for x in links), *((x, c) for x in tables for c in (G, "start"))]):
        return large(graphs, tables)
    every = links[0].select(G)
    for x in links[1:]:
        every = every.union(x.select(G))
    big = regions.over_limit(every, G, MOST)
    if big is None:
        return small(links, tables)
    big = big.select(G)
    few, many = (lambda x: x.join(big, G, "left_anti")), (lambda x: x.join(big, G, "left_semi"))
    got = small([few(x) for x in links], [few(x) for x in tables])
    return got.unionByName(large([tuple(many(x) for x in g) for g in graphs], [many(x) for x in tables]))


def _walk_whole(links: DataFrame, starts: DataFrame, step: float) -> DataFrame:
    """Samples of walks, with two_way, of images that a task can hold."""

    def work(t: list[iterate.Side]) -> Iterator[dict[str, np.ndarray]]:
        roads, (ids, x) = walks.Roads(t[0]), _starts_of(t[1])
        for rows in walks.blocks(len(ids), len(roads.u)):
            y = _some(x, rows)
            s = roads.walk(y, y["_r"], step)
            yield {"start": ids[rows][s[0]], **dict(zip(("lat", "lon", "dlat", "dlon", "two_way"), s[1:], strict=True))}

    known = iterate.cut(starts.where("start is not null and _r is not null"))
    return iterate.by_group([links, known], work, f"start {starts.schema['start'].dataType.simpleString()}, lat double, lon double, dlat double, dlon double, two_way boolean", STARTS)


def _starts_of(x: iterate.Side) -> tuple[np.ndarray, iterate.Side]:
    """Different starts, and their rows with the place of the start (at), the first radius of each."""
    ids, first, at = np.unique(x["start"], return_index=True, return_inverse=True)
    if "node" in x:
        return ids, {**x, "at": at, "_r": x["_r"][first]}
    return ids, {c: v[first] for c, v in x.items()}


def _some(x: iterate.Side, rows: np.ndarray) -> iterate.Side:
    """The rows of some starts, numbered from 0."""
    if "at" not in x:
        return {c: v[rows] for c, v in x.items()}
    mine = (x["at"] >= rows[0]) & (x["at"] <= rows[-1])
    return {c: v[rows] if c == "_r" else v[mine] - rows[0] if c == "at" else v[mine] for c, v in x.items()}


def _walk_joined(nodes: DataFrame, dedges: DataFrame, starts: DataFrame, step: float, directed: bool) -> DataFrame:
    """Samples of walks from starts(image_id, start, n1, n2, d1, d2, _r) or (image_id, start, node, _r), with two_way, by joins."""
    own = "n1" in starts.columns
    seeds = [F.struct(F.col("n1").alias("node"), F.col("d1").alias("dist")), F.struct(F.col("n2").alias("node"), F.col("d2").alias("dist"))] if own else [F.struct("node", F.lit(0.0).alias("dist"))]
    starts = iterate.cut(starts)
    links = iterate.cut(_links(nodes, dedges, directed))
    begin = starts.select(G, F.struct("start", "_r").alias("source"), F.explode(F.array(*seeds)).alias("s")).select(G, "source", "s.node", "s.dist").where("dist <= source._r")
    far = _bounded_paths(links, begin)
    shut = starts.select(G, F.col("start"), *(F.col(c) for c in (("n1", "n2") if own else ("node", "node")))).toDF(G, "start", "x1", "x2")
    if not own:
        shut = shut.withColumns({"x1": F.lit(None).cast("long"), "x2": F.lit(None).cast("long")})
    d = far.select(G, F.col("source.start").alias("start"), F.col("source._r").alias("r"), "node", "dist").join(shut, [G, "start"])
    steps = d.withColumnRenamed("node", "u").join(links, [G, "u"]).where("x1 is null or (v <> x1 and v <> x2)")
    at = d.select(G, "start", F.col("node").alias("v"), F.col("dist").alias("dv"))
    seen = steps.join(at, [G, "start", "v"], "left")
    # the neighbour that a node was reached from; a start's own nodes have none
    came = seen.where("dv is not null").groupBy(G, "start", "v").agg(F.min(F.struct((F.col("dist") + F.col("l")).alias("d"), F.col("u").alias("u"))).alias("p"), F.first("dv").alias("dv"))
    came = came.where(F.col("p.d") <= F.col("dv") * (1 + 1e-12)).select(G, "start", F.col("v").alias("u"), F.col("p.u").alias("came"))
    if not own:
        came = came.join(starts.select(G, "start", F.col("node").alias("u")), [G, "start", "u"], "left_anti")
    seen = iterate.cut(seen.join(came, [G, "start", "u"], "left").where("came is null or v <> came"))

    bias = F.lit(step) * F.ceil(F.col("dist") / step) - F.col("dist")
    count = F.floor((F.least(F.col("l") - 1e-15, F.col("r") - F.col("dist")) - F.col("bias")) / step + 1e-9)
    seen = seen.withColumn("bias", bias).withColumn("n", F.greatest(count, F.lit(-1)))
    # which way comes first: from the nearer end
    back = seen.select(G, "start", F.col("v").alias("u"), F.col("u").alias("v"), F.struct("dist", F.col("u").alias("k")).alias("o"), (F.col("bias") + F.col("n") * step).alias("covered"))
    both = seen.join(back, [G, "start", "u", "v"], "left")
    first = F.col("o").isNull() | (F.struct("dist", F.col("u").alias("k")) <= F.col("o"))
    limit = F.when(first, F.col("l")).otherwise(F.col("l") - F.col("covered"))
    k = both.where("n >= 0 and not hidden").withColumn("limit", limit).withColumn("off", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n")), lambda i: F.col("bias") + i * step)))
    k = k.where("off <= limit and off < l and dist + off <= r * (1 + 1e-12)")
    part = F.col("off") / F.col("l")
    pts = k.select(G, "start", (F.col("lat2") * part + F.col("lat1") * (1 - part)).alias("lat"), (F.col("lon2") * part + F.col("lon1") * (1 - part)).alias("lon"), (F.col("lat2") - F.col("lat1")).alias("dlat"), (F.col("lon2") - F.col("lon1")).alias("dlon"), "two_way")
    if own:
        e = starts.join(links.select(G, F.col("u").alias("n1"), F.col("v").alias("n2"), "l", "lat1", "lon1", "lat2", "lon2", "two_way"), [G, "n1", "n2"])
        e = e.withColumn("al", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("l") / step + 1e-9)), lambda i: i * step / F.col("l"))))
        e = e.withColumns({"lat": F.col("lat1") * F.col("al") + F.col("lat2") * (1 - F.col("al")), "lon": F.col("lon1") * F.col("al") + F.col("lon2") * (1 - F.col("al"))})
        near = (F.col("d1") - geo.deg_distance("lat", "lon", "lat1", "lon1") < F.col("_r")) | (F.col("d2") - geo.deg_distance("lat", "lon", "lat2", "lon2") < F.col("_r"))
        pts = pts.union(e.where(near).select(G, "start", "lat", "lon", (F.col("lat2") - F.col("lat1")).alias("dlat"), (F.col("lon2") - F.col("lon1")).alias("dlon"), "two_way"))
    return pts.distinct()


def _bounded_paths(links: DataFrame, begin: DataFrame) -> DataFrame:
    """shortest_paths from begin(image_id, source: struct with _r, node, dist), each source up to its own radius."""
    w = links.select(G, F.col("u").alias("a"), F.col("v").alias("b"), F.col("l").alias("w"))
    top = begin.agg(F.max("source._r").alias("m")).first()["m"]
    got = iterate.shortest_paths(w, begin, G, max_dist=float(top) if top is not None else 0.0, directed=True)
    return iterate.cut(got.where("dist <= source._r"))


def walk_from_nodes(nodes: DataFrame, dedges: DataFrame, starts: DataFrame, step: float = 0.00005, r: float = 0.003, directed: bool = False) -> DataFrame:
    """(image_id, start, lat, lon): samples of walks from starts(image_id, start, node) over nodes and edges whose scores, if any, are over 0."""
    return walk(nodes, _scored(nodes, dedges), starts, step, r, directed=directed).select(G, "start", "lat", "lon").distinct()


def _scored(nodes: DataFrame, dedges: DataFrame) -> DataFrame:
    """Edges that count: their scores and those of their second nodes, if any, are over 0."""
    ok = dedges.where("score > 0") if "score" in dedges.columns else dedges
    if "score" in nodes.columns:
        ok = ok.join(nodes.where("score > 0").select(G, F.col("node_id").alias("n2")), [G, "n2"], "left_semi")
    return ok


def evaluation_window(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(image_id, min_lat, min_lon, max_lat, max_lon, radius) around the nodes (image_id, lat, lon) of both graphs: 300 m off the latitudes, 500 m off the longitudes, the anchor included; half the radius for a low box."""
    both = pred.select(G, "lat", "lon").union(truth.select(G, "lat", "lon"))
    box = both.groupBy(G).agg(F.least(F.min("lat"), F.lit(geo.LAT0)).alias("lo"), F.greatest(F.max("lon"), F.lit(geo.LON0)).alias("hi"))
    m = geo.METRES
    return box.select(
        G,
        (F.col("lo") - 300 / m).alias("min_lat"),
        F.lit(geo.LON0 - 500 / m).alias("min_lon"),
        F.lit(geo.LAT0 + 300 / m).alias("max_lat"),
        (F.col("hi") + 500 / m).alias("max_lon"),
        F.when(geo.LAT0 - F.col("lo") < 0.01, 0.0015).otherwise(0.003).alias("radius"),
    )


def starting_points(nodes: DataFrame, dedges: DataFrame, window: DataFrame, density: float = 0.0005, margin: float = 0.07, mask: DataFrame | None = None, mask_size: tuple[int, int] | None = None) -> DataFrame:
    """(image_id, start, lat, lon, n1, n2, d1, d2): evenly spaced interior positions of every run of at least half the density.

    A run of length D has max(trunc(D / density), 1). Positions keep `margin` of
    the window's extent off its sides, or, with a mask (image_id, row_, col_) of
    mask_size, lie on its pixels. A position on a node belongs to both its
    edges; edges of a layer below 0 have none. start numbers them in order of
    runs.
    """
    und = dedges.select(G, F.col("n1").alias("a"), F.col("n2").alias("b"))
    r = iterate.runs(und, G)
    deg = iterate.degree(und, G)
    head = r.where("pos = 0").select(G, "chain", F.col("a").alias("node")).join(deg, [G, "node"]).where("degree <> 2").select(G, "chain")
    p = nodes.select(G, "node_id", "lat", "lon")
    leg = r.join(head, [G, "chain"]).join(p.toDF(G, "a", "lat1", "lon1"), [G, "a"]).join(p.toDF(G, "b", "lat2", "lon2"), [G, "b"]).withColumn("l", geo.deg_distance("lat1", "lon1", "lat2", "lon2"))
    w = Window.partitionBy(G, "chain").orderBy("pos")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leg = leg.withColumns({"to": F.sum("l").over(w), "total": F.sum("l").over(every)})
    leg = leg.withColumn("from", F.col("to") - F.col("l")).where(F.col("total") >= density / 2)
    n = F.greatest((F.col("total") / density).cast("long"), F.lit(1))
    if "layer" in dedges.columns:
        low = dedges.where("layer < 0").select(G, F.least("n1", "n2").alias("x"), F.greatest("n1", "n2").alias("y")).distinct()
        leg = leg.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(low, [G, "x", "y"], "left_anti")
    s = leg.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("at", F.col("i") / (F.col("n") + 1) * F.col("total"))
    # a node between two legs is on both, up to rounding of the sums
    eps = F.col("total") * 1e-12
    s = s.where((F.col("at") >= F.col("from") - eps) & (F.col("at") <= F.col("to") + eps))
    a = F.least(F.greatest((F.col("at") - F.col("from")) / F.col("l"), F.lit(0.0)), F.lit(1.0))
    s = s.withColumn("f", a).withColumns({"lat": (1 - F.col("f")) * F.col("lat1") + F.col("f") * F.col("lat2"), "lon": (1 - F.col("f")) * F.col("lon1") + F.col("f") * F.col("lon2")})
    s = s.join(window, G)
    if mask is None:
        dx, dy = margin * (F.col("max_lat") - F.col("min_lat")), margin * (F.col("max_lon") - F.col("min_lon"))
        s = s.where((F.col("lat") - F.col("min_lat") > dx) & (F.col("max_lat") - F.col("lat") > dx) & (F.col("lon") - F.col("min_lon") > dy) & (F.col("max_lon") - F.col("lon") > dy))
    else:
        row, col = geo.window_index("lat", "lon", "min_lat", "min_lon", "max_lat", "max_lon", *mask_size)
        s = s.withColumns({"row_": row, "col_": col}).where((F.col("row_") > 0) & (F.col("row_") < mask_size[0]) & (F.col("col_") > 0) & (F.col("col_") < mask_size[1]))
        s = s.join(mask.select(G, "row_", "col_").distinct(), [G, "row_", "col_"], "left_semi")
    order = Window.partitionBy(G).orderBy("chain", "i", "pos")
    off = F.col("f") * F.col("l")
    return s.select(G, (F.row_number().over(order) - 1).cast("long").alias("start"), "lat", "lon", F.col("a").alias("n1"), F.col("b").alias("n2"), off.alias("d1"), (F.col("l") - off).alias("d2"))


def pair_starts(nodes: DataFrame, dedges: DataFrame, truth_nodes: DataFrame, starts: DataFrame, threshold: float = 0.0001, subset: DataFrame | None = None, single: bool = False) -> DataFrame:
    """(image_id, start, edge_id, n1, n2, d1, d2, lat, lon): each starting point of the truth with its nearest edge of the other graph.

    An edge has to be nearer than the threshold and, unless only those of
    subset(image_id, edge_id) are asked, point the same way within 0.04 of a
    cosine. The smaller edge id wins a tie; single keeps an image's first.
    """
    p = nodes.select(G, "node_id", "lat", "lon")
    t = truth_nodes.select(G, "node_id", "lat", "lon")
    e = dedges if subset is None else dedges.join(subset, [G, "edge_id"], "left_semi")
    e = e.select(G, "edge_id", F.col("n1").alias("m1"), F.col("n2").alias("m2")).join(p.toDF(G, "m1", "lat1", "lon1"), [G, "m1"]).join(p.toDF(G, "m2", "lat2", "lon2"), [G, "m2"])
    s = starts.join(t.toDF(G, "n1", "lat3", "lon3"), [G, "n1"]).join(t.toDF(G, "n2", "lat4", "lon4"), [G, "n2"])
    j = matching.segment_box_join(s, e, 2 * threshold, 10 * threshold, G)
    c = F.cos(F.radians("lat1"))
    zero = F.lit(0.0)
    dist = geo.point_segment_distance(F.col("lat") - F.col("lat1"), (F.col("lon") - F.col("lon1")) * c, zero, zero, F.col("lat2") - F.col("lat1"), (F.col("lon2") - F.col("lon1")) * c)
    j = j.withColumn("dist", dist).where(F.col("dist") < threshold)
    if subset is None:
        (a1, b1), (a2, b2) = geo.unit_vec(F.col("lat2") - F.col("lat1"), F.col("lon2") - F.col("lon1")), geo.unit_vec(F.col("lat4") - F.col("lat3"), F.col("lon4") - F.col("lon3"))
        j = j.where(1 - F.abs(a1 * a2 + b1 * b2) < 0.04)
    best = j.groupBy(G, "start").agg(F.min(F.struct("dist", "edge_id", "m1", "m2", geo.deg_distance("lat1", "lon1", "lat", "lon").alias("d1"), geo.deg_distance("lat2", "lon2", "lat", "lon").alias("d2"), "lat", "lon")).alias("m"))
    if single:
        best = best.groupBy(G).agg(F.min(F.struct("start", "m")).alias("s")).select(G, "s.start", "s.m")
    return best.select(G, "start", "m.edge_id", F.col("m.m1").alias("n1"), F.col("m.m2").alias("n2"), "m.d1", "m.d2", "m.lat", "m.lon")


def _headings(nodes: DataFrame, dedges: DataFrame, directed: bool) -> DataFrame:
    """(image_id, node_id, headings): the steps out of every node, and their opposites unless directed."""
    p = nodes.select(G, "node_id", "lat", "lon")
    j = dedges.select(G, F.col("n1").alias("node_id"), "n2").distinct().join(p, [G, "node_id"]).join(p.toDF(G, "n2", "lat2", "lon2"), [G, "n2"])
    a, b = F.col("lat2") - F.col("lat"), F.col("lon2") - F.col("lon")
    way = F.array(F.struct(a.alias("a"), b.alias("b")), *([] if directed else [F.struct((-a).alias("a"), (-b).alias("b"))]))
    return j.groupBy(G, "node_id").agg(F.flatten(F.collect_list(way)).alias("headings"))


def pair_nodes(nodes: DataFrame, dedges: DataFrame, truth_nodes: DataFrame, truth_edges: DataFrame, mask: DataFrame, window: DataFrame, mask_size: tuple[int, int], threshold: float = 0.0001, check: bool = True, directed: bool = False) -> DataFrame:
    """(image_id, truth_node, node): nodes of a graph with the nearest node of the truth on a mask that has a road in nearly the same direction.

    With check, only ends of edges that count: both nodes' and the edge's scores
    at least 1, neither node deleted or terminal (columns score, deleted,
    terminal of nodes and score of dedges, where present). Where several nodes
    have one truth node, the largest is kept.
    """
    e = dedges
    if check:
        ok = nodes
        for c, good in (("score", F.col("score") >= 1), ("deleted", ~F.col("deleted")), ("terminal", ~F.col("terminal"))):
            ok = ok.where(good) if c in nodes.columns else ok
        for c in ("n1", "n2"):
            e = e.join(ok.select(G, F.col("node_id").alias(c)), [G, c], "left_semi")
        e = e.where("score >= 1") if "score" in dedges.columns else e
    mine = e.select(G, F.explode(F.array("n1", "n2")).alias("node_id")).distinct().join(nodes.select(G, "node_id", "lat", "lon"), [G, "node_id"])
    row, col = geo.window_index("lat", "lon", "min_lat", "min_lon", "max_lat", "max_lon", *mask_size)
    there = truth_nodes.select(G, "node_id", "lat", "lon").join(window, G).withColumns({"row_": row, "col_": col})
    there = there.where((F.col("row_") > 0) & (F.col("row_") < mask_size[0]) & (F.col("col_") > 0) & (F.col("col_") < mask_size[1]))
    # the mask is far larger than the nodes: it runs past a table of them, neither made unique nor sorted; a node found twice is one in the end
    there = there.hint("shuffle_hash").join(mask.select(G, "row_", "col_"), [G, "row_", "col_"])
    a = mine.select(G, F.col("node_id").alias("node"), F.col("lat").alias("ax"), F.col("lon").alias("ay"))
    b = there.select(G, F.col("node_id").alias("truth_node"), F.col("lat").alias("bx"), F.col("lon").alias("by"))
    j = iterate.grid_join(a, b, threshold * 1.5, G).where((F.abs(F.col("ax") - F.col("bx")) <= threshold) & (F.abs(F.col("ay") - F.col("by")) <= threshold))
    h1 = _headings(nodes, dedges, directed).toDF(G, "node", "h1")
    h2 = _headings(truth_nodes, truth_edges, directed).toDF(G, "truth_node", "h2")
    alike = F.exists("h1", lambda p: F.exists("h2", lambda q: geo.angle_distance(p["a"], p["b"], q["a"], q["b"]) < 0.1))
    j = j.join(h1, [G, "node"]).join(h2, [G, "truth_node"]).where(alike).withColumn("d", geo.deg_distance("ax", "ay", "bx", "by")).where(F.col("d") <= threshold)
    best = j.groupBy(G, "node").agg(F.min(F.struct("d", "truth_node")).alias("m"))
    return best.groupBy(G, F.col("m.truth_node").alias("truth_node")).agg(F.max("node").alias("node"))


def sample_matches(a: DataFrame, b: DataFrame, threshold: float, angle: float = 0.29, zero_rule: bool = True) -> DataFrame:
    """(image_id, start, a, b, dist, angle): samples (image_id, start, id, lat, lon, dlat, dlon) of one start nearer than the threshold whose roads point alike, either way round.

    The width of a degree is that of a's sample. With zero_rule, a direction
    whose two parts are equal points anywhere.
    """
    p = a.select(F.struct(G, "start").alias("k"), F.col("id").alias("ida"), F.col("lat").alias("ax"), F.col("lon").alias("ay"), F.col("dlat").alias("adx"), F.col("dlon").alias("ady"))
    q = b.select(F.struct(G, "start").alias("k"), F.col("id").alias("idb"), F.col("lat").alias("bx"), F.col("lon").alias("by"), F.col("dlat").alias("bdx"), F.col("dlon").alias("bdy"))
    # in plain degrees a pair can be 1.8 thresholds apart
    j = iterate.grid_join(p, q, threshold * 1.8, "k").withColumn("d", geo.deg_distance("ax", "ay", "bx", "by")).where(F.col("d") < threshold)
    (a1, b1), (a2, b2) = geo.unit_vec("adx", "ady"), geo.unit_vec("bdx", "bdy")
    off = 1 - F.abs(a1 * a2 + b1 * b2)
    if zero_rule:
        off = F.when((F.col("adx") != F.col("ady")) & (F.col("bdx") != F.col("bdy")), off).otherwise(0.0)
    return j.withColumn("angle", off).where(F.col("angle") < angle).select(f"k.{G}", "k.start", F.col("ida").alias("a"), F.col("idb").alias("b"), F.col("d").alias("dist"), "angle")


def matched_samples(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame], pairs: DataFrame, starts: DataFrame, threshold: float, r: float, step: float = 0.00005) -> DataFrame:
    """(image_id, start, pairs, dist): number and total distance of sample_matches of both graphs' walks from paired starts, of those that have some."""
    kind = pairs.schema["start"].dataType.simpleString()

    def small(links: list[DataFrame], x: list[DataFrame]) -> DataFrame:
        def work(t: list[iterate.Side]) -> Iterator[dict[str, np.ndarray]]:
            a, b, s = walks.Roads(t[0]), walks.Roads(t[1]), t[2]
            for rows in walks.blocks(len(s["start"]), len(a.u) + len(b.u)):
                y = {c: v[rows] for c, v in s.items()}
                reach = np.full(len(rows), float(r))
                marbles, holes = a.walk(y, reach, step), b.walk({c: y[f"t{c}"] for c in ("n1", "n2", "d1", "d2")}, reach, step)
                i, _, d, _ = walks.matches(marbles, holes, threshold, 0.29, True)
                n = np.bincount(marbles[0][i], minlength=len(rows))
                total = np.bincount(marbles[0][i], weights=d, minlength=len(rows))
                yield {"start": y["start"][n > 0], "pairs": n[n > 0], "dist": total[n > 0]}

        return iterate.by_group([*links, iterate.cut(_both_starts(*x))], work, f"start {kind}, pairs long, dist double", STARTS)

    def large(g: list[tuple[DataFrame, DataFrame]], x: list[DataFrame]) -> DataFrame:
        m, h = (_numbered(walk(*graph, s, step, r)) for graph, s in zip(g, x, strict=True))
        return sample_matches(m, h, threshold).groupBy(G, "start").agg(F.count("*").alias("pairs"), F.sum("dist").alias("dist"))

    return _by_size([pred, truth], [pairs, starts], small, large)


def _numbered(samples: DataFrame) -> DataFrame:
    w = Window.partitionBy(G, "start").orderBy("lat", "lon", "dlat", "dlon")
    return iterate.cut(samples.withColumn("id", F.row_number().over(w).cast("long")))


def start_scores(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame], pairs: DataFrame, starts: DataFrame, step: float = 0.00005, threshold: float = 0.0001, one_to_one: bool = True) -> DataFrame:
    """(image_id, start, lat, lon, precision, recall, n1, n2, d1, d2) of every paired starting point: what both graphs' walks from it have in common.

    Precision matches samples of the prediction with the truth's doubled ones,
    recall the truth's (tunnels left out) with the prediction's; not one to one
    it counts all pairs. Starts where either walk is empty are left out.
    pairs and starts carry the walk's radius in column r.
    """
    kind = pairs.schema["start"].dataType.simpleString()

    def small(links: list[DataFrame], x: list[DataFrame]) -> DataFrame:
        def work(t: list[iterate.Side]) -> Iterator[dict[str, np.ndarray]]:
            a, b, s = walks.Roads(t[0]), walks.Roads(t[1]), t[2]
            for rows in walks.blocks(len(s["start"]), len(a.u) + len(b.u)):
                y = {c: v[rows] for c, v in s.items()}
                theirs = {c: y[f"t{c}"] for c in ("n1", "n2", "d1", "d2")}
                marbles, holes = a.walk(y, y["r"], step), b.walk(theirs, y["tr"], step)
                double = walks.doubled(b.walk(theirs, y["tr"], step, tunnels=True) if b.hidden.any() else holes, 0.00001)
                nm, nh = (np.bincount(v[0], minlength=len(rows)) for v in (marbles, holes))

                def hits(v: walks.Samples, w: walks.Samples) -> np.ndarray:
                    i, j = walks.matches(v, w, threshold, 0.29, True)[:2]
                    return walks.most_together(v[0][i], i, j, len(rows)) if one_to_one else np.bincount(v[0][i], minlength=len(rows))

                ok = (nm > 0) & (nh > 0)
                out = {c: y[c][ok] for c in ("start", "lat", "lon", "n1", "n2", "d1", "d2")}
                yield {**out, "precision": (hits(marbles, double)[ok] / nm[ok]), "recall": (hits(holes, marbles)[ok] / nh[ok])}

        node = pairs.schema["n1"].dataType.simpleString()
        return iterate.by_group([*links, iterate.cut(_both_starts(*x))], work, f"start {kind}, precision double, recall double, lat double, lon double, n1 {node}, n2 {node}, d1 double, d2 double", STARTS)

    return _by_size([pred, truth], [pairs, starts], small, lambda g, x: _start_scores_joined(*g, *x, step, threshold, one_to_one))


def _both_starts(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """(image_id, start, n1, n2, d1, d2, r, tn1, tn2, td1, td2, tr, lat, lon): paired starts on both graphs."""
    theirs = starts.select(G, "start", *(F.col(c).alias(f"t{c}") for c in ("n1", "n2", "d1", "d2", "r")), "lat", "lon")
    return pairs.select(G, "start", "n1", "n2", "d1", "d2", "r").join(theirs, [G, "start"])


def _start_scores_joined(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame], pairs: DataFrame, starts: DataFrame, step: float, threshold: float, one_to_one: bool) -> DataFrame:
    """start_scores by joins of samples."""
    key = ["start"]
    a = pairs.select(G, "start", "n1", "n2", "d1", "d2", "r")
    b = starts.join(pairs.select(G, "start"), [G, "start"], "left_semi").select(G, "start", "n1", "n2", "d1", "d2", "r")
    marbles = _numbered(walk(*pred, a, step, "r"))
    holes = _numbered(walk(*truth, b, step, "r"))
    open_edges = truth[1].drop("layer") if "layer" in truth[1].columns else truth[1]
    double = _numbered(walk(truth[0], open_edges, b, step, "r", doubled=True))

    def hits(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        m = sample_matches(x, y, threshold)
        got = matching.matching_sizes(m.select(G, "start", "a", "b"), [G, *key]) if one_to_one else m.groupBy(G, *key).agg(F.count("*").alias("matched"))
        return got.withColumnRenamed("matched", name)

    n = marbles.groupBy(G, "start").agg(F.count("*").alias("nm")).join(holes.groupBy(G, "start").agg(F.count("*").alias("nh")), [G, "start"])
    out = n.join(hits(marbles, double, "p"), [G, "start"], "left").join(hits(holes, marbles, "h"), [G, "start"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select(G, "start", (zero("p") / F.col("nm")).alias("precision"), (zero("h") / F.col("nh")).alias("recall"))
    return out.join(starts.select(G, "start", "lat", "lon"), [G, "start"]).join(pairs.select(G, "start", "n1", "n2", "d1", "d2"), [G, "start"])


def thin(results: DataFrame, nodes: DataFrame, dedges: DataFrame, near: float = 0.0002, reach: float = 0.0003, sure: float = 0.9) -> DataFrame:
    """Results (image_id, start, lat, lon, precision, n1, n2, d1, d2) one to one: by falling precision, each kept one drops those within `near` along the roads that have less than `sure`."""
    r = iterate.cut(results)
    a = r.select(G, F.col("start").alias("s"), F.col("lat").alias("ax"), F.col("lon").alias("ay"), F.col("n1").alias("a1"), F.col("n2").alias("a2"), F.col("d1").alias("ad1"), F.col("d2").alias("ad2"))
    b = r.select(G, F.col("start").alias("t"), F.col("lat").alias("bx"), F.col("lon").alias("by"), F.col("n1").alias("b1"), F.col("n2").alias("b2"), F.col("d1").alias("bd1"), F.col("d2").alias("bd2"))
    wide = reach / F.cos(F.radians("ax")) + 1e-6
    box = iterate.grid_join(a, b, reach * 2.2, G).where((F.abs(F.col("ax") - F.col("bx")) <= reach + 1e-6) & (F.abs(F.col("ay") - F.col("by")) <= wide) & (F.col("s") != F.col("t")))
    d = edge_position_distance(nodes, dedges, box.select(G, F.struct("s", "t").alias("pair"), "a1", "a2", "ad1", "ad2", "b1", "b2", "bd1", "bd2"), reach)
    order = Window.partitionBy(G).orderBy(F.desc("precision"), F.desc("start"))
    ranked = iterate.cut(r.select(G, "start", "precision", F.row_number().over(order).cast("long").alias("id")))
    i = ranked.select(G, F.col("start").alias("s"), F.col("id").alias("a"))
    j = ranked.where(F.col("precision") < sure).select(G, F.col("start").alias("t"), F.col("id").alias("b"))
    close = d.where(F.col("dist") < near).select(G, "pair.s", "pair.t").join(i, [G, "s"]).join(j, [G, "t"]).where("a < b").select(G, "a", "b")
    taken = iterate.ordered_greedy(ranked.select(G, "id"), close, G).where("taken").select(G, "id")
    return r.join(ranked.join(taken, [G, "id"]).select(G, "start"), [G, "start"], "left_semi")


def averages(kept: DataFrame, starts: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, precision, recall) of kept results: means, the recall scaled by the share of starting points kept; zeros without any."""
    k = kept.groupBy(G).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.count("*").alias("k"))
    n = starts.groupBy(G).agg(F.count("*").alias("n"))
    j = images.select(G).distinct().join(k, G, "left").join(n, G, "left")
    return j.select(G, F.coalesce("p", F.lit(0.0)).alias("precision"), F.coalesce(F.col("r") * F.col("k") / F.col("n"), F.lit(0.0)).alias("recall"))


class _Pair:
    """Both graphs of all images with their window, starting points and pairs."""

    def __init__(self, pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame], threshold: float, density: float):
        self.pred, self.truth = tuple(iterate.cut(x) for x in pred), tuple(iterate.cut(x) for x in truth)
        self.window = iterate.cut(evaluation_window(self.pred[0], self.truth[0]))
        r = self.window.select(G, F.col("radius").alias("r"))
        self.starts = iterate.cut(starting_points(*self.truth, self.window, density).join(r, G))
        self.pairs = iterate.cut(pair_starts(*self.pred, self.truth[0], self.starts, threshold).join(r, G))


def topo(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame], step: float = 0.00005, threshold: float = 0.0001, density: float = 0.0005, one_to_one: bool = True) -> DataFrame:
    """(image_id, precision, recall): the topology score of road graphs (nodes, directed edges) for every image of either."""
    x = _Pair(pred, truth, threshold, density)
    scores = start_scores(x.pred, x.truth, x.pairs, x.starts, step, threshold, one_to_one)
    kept = thin(scores, *x.pred)
    return averages(kept, x.starts, x.truth[0].select(G).union(x.pred[0].select(G)))


def _any_match(a: DataFrame, b: DataFrame, threshold: float, turned: bool = False) -> DataFrame:
    """(image_id, start, share): the share of a's samples that have one of b's nearer than the threshold, the width of a degree that of the first graph's sample."""
    p = a.select(F.struct(G, "start").alias("k"), F.col("id").alias("ida"), F.col("lat").alias("ax"), F.col("lon").alias("ay"))
    q = b.select(F.struct(G, "start").alias("k"), F.col("lat").alias("bx"), F.col("lon").alias("by"))
    d = geo.deg_distance("bx", "by", "ax", "ay") if turned else geo.deg_distance("ax", "ay", "bx", "by")
    hit = iterate.grid_join(p, q, threshold * 1.8, "k").where(d < threshold).select("k", "ida").distinct().groupBy("k").agg(F.count("*").alias("m"))
    n = p.groupBy("k").agg(F.count("*").alias("n"))
    return n.join(hit, "k", "left").select(f"k.{G}", "k.start", (F.coalesce("m", F.lit(0)) / F.col("n")).alias("share"))


def _node_walks(graph: tuple[DataFrame, DataFrame], starts: DataFrame, step: float, r: float) -> DataFrame:
    s = walk_from_nodes(*graph, starts, step, r)
    w = Window.partitionBy(G, "start").orderBy("lat", "lon")
    return iterate.cut(s.withColumn("id", F.row_number().over(w).cast("long")))


def _shares(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame], pairs: DataFrame, step: float, r: float, truth_r: float, threshold: float) -> DataFrame:
    """(image_id, start, precision, recall) of pairs(image_id, start, node, truth_node): the shares of either walk's samples that have one of the other's near; none where a walk is empty."""
    kind = pairs.schema["start"].dataType.simpleString()

    def small(links: list[DataFrame], x: list[DataFrame]) -> DataFrame:
        def work(t: list[iterate.Side]) -> Iterator[dict[str, np.ndarray]]:
            a, b = walks.Roads(t[0]), walks.Roads(t[1])
            ids, s = _starts_of({**t[2], "_r": np.full(len(t[2]["start"]), float(r))})
            for rows in walks.blocks(len(ids), len(a.u) + len(b.u)):
                y = _some(s, rows)
                marbles = walks.distinct(a.walk({"at": y["at"], "node": y["node"]}, y["_r"], step)[:3])
                holes = walks.distinct(b.walk({"at": y["at"], "node": y["truth_node"]}, np.full(len(rows), float(truth_r)), step)[:3])
                out = {}
                for name, v, w, turned in (("precision", marbles, holes, False), ("recall", holes, marbles, True)):
                    n = np.bincount(v[0], minlength=len(rows))
                    out[name] = np.bincount(v[0][walks.any_match(v, w, threshold, turned)], minlength=len(rows)) / np.where(n, n, np.nan)
                ok = np.isfinite(out["precision"]) & np.isfinite(out["recall"])
                yield {"start": ids[rows][ok], **{c: v[ok] for c, v in out.items()}}

        known = x[0].where("start is not null and node is not null and truth_node is not null")
        return iterate.by_group([*links, iterate.cut(known)], work, f"start {kind}, precision double, recall double", STARTS)

    def large(g: list[tuple[DataFrame, DataFrame]], x: list[DataFrame]) -> DataFrame:
        marbles = _node_walks(g[0], x[0].select(G, "start", "node"), step, r)
        holes = _node_walks(g[1], x[0].select(G, "start", F.col("truth_node").alias("node")), step, truth_r)
        p = _any_match(marbles, holes, threshold).withColumnRenamed("share", "precision")
        return p.join(_any_match(holes, marbles, threshold, turned=True).withColumnRenamed("share", "recall"), [G, "start"])

    return _by_size([(g[0], _scored(*g)) for g in (pred, truth)], [pairs], small, large)


def list_scores(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame], pairs: DataFrame, step: float = 0.00005, r: float = 0.003, threshold: float = 0.00015, wider: float = 0.0) -> DataFrame:
    """(image_id, start, precision, recall, avg_precision, avg_recall) of node pairs (image_id, truth_node, node): any-match shares of both walks and their running means by truth_node; pairs with an empty walk are left out."""
    pairs = iterate.cut(pairs.select(G, F.col("truth_node").alias("start"), "node", "truth_node"))
    pred, truth = (tuple(iterate.cut(x) for x in t) for t in (pred, truth))  # each is read several times
    w = Window.partitionBy(G).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return _shares(pred, truth, pairs, step, r, r + wider, threshold).withColumns({"avg_precision": F.avg("precision").over(w), "avg_recall": F.avg("recall").over(w)})


def random_scores(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame], num: int, seed: int = 0, step: float = 0.00005, r: float = 0.003, threshold: float = 0.0002) -> DataFrame:
    """(image_id, precision, recall): means over `num` seeded nodes of the prediction that have a node of the truth within the threshold, the truth's walk one step wider."""
    pred, truth = (tuple(iterate.cut(x) for x in t) for t in (pred, truth))  # each is read several times
    cand = pred[1].select(G, F.explode(F.array("n1", "n2")).alias("node_id")).distinct().join(pred[0].select(G, "node_id", "lat", "lon"), [G, "node_id"])
    a = cand.select(G, F.col("node_id").alias("node"), F.col("lat").alias("ax"), F.col("lon").alias("ay"))
    b = truth[0].select(G, F.col("node_id").alias("truth_node"), F.col("lat").alias("bx"), F.col("lon").alias("by"))
    j = iterate.grid_join(a, b, threshold * 1.8, G).withColumn("d", geo.deg_distance("ax", "ay", "bx", "by")).where(F.col("d") <= threshold)
    best = j.groupBy(G, "node").agg(F.min(F.struct("d", "truth_node"))["truth_node"].alias("truth_node"))
    order = Window.partitionBy(G).orderBy(F.xxhash64(F.lit(seed), G, "node"), "node")
    drawn = iterate.cut(best.withColumn("start", F.row_number().over(order).cast("long")).where(F.col("start") <= num))
    return _shares(pred, truth, drawn.select(G, "start", "node", "truth_node"), step, r, r + step, threshold).groupBy(G).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def soft_scores(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame], pairs: DataFrame, starts: DataFrame, step: float = 0.00005, threshold: float = 0.00015, soft: bool = True, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(image_id, start, n_marbles, n_holes, matched, cost, score, f) of paired starts: samples matched by rising cost.

    A pair costs 1.5 times what its distance exceeds a third of the threshold by
    plus half a threshold for each unit of angle (nothing where not soft), an
    unmatched sample 1.15 thresholds; f joins the smooth precision and recall.
    """
    kind = pairs.schema["start"].dataType.simpleString()

    def small(links: list[DataFrame], x: list[DataFrame]) -> DataFrame:
        def work(t: list[iterate.Side]) -> Iterator[dict[str, np.ndarray]]:
            a, b, s = walks.Roads(t[0]), walks.Roads(t[1]), t[2]
            for rows in walks.blocks(len(s["start"]), len(a.u) + len(b.u)):
                y = {c: v[rows] for c, v in s.items()}
                marbles, holes = a.walk(y, y["r"], step), b.walk({c: y[f"t{c}"] for c in ("n1", "n2", "d1", "d2")}, y["tr"], step)
                i, j, d, angle = walks.matches(marbles, holes, threshold, 0.3, False)
                cost = np.maximum((d - threshold / 3) * 1.5, 0.0) + angle * threshold * 0.5
                matched, total = walks.taken_ascending(marbles[0][i], i, j, cost, len(rows))
                yield {"start": y["start"], "n_marbles": np.bincount(marbles[0], minlength=len(rows)), "n_holes": np.bincount(holes[0], minlength=len(rows)), "matched": matched, "total": total}

        got = iterate.by_group([*links, iterate.cut(_both_starts(*x))], work, f"start {kind}, n_marbles long, n_holes long, matched long, total double", STARTS)
        return x[0].select(G, "start").join(got, [G, "start"], "left")  # the starts of images without any link, too

    def large(g: list[tuple[DataFrame, DataFrame]], x: list[DataFrame]) -> DataFrame:
        a = x[0].select(G, "start", "n1", "n2", "d1", "d2", "r")
        b = x[1].join(x[0].select(G, "start"), [G, "start"], "left_semi").select(G, "start", "n1", "n2", "d1", "d2", "r")
        marbles, holes = _numbered(walk(*g[0], a, step, "r")), _numbered(walk(*g[1], b, step, "r", keep=keep))
        m = sample_matches(marbles, holes, threshold, 0.3, zero_rule=False)
        cost = F.greatest((F.col("dist") - threshold / 3) * 1.5, F.lit(0.0)) + F.col("angle") * threshold * 0.5
        keyed = m.select(F.struct(G, "start").alias("k"), "a", "b", cost.alias("cost"))
        t = matching.ascending_totals(keyed, "k").select(f"k.{G}", "k.start", "matched", "total")
        return a.select(G, "start").join(marbles.groupBy(G, "start").agg(F.count("*").alias("n_marbles")), [G, "start"], "left").join(holes.groupBy(G, "start").agg(F.count("*").alias("n_holes")), [G, "start"], "left").join(t, [G, "start"], "left")

    n = large([pred, truth], [pairs, starts]) if keep else _by_size([pred, truth], [pairs, starts], small, large)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = n.select(G, "start", zero("n_marbles").alias("n_marbles"), zero("n_holes").alias("n_holes"), zero("matched").alias("matched"), (F.coalesce("total", F.lit(0.0)) if soft else F.lit(0.0)).alias("cost"))
    pen = threshold * 1.15
    lost = F.col("cost") + (F.col("n_marbles") - F.col("matched")) * pen
    p = 1 - lost / (F.col("n_marbles") * pen)
    q = 1 - (F.col("cost") + (F.col("n_holes") - F.col("matched")) * pen) / F.nullif(F.col("n_holes") * pen, F.lit(0.0))
    f = F.when((F.col("n_marbles") == 0) | (p + q == 0) | q.isNull(), 0.0).otherwise(2 * p * q / (p + q))
    return n.withColumns({"score": lost, "f": f})
