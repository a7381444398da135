"""Operators on edge tables (image_id, x1, y1, x2, y2) of undirected pixel graphs.

An edge's smaller end comes first; a node is the pair of its coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.operators import iterate

G = "image_id"


def _ab(edges: DataFrame) -> DataFrame:
    return edges.select(G, F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("a"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")).alias("b"))


def _xy(edges: DataFrame) -> DataFrame:
    return edges.select(G, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def _length() -> F.Column:
    return geo.euclidean("a.x", "a.y", "b.x", "b.y")


def canonical(edges: DataFrame) -> DataFrame:
    """Smaller end first, no self-loops, no repeats."""
    p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return _xy(edges.select(G, F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).where("a <> b").distinct())


def edges_from_vertices(vertices: DataFrame) -> DataFrame:
    """Edges between consecutive vertices of roads (image_id, road_id[, part], seq, x, y); roads are numbered within their image."""
    keys = [G, "road_id", *(["part"] if "part" in vertices.columns else [])]
    w = Window.partitionBy(*keys).orderBy("seq")
    nxt = vertices.select(G, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return canonical(nxt.where("x2 is not null"))


def degree(edges: DataFrame) -> DataFrame:
    """(image_id, x, y, degree)."""
    return iterate.degree(_ab(edges), G).select(G, "node.x", "node.y", "degree")


def to_adjacency(edges: DataFrame) -> DataFrame:
    """(image_id, node, neighbors): every node with its sorted neighbours."""
    ab = _ab(edges)
    both = ab.union(ab.select(G, F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(G, F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("neighbors"))


def from_adjacency(adjacency: DataFrame) -> DataFrame:
    """Edges of an adjacency table, each pair once."""
    e = adjacency.select(G, F.col("node").alias("a"), F.explode("neighbors").alias("b"))
    return _xy(e.where("a <> b").select(G, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def edges_from_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of links (image_id, i, j) between nodes (image_id, node_id, x, y); of each pair the link with i < j counts."""
    p = nodes.select(G, "node_id", "x", "y")
    up = links.where("i < j").distinct()
    return canonical(up.join(p.toDF(G, "i", "x1", "y1"), [G, "i"]).join(p.toDF(G, "j", "x2", "y2"), [G, "j"]))


def to_node_edge(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (image_id, node_id, x, y, lat, lon) numbered in (x, y) order, and edges (image_id, n1, n2)."""
    nodes = edges.select(G, F.col("x1").alias("x"), F.col("y1").alias("y")).union(edges.select(G, "x2", "y2")).distinct()
    nodes = nodes.withColumn("node_id", F.row_number().over(Window.partitionBy(G).orderBy("x", "y")) - 1)
    lat, lon = geo.rowcol_to_latlon("y", "x")
    ids = nodes.select(G, "x", "y", "node_id")
    e = edges.join(ids.toDF(G, "x1", "y1", "n1"), [G, "x1", "y1"]).join(ids.toDF(G, "x2", "y2", "n2"), [G, "x2", "y2"]).select(G, "n1", "n2")
    return nodes.select(G, "node_id", "x", "y", lat.alias("lat"), lon.alias("lon")), e


def shift_union(parts: DataFrame) -> DataFrame:
    """World edges of patch edges with their offsets (dx, dy), repeats merged."""
    return canonical(parts.select(G, (F.col("x1") + F.col("dx")).alias("x1"), (F.col("y1") + F.col("dy")).alias("y1"), (F.col("x2") + F.col("dx")).alias("x2"), (F.col("y2") + F.col("dy")).alias("y2")))


def component_lengths(edges: DataFrame) -> DataFrame:
    """(image_id, component, edges, length) of connected components, named by their smallest node."""
    ab = _ab(edges)
    comp = iterate.components(ab, G)
    return ab.join(comp.select(G, F.col("node").alias("a"), "component"), [G, "a"]).groupBy(G, "component").agg(F.count("*").alias("edges"), F.sum(_length()).alias("length"))


def drop_small_components(edges: DataFrame, length: float) -> DataFrame:
    """Edges without the components of at most that total length."""
    ab = _ab(edges)
    comp = iterate.components(ab, G)
    named = ab.join(comp.select(G, F.col("node").alias("a"), "component"), [G, "a"])
    small = named.groupBy(G, "component").agg(F.sum(_length()).alias("l")).where(F.col("l") <= length)
    return _xy(named.join(small, [G, "component"], "left_anti"))


def _clusters(near: DataFrame) -> DataFrame:
    """(image_id, old, head): first-come-first-served clusters of pairs near(image_id, a, b), a before b; a node that stays alone is absent."""
    ids = near.select(G, F.explode(F.array("a", "b")).alias("id")).distinct()
    taken = iterate.cut(iterate.ordered_greedy(ids, near, G))
    heads = taken.where("taken").select(G, F.col("id").alias("a"))
    member = near.join(heads, [G, "a"]).join(taken.where("not taken").select(G, F.col("id").alias("b")), [G, "b"]).groupBy(G, F.col("b").alias("old")).agg(F.min("a").alias("head"))
    return member.union(member.select(G, F.col("head").alias("old"), "head").distinct())


def _groups(near: DataFrame) -> DataFrame:
    """(image_id, old, new): clusters of pairs and their rounded centres."""
    every = iterate.cut(_clusters(near))
    mid = every.groupBy(G, "head").agg(F.struct(F.rint(F.avg("old.x")).cast("int").alias("x"), F.rint(F.avg("old.y")).cast("int").alias("y")).alias("new"))
    return every.join(mid, [G, "head"]).select(G, "old", "new")


def _merged(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Edges (image_id, a, b) with the clusters of near pairs merged; as they are where there is no pair."""
    near = iterate.cut(near)
    return edges if near.isEmpty() else iterate.quotient(edges, _groups(near), G)


def merge_close(edges: DataFrame, d: float) -> DataFrame:
    """Nodes joined by an edge of at most d merge into rounded centres, in (x, y) order."""
    ab = _ab(edges)
    return _xy(_merged(ab, ab.where(_length() <= d)))


def _near_nodes(nodes: DataFrame, r: float) -> DataFrame:
    a = nodes.select(G, F.col("node").alias("a"), F.col("node.x").alias("ax"), F.col("node.y").alias("ay"))
    b = nodes.select(G, F.col("node").alias("b"), F.col("node.x").alias("bx"), F.col("node.y").alias("by"))
    return iterate.grid_join(a, b, r, G).where("a < b").select(G, "a", "b")


def connect_ends(edges: DataFrame, w: int, h: int, r: float = 30, border: int = 20) -> DataFrame:
    """Ends of roads more than `border` off the image's sides that are at most r apart merge into rounded centres."""
    ab = _ab(edges)
    x, y = F.col("node.x"), F.col("node.y")
    ends = iterate.degree(ab, G).where("degree = 1").where((x > border) & (y > border) & (x < w - border) & (y < h - border))
    return _xy(_merged(ab, _near_nodes(ends, r)))


def merge_at_seams(edges: DataFrame, seams: DataFrame, buffer: float, r: float) -> DataFrame:
    """Nodes within buffer of a seam that are at most r apart merge into rounded centres.

    seams: (image_id, vertical, at) and, for seams that don't cross the image, lo and hi.
    """
    ab = _ab(edges)
    nodes = ab.select(G, F.explode(F.array("a", "b")).alias("node")).distinct()
    across, along = F.when(F.col("vertical"), F.col("node.x")).otherwise(F.col("node.y")), F.when(F.col("vertical"), F.col("node.y")).otherwise(F.col("node.x"))
    hit = F.abs(across - F.col("at")) <= buffer
    if "lo" in seams.columns:
        hit = hit & along.between(F.col("lo") - buffer, F.col("hi") + buffer)
    near = nodes.join(seams, G).where(hit).select(G, "node").distinct()
    return _xy(_merged(ab, _near_nodes(near, r)))


def separate_border_ends(edges: DataFrame, w: int | F.Column, h: int | F.Column, band: float = 10, d: float = 10, seed: int = 0, tries: int = 100) -> DataFrame:
    """Ends of roads in the border band that are within d of each other moved apart.

    Clusters of such ends get up to `tries` seeded moves of at most d / 2 + 1 a
    side within the image; the first with all pairs at least d and at most
    1.8 d apart counts, and a cluster without one stays.
    """
    ab = _ab(edges)
    x, y = F.col("node.x"), F.col("node.y")
    inner = (x > band) & (y > band) & (x < w - band) & (y < h - band)
    near = iterate.cut(_near_nodes(iterate.degree(ab, G).where("degree = 1").where(~inner), d))
    if near.isEmpty():
        return edges
    reach = int(d / 2) + 1
    members = iterate.cut(_clusters(near))

    def moved(c: str, size: int | F.Column) -> F.Column:
        low, high = F.greatest(F.lit(-reach), -F.col(f"old.{c}")), F.least(F.lit(reach), size - 1 - F.col(f"old.{c}"))
        return (F.col(f"old.{c}") + low + F.pmod(F.xxhash64(F.lit(seed), F.lit(c), G, "old", "try"), (high - low + 1).cast("long"))).cast("int")

    place = F.struct(moved("x", w).alias("x"), moved("y", h).alias("y"))
    drawn = members.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries)))).select(G, "head", "try", "old", place.alias("new"))
    # the estimate of a size doesn't know of the tries, so neither side may be broadcast on it
    a, b = drawn.alias("a"), drawn.hint("merge").alias("b")
    pair = a.join(b, (F.col(f"a.{G}") == F.col(f"b.{G}")) & (F.col("a.head") == F.col("b.head")) & (F.col("a.try") == F.col("b.try")) & (F.col("a.old") < F.col("b.old")))
    gap = geo.euclidean("a.new.x", "a.new.y", "b.new.x", "b.new.y")
    good = pair.groupBy(F.col(f"a.{G}").alias(G), F.col("a.head").alias("head"), F.col("a.try").alias("try")).agg(F.min(gap).alias("lo"), F.max(gap).alias("hi")).where((F.col("lo") >= d) & (F.col("hi") <= 1.8 * d))
    first = good.groupBy(G, "head").agg(F.min("try").alias("try"))
    return _xy(iterate.quotient(ab, members.join(first, [G, "head"]).select(G, "old", place.alias("new")), G))


def cut_at_rect(edges: DataFrame) -> DataFrame:
    """Edges cut at a rectangle of their row (left, top, right, bottom): what lies outside goes."""
    box = [F.col(c) for c in ("left", "top", "right", "bottom")]

    def inside(x: str, y: str) -> F.Column:
        return F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])

    # each is worked out once: without the step through an array the optimiser would write it out wherever it is used
    once = lambda c: F.explode(F.array(c))
    e = edges.select("*", inside("x1", "y1").alias("in1"), inside("x2", "y2").alias("in2"), once(geo.clip_segment("x1", "y1", "x2", "y2", *box)).alias("hits"))
    p = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    q = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    n = F.size("hits")
    first, last = F.get("hits", F.lit(0)), F.get("hits", n - 1)
    a = F.when(F.col("in1"), p).when(F.col("in2") & (n > 0), first).when(n > 1, first)
    b = F.when(F.col("in2"), q).when(F.col("in1") & (n > 0), last).when(n > 1, last)
    got = e.select(*[c for c in edges.columns if c not in ("x1", "y1", "x2", "y2")], once(F.struct(a.alias("a"), b.alias("b"))).alias("ends"))
    got = got.select("*", "ends.a", "ends.b").where("a is not null and b is not null and a <> b")
    return got.select("*", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).select(
        *[c for c in edges.columns if c not in ("x1", "y1", "x2", "y2")], F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2")
    ).distinct()


def crop(edges: DataFrame, tiles: DataFrame, cell: int = 256, clean: bool = False, merge: float = 20, band: float = 15, d: float = 15, seed: int = 0) -> DataFrame:
    """Edges of every tile (image_id, tile, left, top, right, bottom), cut at it and in its own coordinates.

    Edges meet tiles by grid cells. With `clean`, near nodes are merged twice
    and border ends set apart three times, and all that twice over.
    """
    e = edges.withColumns({"al": F.least("x1", "x2"), "ar": F.greatest("x1", "x2"), "ab": F.least("y1", "y2"), "at": F.greatest("y1", "y2")})
    t = tiles.withColumns({"bl": F.col("left"), "br": F.col("right"), "bb": F.col("top"), "bt": F.col("bottom")})
    got = cut_at_rect(iterate.box_join(e, t, cell, G).select(G, "tile", "x1", "y1", "x2", "y2", "left", "top", "right", "bottom"))
    # a tile's own size rides in its key
    key = F.struct(G, "tile", (F.col("right") - F.col("left") + 1).alias("w"), (F.col("bottom") - F.col("top") + 1).alias("h")).alias(G)
    got = got.select(key, *((F.col(c) - F.col("left" if c[0] == "x" else "top")).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))
    plain = lambda t: t.select(f"{G}.{G}", f"{G}.tile", "x1", "y1", "x2", "y2")
    if not clean:
        return plain(got)
    one = iterate.cut(got)
    for _ in range(2):
        for _ in range(2):
            one = iterate.cut(merge_close(one, merge))
        for k in range(3):
            one = iterate.cut(separate_border_ends(one, F.col(f"{G}.w"), F.col(f"{G}.h"), band, d, seed + k))
    return plain(one)


def n_pieces(longest: float = 3.0, piece: float = 2.0) -> F.Column:
    """Into how many pieces densify_places cuts an edge (lat1, lon1, lat2, lon2)."""
    d = geo.gps_distance("lat1", "lon1", "lat2", "lon2")
    return F.when(d > longest, (d / piece).cast("long") + 1).otherwise(1)


def densify_places(geo_edges: DataFrame, longest: float = 3.0, piece: float = 2.0) -> DataFrame:
    """Pieces (image_id, ka1, ko1, la1, lo1, ka2, ko2, la2, lo2): keys and places of both ends of densify."""
    e = geo_edges.withColumn("n", n_pieces(longest, piece)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))

    def at(i: F.Column, c: str) -> F.Column:
        part = i / F.col("n")
        return F.when(i == 0, F.col(f"{c}1")).when(i == F.col("n"), F.col(f"{c}2")).otherwise(F.col(f"{c}1") * (1 - part) + F.col(f"{c}2") * part)

    cols = {}
    for k, i in ((1, F.col("i")), (2, F.col("i") + 1)):
        cols[f"la{k}"], cols[f"lo{k}"] = at(i, "lat"), at(i, "lon")
        cols[f"ka{k}"], cols[f"ko{k}"] = geo.fine_key(cols[f"la{k}"], cols[f"lo{k}"])
    return e.select(G, *(v.alias(k) for k, v in cols.items())).where("not (ka1 = ka2 and ko1 = ko2)")


def densify(geo_edges: DataFrame, longest: float = 3.0, piece: float = 2.0) -> DataFrame:
    """Edges (image_id, lat1, lon1, lat2, lon2) over `longest` metres cut into trunc(d / piece) + 1 equal pieces, with keys of 1e-7 degrees."""
    return densify_places(geo_edges, longest, piece).select(G, "ka1", "ko1", "ka2", "ko2").distinct()


def pixel_graph(pixels: DataFrame) -> DataFrame:
    """8-neighbour links of set pixels (image_id, row_, col_), each once."""
    later = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))))
    step = pixels.select(G, "row_", "col_", F.explode(later).alias("o")).select(G, "row_", "col_", (F.col("row_") + F.col("o.r")).alias("row2"), (F.col("col_") + F.col("o.c")).alias("col2"))
    return step.join(pixels.select(G, F.col("row_").alias("row2"), F.col("col_").alias("col2")), [G, "row2", "col2"]).select(G, "row_", "col_", "row2", "col2")


def skeleton_ends(pixels: DataFrame) -> DataFrame:
    """Set pixels with exactly one set neighbour."""
    e = pixel_graph(pixels)
    both = e.select(G, "row_", "col_").union(e.select(G, "row2", "col2"))
    return both.groupBy(G, "row_", "col_").agg(F.count("*").alias("n")).where("n = 1").select(G, "row_", "col_")


def label_pixels(pixels: DataFrame) -> DataFrame:
    """pixels with component: the first pixel (row_, col_) of their 8-connected component."""
    e = pixel_graph(pixels)
    pair = e.select(G, F.struct("row_", "col_").alias("a"), F.struct(F.col("row2").alias("row_"), F.col("col2").alias("col_")).alias("b"))
    tile = lambda n: F.struct(F.floor(n["row_"] / 256).alias("r"), F.floor(n["col_"] / 256).alias("c"))
    comp = iterate.components(pair, G, region=tile).select(G, "node.row_", "node.col_", "component")
    return pixels.join(comp, [G, "row_", "col_"], "left").withColumn("component", F.coalesce("component", F.struct("row_", "col_")))


def pixel_components(pixels: DataFrame, value: str = "heat", least: int = 4) -> DataFrame:
    """8-connected components of set pixels: size, and where the best value is; is_road where of at least `least` pixels."""
    best = F.max_by(F.struct("row_", "col_"), F.struct(F.col(value), (-F.col("row_")).alias("r"), (-F.col("col_")).alias("c")))
    out = label_pixels(pixels).groupBy(G, "component").agg(F.count("*").alias("size"), best.alias("best"))
    return out.select(G, F.col("component.row_").alias("comp_row"), F.col("component.col_").alias("comp_col"), "size", F.col("best.row_").alias("row_"), F.col("best.col_").alias("col_"), (F.col("size") >= least).alias("is_road"))


def road_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directed graph: nodes (image_id, node_id, lat, lon) by the x-latitude convention, edges (image_id, edge_id, n1, n2) both ways."""
    nodes, e = to_node_edge(iterate.cut(edges))  # read several times, for nodes and for both ends
    lat, lon = geo.xy_to_latlon("x", "y")
    both = e.union(e.select(G, F.col("n2").alias("n1"), F.col("n1").alias("n2"))).distinct()
    ids = F.row_number().over(Window.partitionBy(G).orderBy("n1", "n2")) - 1
    return nodes.select(G, "node_id", lat.alias("lat"), lon.alias("lon")), both.select(G, ids.alias("edge_id"), "n1", "n2")


def reverse_links(dedges: DataFrame) -> DataFrame:
    """Directed edges turned round."""
    return dedges.select(G, F.col("n2").alias("n1"), F.col("n1").alias("n2")).distinct()


def bidirect(dedges: DataFrame) -> DataFrame:
    """Directed edges with their opposites, the score of an edge going to both; numbered anew."""
    both = dedges.select(G, "n1", "n2", "score").union(dedges.select(G, "n2", "n1", "score")).groupBy(G, "n1", "n2").agg(F.max("score").alias("score"))
    return both.select(G, (F.row_number().over(Window.partitionBy(G).orderBy("n1", "n2")) - 1).alias("edge_id"), "n1", "n2", "score")


def remove_nodes(dedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges without those at nodes(image_id, node_id)."""
    for c in ("n1", "n2"):
        dedges = dedges.join(nodes.select(G, F.col("node_id").alias(c)), [G, c], "left_anti")
    return dedges


def attach_edges(nodes: DataFrame, dedges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (image_id, key, node_id, lat, lon) and directed edges (image_id, edge_id, n1, n2, score) with edges from positions to nodes that exist.

    new: (image_id, key, lat, lon, n2, score). A key not known yet gets the next
    node id of its image, by key, with its smallest position; edges get the next
    edge ids, by key and n2. Images without nodes have nothing to attach to.
    """
    fresh = new.join(nodes.select(G, "key"), [G, "key"], "left_anti").groupBy(G, "key").agg(F.min(F.struct("lat", "lon")).alias("p"))
    ends = nodes.groupBy(G).agg(F.max("node_id").alias("top"))
    got = fresh.join(ends, G).select(G, "key", (F.col("top") + F.row_number().over(Window.partitionBy(G).orderBy("key"))).alias("node_id"), "p.lat", "p.lon")
    every = nodes.select(G, "key", "node_id", "lat", "lon").union(got)
    last = dedges.groupBy(G).agg(F.max("edge_id").alias("last"))
    link = new.join(every.select(G, "key", F.col("node_id").alias("n1")), [G, "key"]).join(last, G, "left")
    number = F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy(G).orderBy("key", "n2", "score"))
    return every, dedges.select(G, "edge_id", "n1", "n2", "score").union(link.select(G, number.alias("edge_id"), "n1", "n2", "score"))


def dead_ends(dedges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Nodes of one undirected neighbour, or without outgoing or incoming links, but for those in keep(image_id, node_id): terminals and roots of trees."""
    half = dedges.select(G, F.col("n1").alias("node_id"), F.col("n2").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        dedges.select(G, F.col("n2").alias("node_id"), F.col("n1").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    d = half.groupBy(G, "node_id").agg(F.count_distinct("n").alias("d"), F.sum("o").alias("o"), F.sum("i").alias("i"))
    dead = d.where("d = 1 or o = 0 or i = 0").select(G, "node_id")
    return dead if keep is None else dead.join(keep.select(G, "node_id"), [G, "node_id"], "left_anti")


def remove_dead_ends(dedges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """One simultaneous pass over all dead ends that aren't kept."""
    return remove_nodes(dedges, dead_ends(dedges, keep))


def keypoint_directions(edges: DataFrame) -> DataFrame:
    """(image_id, x, y, nx, ny, sin, cos, deg): the direction from every node to each neighbour."""
    both = edges.select(G, "x1", "y1", "x2", "y2").union(edges.select(G, "x2", "y2", "x1", "y1")).toDF(G, "x", "y", "nx", "ny")
    s, c = geo.step_vector("x", "y", "nx", "ny")
    return both.select("*", s.alias("sin"), c.alias("cos")).withColumn("deg", geo.angle_deg("sin", "cos"))


def chain_table(edges: DataFrame) -> DataFrame:
    """(image_id, x1, y1, x2, y2, cx1, cy1, cx2, cy2): every edge with the smallest edge of its run."""
    ch = iterate.chains(_ab(edges), G)
    return ch.select(G, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), F.col("chain.a.x").alias("cx1"), F.col("chain.a.y").alias("cy1"), F.col("chain.b.x").alias("cx2"), F.col("chain.b.y").alias("cy2"))


def ring_halves(edges: DataFrame) -> DataFrame:
    """(image_id, chain, half, pos, x, y): the nodes of every closed run, from its junction if it has one, as two halves that share the middle node."""
    pos = iterate.chain_positions(_ab(edges), G).where("closed")
    mid = F.floor(F.col("n_edges") / 2)
    half = F.explode(F.when(F.col("pos") < mid, F.array(F.lit(0))).when(F.col("pos") > mid, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
    return pos.select(G, "chain", half.alias("half"), "pos", "node.x", "node.y")


def _drawn_runs(edges: DataFrame, raster: bool) -> DataFrame:
    """(image_id, chain, part, pos, line, b): the legs of every run with their pixels, the last node left out; a closed run is two parts."""
    r = iterate.runs(_ab(edges), G)
    mid = F.floor(F.col("n_edges") / 2)
    part = F.when(F.col("closed") & (F.col("pos") >= mid), 1).otherwise(0)
    line = geo.line_pixels("a.x", "a.y", "b.x", "b.y") if raster else F.array(F.struct("a.x", "a.y"))
    return r.select(G, "chain", part.alias("part"), "pos", line.alias("line"), "b")


def run_pixels(edges: DataFrame, raster: bool = True) -> DataFrame:
    """(image_id, chain, part, pos, node): the pixels of every run in order, legs drawn and the last node added; a closed run is two parts.

    Without raster the nodes themselves.
    """
    return _placed_pixels(_drawn_runs(edges, raster))


def _placed_pixels(legs: DataFrame) -> DataFrame:
    w = Window.partitionBy(G, "chain", "part").orderBy("pos")
    legs = legs.select(G, "chain", "part", "line", "b", (F.sum(F.size("line")).over(w) - F.size("line")).alias("at"), F.lead("pos").over(w).isNull().alias("last"))
    full = F.when(F.col("last"), F.concat("line", F.array(F.struct("b.x", "b.y")))).otherwise(F.col("line"))
    return legs.select(G, "chain", "part", "at", F.posexplode(full).alias("i", "node")).select(G, F.struct("chain", "part").alias("chain"), (F.col("at") + F.col("i")).alias("pos"), "node")


def _kept(x: np.ndarray, y: np.ndarray, eps: float) -> list[int]:
    """Places of a line's pixels that Ramer-Douglas-Peucker keeps, in order."""
    kept, open_ = [0, len(x) - 1], [(0, len(x) - 1)]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < 2:
            continue
        dx, dy = x[hi] - x[lo], y[hi] - y[lo]
        px, py = x[lo + 1 : hi] - x[lo], y[lo + 1 : hi] - y[lo]
        n = np.sqrt(np.float64(dx * dx + dy * dy))
        d = np.sqrt((px * px + py * py).astype(np.float64)) if n == 0 else np.abs(px * dy - py * dx) / n
        m = int(d.argmax())  # the first at a tie
        if d[m] > eps:
            m += lo + 1
            kept.append(m)
            open_ += [(lo, m), (m, hi)]
    return sorted(kept)


def _thinned(lines: DataFrame, eps: float) -> DataFrame:
    """(image_id, a, b): what is kept of lines(image_id, line: an array of places), each in its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            col = t.column("line")
            flat, size = col.flatten(), col.value_lengths().to_numpy()
            x, y = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in flat.flatten())
            own, first, last, at = [], [], [], 0
            for i, k in enumerate(size.tolist()):
                kept = [at + p for p in _kept(x[at : at + k], y[at : at + k], eps)]
                own.extend([i] * (len(kept) - 1))
                first += kept[:-1]
                last += kept[1:]
                at += k
            take = lambda c, p: c.take(pa.array(p, pa.int64()))
            yield pa.RecordBatch.from_arrays([take(t.column(G), own), take(flat, first), take(flat, last)], [G, "a", "b"])

    g, node = lines.schema[G].dataType.simpleString(), lines.schema["line"].dataType.elementType.simpleString()
    return lines.select(G, "line").mapInArrow(run, f"`{G}` {g}, a {node}, b {node}")


def simplify(edges: DataFrame, eps: float, raster: bool = True, most: int = 20_000) -> DataFrame:
    """Ramer-Douglas-Peucker on every run of nodes of degree 2, rasterised; a closed run is simplified as two halves.

    A run of at most `most` pixels is one row, split within it to the end.
    Longer ones go level by level, see `_levels`.
    """
    legs = iterate.cut(_drawn_runs(edges, raster))
    run = [G, "chain", "part"]
    long = legs.groupBy(*run).agg(F.sum(F.size("line")).alias("n")).where(F.col("n") >= most).select(*run)
    long = None if long.isEmpty() else iterate.cut(long)
    short = legs if long is None else legs.join(long, run, "left_anti")
    lines = short.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("pos", "line", "b"))).alias("l"))
    got = _thinned(lines.select(G, F.concat(F.flatten("l.line"), F.array(F.struct(F.element_at("l", -1)["b"]["x"].alias("x"), F.element_at("l", -1)["b"]["y"].alias("y")))).alias("line")), eps)
    if long is not None:
        got = got.union(_levels(_placed_pixels(legs.join(long, run, "left_semi")), eps))
    return _xy(got.where("a <> b").select(G, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _levels(px: DataFrame, eps: float) -> DataFrame:
    """(image_id, a, b): what is kept of runs of pixels(image_id, chain, pos, node), all at once, level by level.

    Each round splits every open interval at its farthest pixel, the first at a
    tie, if that is over eps from the chord (from the point, where the ends are
    one); only pixels within open intervals are read again.
    """
    px = iterate.cut(px)
    ends = px.groupBy(G, "chain").agg(F.min(F.struct("pos", "node")).alias("lo"), F.max(F.struct("pos", "node")).alias("hi"))
    span = ends.select(G, "chain", F.col("lo.pos").cast("long").alias("lo"), F.col("hi.pos").cast("long").alias("hi"), F.col("lo.node").alias("a"), F.col("hi.node").alias("b"))
    done = [span.where("hi - lo = 1").select(G, "a", "b")]
    inner = iterate.cut(px.join(span, [G, "chain"]).where("pos > lo and pos < hi"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    n = F.sqrt((dx * dx + dy * dy).cast("double"))
    px_, py_ = F.col("node.x") - F.col("a.x"), F.col("node.y") - F.col("a.y")
    dist = F.when(n == 0, F.sqrt((px_ * px_ + py_ * py_).cast("double"))).otherwise(F.abs(px_ * dy - py_ * dx) / F.nullif(n, F.lit(0.0)))
    while not inner.isEmpty():
        far = inner.groupBy(G, "chain", "lo", "hi", "a", "b").agg(F.max(F.struct(dist.alias("d"), (-F.col("pos")).alias("p"), "node")).alias("m"))
        far = iterate.cut(far.select(G, "chain", "lo", "hi", "a", "b", F.when(F.col("m.d") > eps, -F.col("m.p")).alias("at"), F.col("m.node").alias("mid")))
        done.append(far.where("at is null").select(G, "a", "b"))
        split = far.where("at is not null")
        done += [split.where("at - lo = 1").select(G, "a", F.col("mid").alias("b")), split.where("hi - at = 1").select(G, F.col("mid").alias("a"), "b")]
        more = inner.join(split.select(G, "chain", "lo", "at", "mid"), [G, "chain", "lo"]).where("pos <> at")
        left = F.col("pos") < F.col("at")
        side = lambda x, y: F.when(left, x).otherwise(y)
        inner = iterate.cut(more.select(G, "chain", "pos", "node", side(F.col("lo"), F.col("at")).alias("lo"), side(F.col("at"), F.col("hi")).alias("hi"), side(F.col("a"), F.col("mid")).alias("a"), side(F.col("mid"), F.col("b")).alias("b")))
    got = done[0]
    for part in done[1:]:
        got = got.union(part)
    return got
