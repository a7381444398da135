"""Queries of coordinate functions, graph tables and table sources, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.operators import graph, iterate
from waymesh.sources.fixtures import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _v(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fx_vertex")


def _e(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fx_edge_gt")


K = "image_id, road_id, seq"


@query("e1_geo_to_pixel", f"select {K}, case when px = 1300 then 1299 else px end px, case when py = 1300 then 1299 else py end py from (select {K}, cast(floor((-71 + x*0.00003e0 - -71) / 0.00001e0) as int) px, cast(floor((41 - y*0.00003e0 - 41) / -0.00001e0) as int) py from fx_vertex) t")
def _(s, d):
    lon, lat = F.lit(-71) + F.col("x") * 0.00003, F.lit(41) - F.col("y") * 0.00003
    x, y = geo.geo_to_pixel(lon, lat, 0.00001, -71, -0.00001, 41)
    return _v(s, d).select("image_id", "road_id", "seq", x.alias("px"), y.alias("py"))


@query("e2_rowcol_to_latlon", f"select {K}, 41 - y/111111e0 lat, -71 + x/111111e0/cos(radians(41)) lon from fx_vertex")
def _(s, d):
    lat, lon = geo.rowcol_to_latlon("y", "x")
    return _v(s, d).select("image_id", "road_id", "seq", lat.alias("lat"), lon.alias("lon"))


@query("e3_xy_to_latlon", f"select {K}, 41 - x/111111e0 lat, -71 + y/111111e0/cos(radians(41)) lon from fx_vertex")
def _(s, d):
    lat, lon = geo.xy_to_latlon("x", "y")
    return _v(s, d).select("image_id", "road_id", "seq", lat.alias("lat"), lon.alias("lon"))


_LL = "select image_id, x1, y1, x2, y2, 41 - y1/111111e0 lat1, -71 + x1/111111e0/cos(radians(41)) lon1, 41 - y2/111111e0 lat2, -71 + x2/111111e0/cos(radians(41)) lon2 from fx_edge_gt"
_EK = ["image_id", "x1", "y1", "x2", "y2"]
_EKS = "image_id, x1, y1, x2, y2"


def geo_edges(e: DataFrame) -> DataFrame:
    (a, b), (c, d) = geo.rowcol_to_latlon("y1", "x1"), geo.rowcol_to_latlon("y2", "x2")
    return e.select(*_EK, a.alias("lat1"), b.alias("lon1"), c.alias("lat2"), d.alias("lon2"))


@query("e4_gps_distance", f"select {_EKS}, sqrt(pow(lat1-lat2,2) + pow((lon1-lon2)*cos(radians(lat1)),2))*111111 d from ({_LL}) t")
def _(s, d):
    return geo_edges(_e(s, d)).select(*_EK, geo.gps_distance("lat1", "lon1", "lat2", "lon2").alias("d"))


@query("e5_deg_distance", f"select {_EKS}, sqrt(pow(lat1-lat2,2) + pow((lon1-lon2)*cos(radians(lat1)),2))*1000 d from ({_LL}) t")
def _(s, d):
    return geo_edges(_e(s, d)).select(*_EK, (geo.deg_distance("lat1", "lon1", "lat2", "lon2") * 1000).alias("d"))


@query("e6_euclidean", f"select {_EKS}, sqrt((x1-x2)*(x1-x2) + (y1-y2)*(y1-y2)) d from fx_edge_gt")
def _(s, d):
    return _e(s, d).select(*_EK, geo.euclidean("x1", "y1", "x2", "y2").alias("d"))


@query("e7_unit_vec", f"select {_EKS}, dy/n u, dx*cos(radians(40))/n v from (select *, x2-x1 dx, y2-y1 dy, sqrt(pow(y2-y1,2) + pow((x2-x1)*cos(radians(40)),2)) n from fx_edge_gt) t")
def _(s, d):
    u, v = geo.unit_vec(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    return _e(s, d).select(*_EK, u.alias("u"), v.alias("v"))


@query("e8_point_segment", f"select {_EKS}, sqrt(pow(200-x1-t*(x2-x1),2) + pow(210-y1-t*(y2-y1),2)) d from (select *, greatest(0, least(1, ((200-x1)*(x2-x1)+(210-y1)*(y2-y1))::double/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) t from fx_edge_gt) q")
def _(s, d):
    return _e(s, d).select(*_EK, geo.point_segment_distance(200, 210, "x1", "y1", "x2", "y2").alias("d"))


@query("e9_angle_distance", f"select {_EKS}, case when x1*x1+y1*y1=0 or x2*x2+y2*y2=0 then 100000 else sqrt(pow(x1/sqrt(x1*x1+y1*y1)-x2/sqrt(x2*x2+y2*y2),2)+pow(y1/sqrt(x1*x1+y1*y1)-y2/sqrt(x2*x2+y2*y2),2)) end d from fx_edge_gt")
def _(s, d):
    return _e(s, d).select(*_EK, geo.angle_distance("x1", "y1", "x2", "y2").alias("d"))


@query("e10_in_bounds", f"select {_EKS} from ({_LL}) t where lat1 > 41 - 400/111111e0 + 60/111111e0 and lat1 < 41 - 60/111111e0 and lon1 > -71 + 60/111111e0/cos(radians(41)) and lon1 < -71 + 400/111111e0/cos(radians(41)) - 60/111111e0/cos(radians(41))")
def _(s, d):
    return geo_edges(_e(s, d)).where(geo.in_bounds("lat1", "lon1", 400, 60)).select(*_EK)


@query("e11_location_keys", f"select {_EKS}, cast(trunc(lat1*111111/3) as bigint) ka, cast(trunc(lon1*111111/3) as bigint) ko, cast(round_even(lat1*1e7, 0) as bigint) fa, cast(round_even(lon1*1e7, 0) as bigint) fo from ({_LL}) t")
def _(s, d):
    (a, o), (fa, fo) = geo.grid_key("lat1", "lon1", 3), geo.fine_key("lat1", "lon1")
    return geo_edges(_e(s, d)).select(*_EK, a.alias("ka"), o.alias("ko"), fa.alias("fa"), fo.alias("fo"))


@query("e12_angle_deg", f"select {_EKS}, case when a < 0 then a + 360 else a end deg from (select *, degrees(atan2(y2-y1, x2-x1)) a from fx_edge_gt) t")
def _(s, d):
    return _e(s, d).select(*_EK, geo.angle_deg(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("deg"))


@query("e13_vector_angle", f"select {_EKS}, round(degrees(acos(greatest(-1, least(1, (x1*x2+y1*y2)/greatest(sqrt(x1*x1+y1*y1)*sqrt(x2*x2+y2*y2), 1e-8))))), 4) deg from fx_edge_gt")
def _(s, d):
    return _e(s, d).select(*_EK, F.round(geo.vector_angle("x1", "y1", "x2", "y2"), 4).alias("deg"))


@query("e14_ray_distance", f"select {_EKS}, case when (x1-200)*0.6e0+(y1-200)*0.8e0 < 0 then 10000 else abs((x1-200)*0.8e0-(y1-200)*0.6e0) end d from fx_edge_gt")
def _(s, d):
    return _e(s, d).select(*_EK, geo.ray_distance("x1", "y1", 200, 200, 0.6, 0.8).alias("d"))


@query("e15_lerp_clamped", f"select {_EKS}, case when x1 <= 30 then 50 when x1 >= 300 then 140 else 50 + (x1-30)*(90e0/270) end t from fx_edge_gt")
def _(s, d):
    return _e(s, d).select(*_EK, geo.lerp_clamped("x1", 30.0, 300.0, 50.0, 140.0).alias("t"))


_LERP = "case when {d} <= 30 then {a}::double when {d} >= 448 then {b}::double else {a} + ({d}-30)*(({b}-{a})/418e0) end"


@query("e16_pair_cost", f"select {_EKS}, case when x1/10e0 >= 44.99e0 + least(y2, 448)*(0.01e0/448) or y1/4e0 >= 70 + least(y2, 448)*(70e0/448) then 1000 else y1/4e0*least(y2, 448)/448e0 end cost from fx_edge_gt")
def _(s, d):
    return _e(s, d).select(*_EK, geo.pair_cost("y2", F.col("x1") / 10.0, F.col("y1") / 4.0).alias("cost"))


def _side(at, u, v, lo, hi, other, vertical):
    """SQL of where an edge meets one side of a rectangle."""
    t = f"({at} - {u}1)::double/({u}2 - {u}1)"
    o = f"{v}1 + {t}*({v}2 - {v}1)"
    x, y = (f"{at}::int", f"cast(round_even({o}, 0) as int)") if vertical else (f"cast(round_even({o}, 0) as int)", f"{at}::int")
    return f"case when {u}1 <> {u}2 and {t} between 0 and 1 and {o} between {lo} and {hi} then {{'t': {t}, 'x': {x}, 'y': {y}}} end"


def _clipped(left, top, right, bottom):
    """SQL list of the distinct points where an edge meets a rectangle, from its first end on."""
    sides = [_side(left, "x", "y", top, bottom, "y", True), _side(right, "x", "y", top, bottom, "y", True), _side(top, "y", "x", left, right, "x", False), _side(bottom, "y", "x", left, right, "x", False)]
    return f"list_sort([q for q in [{', '.join(sides)}] if q is not null])"


@query("e18_clip_segment", f"select {_EKS}, len(list_distinct([{{'x': q.x, 'y': q.y}} for q in h])) n, h[1].x fx, h[1].y fy, h[-1].x lx, h[-1].y ly from (select *, {_clipped(200, 100, 330, 300)} h from fx_edge_gt) t")
def _(s, d):
    hits = geo.clip_segment("x1", "y1", "x2", "y2", 200, 100, 330, 300)
    e = _e(s, d).withColumn("h", hits)
    first, last = F.get("h", F.lit(0)), F.get("h", F.size("h") - 1)
    return e.select(*_EK, F.size("h").cast("long").alias("n"), first["x"].alias("fx"), first["y"].alias("fy"), last["x"].alias("lx"), last["y"].alias("ly"))


@query("e19_ray_segment", f"select {_EKS}, case when det <> 0 and t >= 0 and u between 0 and 1 then 200 + t else 0 end x, case when det <> 0 and t >= 0 and u between 0 and 1 then t else 0 end len from (select *, ey det, case when ey <> 0 then ((x1-200)*ey-(y1-201)*ex)::double/ey end t, case when ey <> 0 then -(y1-201)::double/ey end u from (select *, x2-x1 ex, y2-y1 ey from fx_edge_gt) a) b")
def _(s, d):
    x, _, n = geo.ray_segment(200, 201, 1, 0, "x1", "y1", "x2", "y2")
    return _e(s, d).select(*_EK, x.alias("x"), n.alias("len"))


@query("e20_window_index", f"select {_EKS}, 400 - cast(trunc((lat1 - 40.99e0)/((41 - 40.99e0)/400)) as int) r, cast(trunc((lon1+71)/((-70.99e0+71)/500)) as int) c from ({_LL}) t")
def _(s, d):
    r, c = geo.window_index("lat1", "lon1", 40.99, -71.0, 41.0, -70.99, 400, 500)
    return geo_edges(_e(s, d)).select(*_EK, r.alias("r"), c.alias("c"))


@query("e21_rescale", "select image_id, row_, col_, 1/(1+exp(-heat)) sig, (heat-lo)/nullif(hi-lo,0) mm from fx_pixel join (select image_id, min(heat) lo, max(heat) hi from fx_pixel group by 1) using (image_id)")
def _(s, d):
    from waymesh.operators.raster import min_max

    return min_max(table(s, d, "fx_pixel"), "heat").select("image_id", "row_", "col_", geo.sigmoid("heat").alias("sig"), F.col("scaled").alias("mm"))


@query("e22_normalise_bands", "select image_id, row_, col_, (b/255e0-0.485)/0.229e0 nb, r/127.5e0-1 nr from fx_pixel")
def _(s, d):
    return table(s, d, "fx_pixel").select("image_id", "row_", "col_", geo.standardise("b", 0.485, 0.229).alias("nb"), geo.simple_scale("r").alias("nr"))


@query("e23_line_pixels", "select distinct image_id, cast(round_even(x1+(x2-x1)*i::double/n,0) as int) x, cast(round_even(y1+(y2-y1)*i::double/n,0) as int) y from (select *, unnest(range(n)) i from (select *, greatest(abs(x2-x1),abs(y2-y1)) n from fx_edge_gt) a) b")
def _(s, d):
    return _e(s, d).select("image_id", F.explode(geo.line_pixels("x1", "y1", "x2", "y2")).alias("p")).select("image_id", "p.x", "p.y").distinct()


@query("e24_step_vector", f"select {_EKS}, (y2-y1)/sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)) s, (x2-x1)/sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)) c from fx_edge_gt")
def _(s, d):
    a, b = geo.step_vector("x1", "y1", "x2", "y2")
    return _e(s, d).select(*_EK, a.alias("s"), b.alias("c"))


_BOTH = "(select image_id, x1 x, y1 y, x2 nx, y2 ny from fx_edge_gt union all select image_id, x2, y2, x1, y1 from fx_edge_gt)"
_NODES = "(select image_id, x, y, row_number() over (partition by image_id order by x, y)-1 id from (select distinct image_id, x, y from " + _BOTH + " b0) b1)"
_IDE = f"(select e.image_id, a.id n1, b.id n2 from fx_edge_gt e join {_NODES} a on a.image_id=e.image_id and a.x=x1 and a.y=y1 join {_NODES} b on b.image_id=e.image_id and b.x=x2 and b.y=y2)"


@query("g1_edges", "select * from fx_edge_gt")
def _(s, d):
    # roads numbered anew in every image, as files number them
    return graph.edges_from_vertices(_v(s, d).withColumn("road_id", F.col("road_id") % 50))


@query("g1_edges_pred", "select * from fx_edge_pred")
def _(s, d):
    return graph.edges_from_vertices(table(s, d, "fx_vertex_pred").withColumns({"part": F.col("road_id") % 5, "road_id": F.floor((F.col("road_id") % 50) / 5)}))


@query("g2_degree", f"select image_id, x, y, cast(count(distinct (nx, ny)) as int) degree from {_BOTH} b group by 1,2,3")
def _(s, d):
    return graph.degree(_e(s, d))


@query("g3_shift_union", "select distinct image_id // 2 image_id, x1 + 448*(image_id % 2) x1, y1, x2 + 448*(image_id % 2) x2, y2 from fx_edge_gt")
def _(s, d):
    e = _e(s, d).withColumns({"dx": 448 * (F.col("image_id") % 2), "dy": F.lit(0)}).withColumn("image_id", F.floor(F.col("image_id") / 2))
    return graph.shift_union(e)


_COMP = f"with recursive ids as (select * from {_IDE} q), b as (select image_id, n1 a, n2 b from ids union select image_id, n2, n1 from ids), reach as (select distinct image_id, a src, a node from b union select r.image_id, r.src, b.b from reach r join b on b.image_id=r.image_id and b.a=r.node), comp as (select image_id, node, min(src) comp from reach group by 1,2)"


@query("g4_components", f"{_COMP} select i.image_id, comp, count(*) edges from ids i join comp c on c.image_id=i.image_id and c.node=i.n1 group by 1,2")
def _(s, d):
    _, e = graph.to_node_edge(_e(s, d))
    comp = iterate.components(e.select("image_id", F.col("n1").alias("a"), F.col("n2").alias("b")))
    return e.join(comp.select("image_id", F.col("node").alias("n1"), F.col("component").alias("comp")), ["image_id", "n1"]).groupBy("image_id", "comp").agg(F.count("*").alias("edges"))


@query("g4_drop_small", f"{_COMP.replace('with recursive', 'with recursive ln as (select * from ' + _NODES + ' nn),', 1)}, le as (select i.image_id, comp, n1, n2, a.x x1, a.y y1, b.x x2, b.y y2, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) l from ids i join comp c on c.image_id=i.image_id and c.node=i.n1 join ln a on a.image_id=i.image_id and a.id=n1 join ln b on b.image_id=i.image_id and b.id=n2) select image_id, x1, y1, x2, y2 from le where (image_id, comp) in (select (image_id, comp) from le group by image_id, comp having sum(l) > 150)")
def _(s, d):
    return graph.drop_small_components(_e(s, d), 150)


@query("g5_chains", "with recursive bb as (" + _BOTH[1:-1] + "), two as (select image_id, x, y from bb group by 1,2,3 having count(distinct (nx,ny))=2), e as (select *, row_number() over (order by image_id,x1,y1,x2,y2) id from fx_edge_gt), inc as (select e.image_id, e.id, t.x, t.y from e join two t on t.image_id=e.image_id and ((t.x=x1 and t.y=y1) or (t.x=x2 and t.y=y2))), adj as (select a.id a, b.id b from inc a join inc b on a.image_id=b.image_id and a.x=b.x and a.y=b.y and a.id<>b.id), reach as (select id src, id node from e union select r.src, adj.b from reach r join adj on adj.a=r.node), comp as (select node, min(src) c from reach group by 1) select e.image_id, e.x1, e.y1, e.x2, e.y2, f.x1 cx1, f.y1 cy1, f.x2 cx2, f.y2 cy2 from e join comp on comp.node=e.id join e f on f.id=comp.c")
def _(s, d):
    return graph.chain_table(_e(s, d))


@query("g6_ring_halves")
def _(s, d):
    return graph.ring_halves(_e(s, d)).select("image_id", "half", "pos", "x", "y")


@query("g7_simplify")
def _(s, d):
    return graph.simplify(_e(s, d), 3.0)


@query("g8_merge_close")
def _(s, d):
    return graph.merge_close(_e(s, d), 17)


@query("g9_separate_border_ends")
def _(s, d):
    return graph.separate_border_ends(_e(s, d), 448, 448, 80, 40, 5)


@query("g10_merge_at_seams")
def _(s, d):
    e = _e(s, d)
    seams = e.select("image_id").distinct().withColumns({"vertical": F.lit(True), "at": F.lit(224), "lo": F.lit(0), "hi": F.lit(300)})
    return graph.merge_at_seams(e, seams, 40, 17)


@query("g11_connect_ends")
def _(s, d):
    return graph.connect_ends(_e(s, d), 448, 448, 30, 20)


def _cut_sql(source, keys, left, top, right, bottom):
    """SQL of edges cut at a rectangle: inside ends stay, others give way to the boundary."""
    inside = lambda k: f"x{k} between {left} and {right} and y{k} between {top} and {bottom}"
    p = f"case when {inside(1)} then {{'x': x1, 'y': y1}} when {inside(2)} then {{'x': h[1].x, 'y': h[1].y}} when len(h) > 1 then {{'x': h[1].x, 'y': h[1].y}} end"
    q = f"case when {inside(2)} then {{'x': x2, 'y': y2}} when {inside(1)} then {{'x': h[-1].x, 'y': h[-1].y}} when len(h) > 1 then {{'x': h[-1].x, 'y': h[-1].y}} end"
    return f"select distinct {keys}, least(p, q).x x1, least(p, q).y y1, greatest(p, q).x x2, greatest(p, q).y y2 from (select *, {p} p, {q} q from (select *, {_clipped(left, top, right, bottom)} h from {source}) a) b where p.x is not null and q.x is not null and (p.x <> q.x or p.y <> q.y)"


@query("g12_cut_inside", _cut_sql("fx_edge_gt", "image_id", 100, 100, 350, 350))
def _(s, d):
    e = _e(s, d).withColumns({"left": F.lit(100), "top": F.lit(100), "right": F.lit(350), "bottom": F.lit(350)})
    return graph.cut_at_rect(e).select(*_EK).distinct()


_TILES = "(select e.*, cast(3*(t.a//124) + l.a//124 as int) tile, l.a lft, t.a tp, l.a + 199 rgt, t.a + 199 btm from fx_edge_gt e cross join (select unnest([0, 150, 248]) a) l cross join (select unnest([0, 150, 248]) a) t)"


@query("g13_crop", f"select image_id, tile, x1-lft x1, y1-tp y1, x2-lft x2, y2-tp y2 from ({_cut_sql(_TILES, 'image_id, tile, lft, tp', 'lft', 'tp', 'rgt', 'btm')}) c")
def _(s, d):
    from waymesh.operators.raster import patches

    e = _e(s, d)
    tiles = e.select("image_id").distinct().crossJoin(F.broadcast(patches(s, 448, 448, 200, 50))).withColumnRenamed("patch_seq", "tile")
    return graph.crop(e, tiles.withColumns({"right": F.col("right") - 1, "bottom": F.col("bottom") - 1}))


@query("g14_hop_neighbourhood", f"with recursive ids as (select * from {_IDE} q), b as (select image_id, n1 a, n2 b from ids union select image_id, n2, n1 from ids), walk as (select distinct image_id, a src, a node, 0 h from b union select w.image_id, src, b.b, h+1 from walk w join b on b.image_id=w.image_id and b.a=w.node where h < 3) select image_id, src source, node, min(h) hops from walk group by 1,2,3")
def _(s, d):
    e = graph.to_node_edge(_e(s, d))[1].select("image_id", F.col("n1").alias("a"), F.col("n2").alias("b"), F.lit(1).alias("w"))
    src = e.select("image_id", F.explode(F.array("a", "b")).alias("source")).distinct()
    return iterate.shortest_paths(e, src, max_hops=3).withColumnRenamed("dist", "hops")


_KEYS = "cast(round_even((lat1*(1-({i})::double/n)+lat2*(({i})::double/n))*1e7,0) as bigint) ka{k}, cast(round_even((lon1*(1-({i})::double/n)+lon2*(({i})::double/n))*1e7,0) as bigint) ko{k}"


@query("g15_densify", f"select distinct * from (select image_id, {_KEYS.format(i='i', k=1)}, {_KEYS.format(i='i+1', k=2)} from (select *, unnest(range(n)) i from (select *, case when d > 3 then cast(trunc(d/2) as bigint)+1 else 1 end n from (select *, sqrt(pow(lat1-lat2,2)+pow((lon1-lon2)*cos(radians(lat1)),2))*111111 d from ({_LL}) a) b) c) e) f where not (ka1=ka2 and ko1=ko2)")
def _(s, d):
    return graph.densify(geo_edges(_e(s, d)))


@query("g16_road_graph", f"select image_id, row_number() over (partition by image_id order by n1, n2)-1 edge_id, n1, n2 from (select image_id, n1, n2 from {_IDE} q union select image_id, n2, n1 from {_IDE} r) t")
def _(s, d):
    return graph.road_graph(_e(s, d))[1]


@query("g16_road_nodes", f"select image_id, id node_id, 41 - x/111111e0 lat, -71 + y/111111e0/cos(radians(41)) lon from {_NODES} n")
def _(s, d):
    return graph.road_graph(_e(s, d))[0]


@query("g17_attach_edges", f"with n as (select image_id, id*7 k, id node_id from {_NODES} q), top as (select image_id, max(node_id) t from n group by 1), le as (select image_id, count(*)-1 last from {_IDE} q group by 1), w as (select image_id, id*14 k, 0 n2 from {_NODES} q where id % 5 = 0), f as (select image_id, k, t + row_number() over (partition by image_id order by k) node_id from (select distinct w.image_id, w.k from w where not exists (select 1 from n where n.image_id=w.image_id and n.k=w.k)) u join top using (image_id)) select w.image_id, last + row_number() over (partition by w.image_id order by w.k, n2) edge_id, e.node_id n1, n2 from w join (select image_id, k, node_id from n union all select * from f) e on e.image_id=w.image_id and e.k=w.k join le on le.image_id=w.image_id")
def _(s, d):
    n, e = graph.to_node_edge(_e(s, d))
    ids = F.row_number().over(Window.partitionBy("image_id").orderBy("n1", "n2")) - 1
    old = e.select("image_id", ids.alias("edge_id"), "n1", "n2", F.lit(1).alias("score"))
    nodes = n.select("image_id", (F.col("node_id") * 7).alias("key"), "node_id", "lat", "lon")
    new = n.where("node_id % 5 = 0").select("image_id", (F.col("node_id") * 14).alias("key"), "lat", "lon", F.lit(0).alias("n2"), F.lit(2).alias("score"))
    return graph.attach_edges(nodes, old, new)[1].where("score = 2").select("image_id", "edge_id", "n1", "n2")


@query("g18_reverse_links", f"select image_id, n2 n1, n1 n2 from {_IDE} q")
def _(s, d):
    return graph.reverse_links(graph.to_node_edge(_e(s, d))[1])


@query("g19_bidirect", f"select image_id, row_number() over (partition by image_id order by n1, n2)-1 edge_id, n1, n2, max(score) score from (select image_id, n1, n2, n1 % 7 score from {_IDE} q union all select image_id, n2, n1, n1 % 7 from {_IDE} r) t group by image_id, n1, n2")
def _(s, d):
    return graph.bidirect(graph.to_node_edge(_e(s, d))[1].withColumn("score", F.col("n1") % 7))


@query("g20_remove_nodes", f"select * from {_IDE} q where n1 % 5 <> 0 and n2 % 5 <> 0")
def _(s, d):
    n, e = graph.to_node_edge(_e(s, d))
    return graph.remove_nodes(e, n.where("node_id % 5 = 0")).select("image_id", "n1", "n2")


@query("g21_remove_dead_ends", f"with e as (select * from {_IDE} q), h as (select image_id, n1 id, n2 n, 1 o, 0 i from e union all select image_id, n2, n1, 0, 1 from e), dead as (select image_id, id from h group by 1,2 having (count(distinct n)=1 or sum(o)=0 or sum(i)=0) and id % 13 <> 0) select image_id, n1, n2 from e where not exists (select 1 from dead where dead.image_id=e.image_id and dead.id in (n1, n2))")
def _(s, d):
    n, e = graph.to_node_edge(_e(s, d))
    return graph.remove_dead_ends(e, n.where("node_id % 13 = 0")).select("image_id", "n1", "n2")


def _weighted(s, d):
    n, e = graph.to_node_edge(_e(s, d))
    p = n.select("image_id", "node_id", "x", "y")
    e = e.join(p.toDF("image_id", "n1", "xa", "ya"), ["image_id", "n1"]).join(p.toDF("image_id", "n2", "xb", "yb"), ["image_id", "n2"])
    return e.select("image_id", F.col("n1").cast("long").alias("a"), F.col("n2").cast("long").alias("b"), (100 * geo.euclidean("xa", "ya", "xb", "yb")).cast("long").alias("w"))


@query("g23_shortest_paths")
def _(s, d):
    e = iterate.cut(_weighted(s, d))
    ends = iterate.degree(e).where("degree <> 2").select("image_id", "node")
    both = e.union(e.select("image_id", "b", "a", "w"))
    return iterate.all_paths(both, ends)


@query("g22_single_pair")
def _(s, d):
    e = iterate.cut(_weighted(s, d))
    last = e.groupBy("image_id").agg(F.max("b").alias("last"))
    got = iterate.shortest_paths(e, last.select("image_id", F.lit(0).cast("long").alias("source")))
    return last.join(got, (got["image_id"] == last["image_id"]) & (got["node"] == last["last"]), "left").select(last["image_id"], F.coalesce(F.col("dist") / 100.0, F.lit(-0.01)).alias("dist"))


_SET = "(select image_id, row_, col_, heat from fx_pixel where heat > 0.3)"


@query("g27_pixel_graph", f"select a.image_id, a.row_, a.col_, b.row_ row2, b.col_ col2 from {_SET} a join {_SET} b on a.image_id=b.image_id and abs(a.row_-b.row_)<=1 and abs(a.col_-b.col_)<=1 and (b.row_ > a.row_ or (b.row_ = a.row_ and b.col_ > a.col_))")
def _(s, d):
    return graph.pixel_graph(table(s, d, "fx_pixel").where("heat > 0.3"))


@query("g28_skeleton_ends", f"select a.image_id, a.row_, a.col_ from {_SET} a join {_SET} b on a.image_id=b.image_id and abs(a.row_-b.row_)<=1 and abs(a.col_-b.col_)<=1 and not (b.row_ = a.row_ and b.col_ = a.col_) group by 1,2,3 having count(*) = 1")
def _(s, d):
    return graph.skeleton_ends(table(s, d, "fx_pixel").where("heat > 0.3"))


@query("g29_pixel_components", "with recursive p as (select image_id, row_, col_, heat, row_*32+col_ id from fx_pixel where heat > 0.35), adj as (select a.image_id, a.id a, b.id b from p a join p b on a.image_id=b.image_id and abs(a.row_-b.row_)<=1 and abs(a.col_-b.col_)<=1 and a.id<>b.id), reach as (select image_id, id src, id node from p union select r.image_id, r.src, adj.b from reach r join adj on adj.image_id=r.image_id and adj.a=r.node), comp as (select image_id, node, min(src) c from reach group by 1,2) select p.image_id, c // 32 comp_row, c % 32 comp_col, count(*) size, arg_max(row_, (heat, -id)) row_, arg_max(col_, (heat, -id)) col_, count(*) >= 4 is_road from p join comp on comp.image_id=p.image_id and comp.node=p.id group by p.image_id, c")
def _(s, d):
    return graph.pixel_components(table(s, d, "fx_pixel").where("heat > 0.35"))


@query("g30_keypoint_directions", f"select image_id, x, y, nx, ny, sn sin, cs cos, case when degrees(atan2(sn,cs)) < 0 then degrees(atan2(sn,cs))+360 else degrees(atan2(sn,cs)) end deg from (select *, (ny-y)/sqrt((x-nx)*(x-nx)+(y-ny)*(y-ny)) sn, (nx-x)/sqrt((x-nx)*(x-nx)+(y-ny)*(y-ny)) cs from {_BOTH} b) t")
def _(s, d):
    return graph.keypoint_directions(_e(s, d))


@query("s5_adjacency", f"select image_id, x node_x, y node_y, string_agg(nx || ':' || ny, ',' order by nx, ny) near from {_BOTH} b group by 1,2,3")
def _(s, d):
    a = graph.to_adjacency(_e(s, d))
    near = F.array_join(F.transform("neighbors", lambda n: F.concat(n["x"].cast("string"), F.lit(":"), n["y"].cast("string"))), ",")
    return a.select("image_id", F.col("node.x").alias("node_x"), F.col("node.y").alias("node_y"), near.alias("near"))


@query("s6_adjacency_import", "select * from fx_edge_gt")
def _(s, d):
    # lists that name half of the neighbours twice, and every node itself
    a = graph.to_adjacency(_e(s, d))
    return graph.from_adjacency(a.withColumn("neighbors", F.concat("neighbors", F.array("node"), F.slice("neighbors", 1, 2))))


@query("s7_node_edge_list", f"select * from {_IDE} q")
def _(s, d):
    return graph.to_node_edge(_e(s, d))[1].select("image_id", "n1", "n2")


@query("g31_graph_from_links", "select * from fx_edge_gt where x1 < x2")
def _(s, d):
    n, e = graph.to_node_edge(_e(s, d).where("x1 < x2"))
    links = e.union(e.select("image_id", "n2", "n1")).union(e.select("image_id", "n1", "n1"))
    return graph.edges_from_links(n, links.toDF("image_id", "i", "j"))


@query("path_error")
def _(s, d):
    from waymesh.operators import metrics

    return metrics.one_way(_e(s, d), table(s, d, "fx_edge_pred")).select("image_id", "n", (1 - F.col("score")).alias("error"))


@query("g24_position_distance")
def _(s, d):
    from waymesh.operators import topology

    n, e = graph.road_graph(_e(s, d))
    p = n.select("image_id", "node_id", "lat", "lon")
    at = e.where("n1 < n2").join(p.toDF("image_id", "n1", "lat1", "lon1"), ["image_id", "n1"]).join(p.toDF("image_id", "n2", "lat2", "lon2"), ["image_id", "n2"])
    at = at.select("image_id", "edge_id", "n1", "n2", (geo.deg_distance("lat1", "lon1", "lat2", "lon2") / 4).alias("d"))
    a = at.select("image_id", F.col("edge_id").alias("pair"), F.col("n1").alias("a1"), F.col("n2").alias("a2"), F.col("d").alias("ad1"), (3 * F.col("d")).alias("ad2"))
    b = at.select("image_id", (F.col("edge_id") + 3).alias("pair"), F.col("n1").alias("b1"), F.col("n2").alias("b2"), (2 * F.col("d")).alias("bd1"), (2 * F.col("d")).alias("bd2"))
    return topology.edge_position_distance(p, e, a.join(b, ["image_id", "pair"]), 0.002)


def _starts(s, d):
    n, e = graph.road_graph(_e(s, d))
    p = n.select("image_id", "node_id", "lat", "lon")
    at = e.where("n1 < n2 and edge_id % 20 = 0").join(p.toDF("image_id", "n1", "lat1", "lon1"), ["image_id", "n1"]).join(p.toDF("image_id", "n2", "lat2", "lon2"), ["image_id", "n2"])
    off = geo.deg_distance("lat1", "lon1", "lat2", "lon2") / 2
    return p, e, at.select("image_id", F.col("edge_id").alias("start"), "n1", "n2", off.alias("d1"), off.alias("d2"))


@query("g25_walk")
def _(s, d):
    from waymesh.operators import topology

    p, e, starts = _starts(s, d)
    return topology.walk(p, e, starts, r=0.0008)


@query("g26_walk_from_nodes")
def _(s, d):
    from waymesh.operators import topology

    p, e, starts = _starts(s, d)
    return topology.walk_from_nodes(p, e, starts.select("image_id", "start", F.col("n1").alias("node")), r=0.0008)
