"""Queries of direction, matching, metric, experiment and streaming operators, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.operators import directions, experiment, graph, iterate, jobs, losses, matching, metrics, raster, topology
from waymesh.sources import io
from waymesh.sources.fixtures import table
from waymesh.session import dealt, shared_dir
from waymesh.streaming.scores import current_scores, keep_running, latest_scores, running_scores, score_on_arrival

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


KEYS = ["patch_id", "kp_seq"]


def _d(s, d):
    return table(s, d, "fx_direction")


_SUB = "(select list_sort(list(v order by v)) subset, count(*) k from (select m, unnest(range(6)) v from (select unnest(range(1,64)) m) a) b where (m >> v) & 1 = 1 group by m)"
_ALLOC = f"(select patch_id, kp_seq, a, arg_min(subset, (list_sum([abs(a[i] - (subset[i]*60+30)) for i in range(1, k+1)]), subset)) subset from (select patch_id, kp_seq, list_sort(list(deg)) a from fx_direction group by 1,2) q join {_SUB} s on s.k = len(a) group by 1,2,3)"


@query("d1_allocate", f"select patch_id, kp_seq, unnest(a) deg, unnest(subset) sector from {_ALLOC} t")
def _(s, d):
    return directions.allocate(_d(s, d), KEYS)


@query("d2_in_order", "select patch_id, kp_seq, deg, row_number() over (partition by patch_id, kp_seq order by deg, dir_idx)-1 sector from fx_direction")
def _(s, d):
    return directions.in_order(_d(s, d), KEYS)


@query("d3_without_order", "select patch_id, kp_seq, deg, row_number() over (partition by patch_id, kp_seq order by dir_idx)-1 sector from fx_direction")
def _(s, d):
    return directions.reslot(_d(s, d), KEYS, "without_order")


@query("d4_reslot", f"select patch_id, kp_seq, unnest(a) deg, unnest(subset) sector, 'allocate' as mode from {_ALLOC} t union all select patch_id, kp_seq, deg, row_number() over (partition by patch_id, kp_seq order by deg, dir_idx)-1 sector, 'order' from fx_direction")
def _(s, d):
    parts = [directions.reslot(_d(s, d), KEYS, m).select(*KEYS, "deg", F.col("sector").cast("long"), F.lit(m).alias("mode")) for m in ("allocate", "order")]
    return parts[0].union(parts[1])


@query("d5_flip", "select patch_id, kp_seq, 447-x x, y, dir_idx, (540-deg) % 360 deg from fx_direction")
def _(s, d):
    return directions.flip(_d(s, d), 448, 448, True).select("patch_id", "kp_seq", "x", "y", "dir_idx", "deg")


@query("d5_random_flip")
def _(s, d):
    return directions.random_flip(_d(s, d), KEYS, ["patch_id"], 448, 448, 3)


@query("d6_rotate", "select patch_id, kp_seq, 447-y x, x y, dir_idx, (deg+90) % 360 deg from fx_direction")
def _(s, d):
    return directions.rotate(_d(s, d), 448, 1).select("patch_id", "kp_seq", "x", "y", "dir_idx", "deg")


@query("d6_random_rotate")
def _(s, d):
    return directions.random_rotate(_d(s, d), KEYS, ["patch_id"], 448, 3)


def _slots(s, d):
    v = directions.with_vectors(_d(s, d)).groupBy(*KEYS, "x", "y").agg(F.array_sort(F.collect_list(F.struct("dir_idx", "prob", "sin", "cos"))).alias("a"))
    return v.select(*KEYS, "x", "y", F.transform("a", lambda x: F.struct(x["prob"].alias("prob"), x["sin"].alias("sin"), x["cos"].alias("cos"))).alias("a"))


@query("d7_clean")
def _(s, d):
    return _slots(s, d).select(*KEYS, F.posexplode(directions.clean(F.col("a"), 30.0)).alias("slot", "d")).select(*KEYS, "slot", "d.prob")


@query("d8_clean_border")
def _(s, d):
    return _slots(s, d).select(*KEYS, F.posexplode(directions.clean_border(F.col("a"), F.col("x"), F.col("y"), 448, 448, 30.0, 100)).alias("slot", "d")).select(*KEYS, "slot", "d.prob")


@query("d9_normalise", "select patch_id, kp_seq, dir_idx, case when prob >= 0.3 then prob else 0 end prob, case when prob >= 0.3 then sin(radians(deg)) else 0 end sin, case when prob >= 0.3 then cos(radians(deg)) else 0 end cos from fx_direction")
def _(s, d):
    v = directions.with_vectors(_d(s, d)).withColumns({"sin": 3 * F.col("sin"), "cos": 3 * F.col("cos")})
    return directions.normalise(v, 0.3).select(*KEYS, "dir_idx", "prob", "sin", "cos")


@query("d10_pack_unpack", f"select patch_id, kp_seq, cast(sector as int) sector, 1e0 prob, sin(radians(deg)) sin, cos(radians(deg)) cos from (select patch_id, kp_seq, unnest(a) deg, unnest(subset) sector from {_ALLOC} t) u")
def _(s, d):
    v = directions.with_vectors(directions.allocate(_d(s, d), KEYS))
    return directions.unpack(directions.pack(v, KEYS), KEYS)


@query("d11_shift_border")
def _(s, d):
    return directions.shift_border(table(s, d, "fx_keypoint"), 5, 448, 448, 3)


def _directed(s, d):
    """Directions with their slots and vectors, for linking."""
    return directions.with_vectors(_d(s, d).withColumnRenamed("dir_idx", "slot"))


@query("j1_direction_pairs", "select a.patch_id, a.kp_seq i, a.dir_idx si, b.kp_seq j, b.dir_idx sj from fx_direction a join fx_direction b on a.patch_id=b.patch_id and a.kp_seq < b.kp_seq and (b.deg // 60 - a.deg // 60 + 6) % 6 in (2,3,4)")
def _(s, d):
    return matching.direction_pairs(_directed(s, d)).select("patch_id", "i", "si", "j", "sj")


@query("j2_link_greedy")
def _(s, d):
    return matching.link_greedy(matching.pair_costs(_directed(s, d)))


@query("j3_link_closest")
def _(s, d):
    return matching.link_closest(matching.line_costs(_directed(s, d)))


@query("j4_link_assign")
def _(s, d):
    return matching.link_assign(matching.pair_costs(_directed(s, d)))


@query("e17_designed_distance", "select a.patch_id, a.kp_seq i, b.kp_seq j, 100*sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/448e0 * min(sqrt(pow(sin(radians(a.deg))+sin(radians(b.deg)),2)+pow(cos(radians(a.deg))+cos(radians(b.deg)),2))) dist from fx_direction a join fx_direction b on a.patch_id=b.patch_id and a.kp_seq < b.kp_seq group by a.patch_id, a.kp_seq, b.kp_seq, a.x, a.y, b.x, b.y")
def _(s, d):
    return matching.designed_distances(_directed(s, d), 448, 448)


def _nodes(s, d):
    return graph.to_node_edge(table(s, d, "fx_edge_gt"))[0].select("image_id", F.col("node_id").cast("long").alias("id"), "x", "y")


_BOTH = "(select image_id, x1 x, y1 y, x2 nx, y2 ny from {t} union all select image_id, x2, y2, x1, y1 from {t})"
_NUM = "(select image_id, x, y, row_number() over (partition by image_id order by x, y)-1 id from (select distinct image_id, x, y from " + _BOTH + " b0) b1)"
_GT, _PR = _NUM.format(t="fx_edge_gt"), _NUM.format(t="fx_edge_pred")


@query("j5_nearest", f"select image_id, ida, idb, dist from (select a.image_id, a.id ida, b.id idb, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) dist, row_number() over (partition by a.image_id, a.id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.id) r from {_GT} a join {_PR} b using (image_id)) t where r = 1 and dist <= 40")
def _(s, d):
    a, b = table(s, d, "fx_edge_gt"), table(s, d, "fx_edge_pred")
    return _knn(a, b, 1, 40).drop("rank")


@query("j5_nearest_candidate", "select patch_id, kp_seq, arg_min(lo, (dist, dd, lo, di)) loc_idx, arg_min(di, (dist, dd, lo, di)) dir_idx from (select a.patch_id, a.kp_seq, abs(a.x//64-b.x//64) + abs(a.y//64-b.y//64) dist, b.deg % 7 dd, b.kp_seq lo, b.dir_idx di from fx_keypoint a join fx_direction b on a.patch_id=b.patch_id and a.kp_seq <> b.kp_seq) t group by 1,2")
def _(s, d):
    a = table(s, d, "fx_keypoint").select(*KEYS, F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = _d(s, d).select("patch_id", F.col("kp_seq").alias("loc_idx"), "dir_idx", "x", "y", (F.col("deg") % 7).alias("dir_dist"))
    cell = lambda u, v: F.abs(F.floor(F.col(u) / 64) - F.floor(F.col(v) / 64))
    # a patch's candidates are sorted in its task, so patches are dealt over tasks that hold them without spilling
    a, b = (dealt(x, 50_000, "patch_id", of=_d(s, d)) for x in (a, b))
    c = a.join(b, "patch_id").where("kp_seq <> loc_idx").withColumn("dist", cell("ax", "x") + cell("ay", "y"))
    return matching.nearest_candidate(c, KEYS)


def _knn(a, b, k, r):
    n = lambda e, p: graph.to_node_edge(e)[0].select("image_id", F.col("node_id").alias(f"id{p}"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    return matching.knn_join(n(a, "a"), n(b, "b"), k, r).select("image_id", "ida", "idb", "dist", "rank")


@query("j6_seam_match")
def _(s, d):
    n = _nodes(s, d)
    lines = F.array(F.struct(F.lit(0).alias("seam"), F.lit(True).alias("vertical"), F.lit(224).alias("at"), F.lit(0).alias("lo"), F.lit(447).alias("hi")), F.struct(F.lit(1).alias("seam"), F.lit(False).alias("vertical"), F.lit(223).alias("at"), F.lit(100).alias("lo"), F.lit(400).alias("hi")))
    seams = n.select("image_id").distinct().select("image_id", F.explode(lines).alias("l")).select("image_id", "l.*")
    return matching.seam_match(n, seams, 40, 50)


_PAIRS = "(select image_id, ida a, idb b, round(dist, 6) cost from (select a.image_id, a.id ida, b.id idb, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) dist from {a} a join {b} b using (image_id)) t where dist <= 20)"


@query("j7_select_ascending")
def _(s, d):
    p = _knn(table(s, d, "fx_edge_gt"), table(s, d, "fx_edge_pred"), 50, 20)
    return matching.select_ascending(p.select("image_id", F.col("ida").alias("a"), F.col("idb").alias("b"), F.col("dist").alias("cost")), "image_id")


@query("j7_totals")
def _(s, d):
    p = _knn(table(s, d, "fx_edge_gt"), table(s, d, "fx_edge_pred"), 50, 20)
    return matching.ascending_totals(p.select("image_id", F.col("ida").alias("a"), F.col("idb").alias("b"), F.col("dist").alias("cost")), "image_id")


@query("j8_matching_size")
def _(s, d):
    p = _knn(table(s, d, "fx_edge_gt"), table(s, d, "fx_edge_pred"), 50, 20).select("image_id", F.col("ida").alias("a"), F.col("idb").alias("b"), F.col("dist").alias("cost"))
    return matching.component_match(p, "image_id").groupBy("image_id").agg(F.count("*").alias("size"))


@query("j8_matching_rounds")
def _(s, d):
    p = _knn(table(s, d, "fx_edge_gt"), table(s, d, "fx_edge_pred"), 50, 20).select("image_id", F.col("ida").cast("long").alias("a"), F.col("idb").cast("long").alias("b"))
    return matching.matching_rounds(p, "image_id").groupBy("image_id").agg(F.count("*").alias("size"))


@query("j11_segment_boxes", f"select n.image_id, n.id node, e.x1, e.y1, e.x2, e.y2 from {_GT} n join fx_edge_pred e on e.image_id=n.image_id and least(e.x1, e.x2) <= n.x + 20 and greatest(e.x1, e.x2) >= n.x - 20 and least(e.y1, e.y2) <= n.y + 20 and greatest(e.y1, e.y2) >= n.y - 20")
def _(s, d):
    n = _nodes(s, d).select("image_id", F.col("id").alias("node"), F.col("x").alias("lat"), F.col("y").alias("lon"))
    e = table(s, d, "fx_edge_pred").toDF("image_id", "lat1", "lon1", "lat2", "lon2")
    return matching.segment_box_join(n, e, 20, 64).select("image_id", "node", F.col("lat1").alias("x1"), F.col("lon1").alias("y1"), F.col("lat2").alias("x2"), F.col("lon2").alias("y2"))


@query("j9_radius_join", f"select a.image_id, a.id ida, b.id idb, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) dist from {_GT} a join {_GT} b using (image_id) where a.id < b.id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 1600")
def _(s, d):
    n = _nodes(s, d)
    j = iterate.grid_join(n.toDF("image_id", "ida", "ax", "ay"), n.toDF("image_id", "idb", "bx", "by"), 40)
    return j.where("ida < idb").select("image_id", "ida", "idb", "dist")


@query("j10_knn_join", f"select * from (select a.image_id, a.id ida, b.id idb, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) dist, row_number() over (partition by a.image_id, a.id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.id) rank from {_GT} a join {_PR} b using (image_id)) t where rank <= 10 and dist <= 40")
def _(s, d):
    return _knn(table(s, d, "fx_edge_gt"), table(s, d, "fx_edge_pred"), 10, 40)


@query("j12_sorted_pairs", "select patch_id, a.kp_seq i, b.kp_seq j, row_number() over (partition by patch_id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), a.kp_seq, b.kp_seq) r from fx_keypoint a join fx_keypoint b using (patch_id) where a.kp_seq < b.kp_seq")
def _(s, d):
    from pyspark.sql import Window

    k = table(s, d, "fx_keypoint").select(*KEYS, "x", "y")
    p = k.toDF("patch_id", "i", "ax", "ay").join(k.toDF("patch_id", "j", "bx", "by"), "patch_id").where("i < j")
    w = Window.partitionBy("patch_id").orderBy(geo.euclidean("ax", "ay", "bx", "by"), "i", "j")
    return p.select("patch_id", "i", "j", F.row_number().over(w).alias("r"))


def _score(s, d):
    return table(s, d, "fx_score").withColumn("apls", F.when(F.col("is_nan") == 1, F.lit(float("nan"))).otherwise(F.col("apls_raw")))


def _dense(s, d, t="fx_edge_gt"):
    return metrics._Dense(table(s, d, t))


@query("a_control_points")
def _(s, d):
    g = _dense(s, d)
    return metrics.control_points(g.nodes, g.links, g.runs)


@query("a3_snap")
def _(s, d):
    g, o = _dense(s, d), _dense(s, d, "fx_edge_pred")
    return metrics.snap(iterate.cut(metrics.control_points(g.nodes, g.links, g.runs)), g.nodes, o.nodes, o.links)


@query("a4_key_paths")
def _(s, d):
    g = _dense(s, d)
    cp = iterate.cut(metrics.control_points(g.nodes, g.links, g.runs).select("image_id", "node"))
    return metrics.all_key_paths(g.nodes, g.runs, cp)


@query("a5_path_scores", "select image_id, count(e) n, 1-avg(e) score from (select image_id, case when matched = 0 then 1 when d1 > 25 then least(1, abs(d1-greatest(d2,0))/d1) end e from (select image_id, is_nan matched, apls_raw*100 d1, precision_raw*100-10 d2 from fx_score) a) b group by 1")
def _(s, d):
    p = table(s, d, "fx_score").select("image_id", (F.col("is_nan") == 1).alias("matched"), (F.col("apls_raw") * 100).alias("d1"), (F.col("precision_raw") * 100 - 10).alias("d2"))
    return metrics.path_scores(p, 25.0)


@query("a7_mean_score", "select run_id, coalesce(sum(case when is_nan=0 then apls_raw end),0)/greatest(sum(case when is_nan=0 then 1 else 0 end),1) mean from fx_score group by 1")
def _(s, d):
    return metrics.mean_score(_score(s, d), "apls", ["run_id"])


@query("b11_apls")
def _(s, d):
    return metrics.apls(table(s, d, "fx_edge_pred"), table(s, d, "fx_edge_gt"))


def _roads(s, d, t):
    return graph.road_graph(table(s, d, t))


@query("b11_apls_tile")
def _(s, d):
    return metrics.apls(table(s, d, "fx_edge_pred"), table(s, d, "fx_edge_gt"), metrics.TILE)


@query("t1_evaluation_window", f"select image_id, lo - 300/111111e0 min_lat, -71 - 500/111111e0 min_lon, 41 + 300/111111e0 max_lat, hi + 500/111111e0 max_lon, case when 41 - lo < 0.01 then 0.0015e0 else 0.003e0 end radius from (select image_id, least(41, min(41 - x/111111e0)) lo, greatest(-71, max(-71 + y/111111e0/cos(radians(41)))) hi from (select image_id, x, y from {_GT} a union all select image_id, x, y from {_PR} b) c group by 1) f")
def _(s, d):
    return topology.evaluation_window(_roads(s, d, "fx_edge_pred")[0], _roads(s, d, "fx_edge_gt")[0])


def _paired(s, d):
    return topology._Pair(_roads(s, d, "fx_edge_pred"), _roads(s, d, "fx_edge_gt"), 0.0001, 0.0005)


@query("t2_starting_points")
def _(s, d):
    n, e = _roads(s, d, "fx_edge_gt")
    return topology.starting_points(n, e, topology.evaluation_window(_roads(s, d, "fx_edge_pred")[0], n))


@query("t3_pair_starts")
def _(s, d):
    x = _paired(s, d)
    return x.pairs.drop("r")


@query("t4_pair_nodes")
def _(s, d):
    (n, e), (tn, te) = _roads(s, d, "fx_edge_pred"), _roads(s, d, "fx_edge_gt")
    window = topology.evaluation_window(n, tn)
    mask = s.range(64 * 64).select((F.col("id") / 64).cast("int").alias("row_"), (F.col("id") % 64).cast("int").alias("col_")).where("(row_ + col_) % 3 > 0")
    return topology.pair_nodes(n, e, tn, te, window.select("image_id").crossJoin(F.broadcast(mask)), window, (64, 64))


@query("t6_sample_matches")
def _(s, d):
    x = _paired(s, d)
    return topology.matched_samples(x.pred, x.truth, x.pairs, x.starts, 0.0001, 0.0006)


@query("t7_start_scores")
def _(s, d):
    x = _paired(s, d)
    return topology.start_scores(x.pred, x.truth, x.pairs, x.starts)


@query("b11_topo")
def _(s, d):
    return topology.topo(_roads(s, d, "fx_edge_pred"), _roads(s, d, "fx_edge_gt"))


@query("b11_sampled_topology")
def _(s, d):
    return topology.topo(_roads(s, d, "fx_edge_pred"), _roads(s, d, "fx_edge_gt"), one_to_one=False)


@query("t11_random_scores")
def _(s, d):
    return topology.random_scores(_roads(s, d, "fx_edge_pred"), _roads(s, d, "fx_edge_gt"), 10, 5, r=0.0008)


@query("t12_list_scores")
def _(s, d):
    (n, e), (tn, te) = _roads(s, d, "fx_edge_pred"), _roads(s, d, "fx_edge_gt")
    near = iterate.grid_join(n.select("image_id", F.col("node_id").alias("node"), F.col("lat").alias("ax"), F.col("lon").alias("ay")), tn.select("image_id", F.col("node_id").alias("truth_node"), F.col("lat").alias("bx"), F.col("lon").alias("by")), 1e-7)
    return topology.list_scores((n, e), (tn, te), near.select("image_id", "truth_node", "node"), r=0.0008)


@query("t13_soft_scores")
def _(s, d):
    x = _paired(s, d)
    return topology.soft_scores(x.pred, x.truth, x.pairs, x.starts)


@query("t9_dataset_topology", 'select run_id, p "precision", r "recall", coalesce(2*p*r/nullif(p+r,0),0) f1 from (select run_id, avg(precision_raw) p, avg(recall_raw) r from fx_score group by 1) t')
def _(s, d):
    return metrics.dataset_topology(table(s, d, "fx_score").withColumns({"precision": F.col("precision_raw"), "recall": F.col("recall_raw")}), ["run_id"])


@query("s9_score_lines", "select run_id, image_id, printf('%.6f %.6f %.6f', apls_raw, precision_raw, recall_raw) line from fx_score")
def _(s, d):
    t = table(s, d, "fx_score").withColumn("image_id", F.struct("run_id", "image_id"))
    return io.score_lines(t, "apls_raw", "precision_raw", "recall_raw").select("image_id.*", "line")


@query("s10_parse_lines", "select run_id, image_id, recall_raw v, precision_raw p, case when is_nan = 1 then 0 else recall_raw end r from fx_score")
def _(s, d):
    t = table(s, d, "fx_score")
    line = F.concat(F.lit("precision="), F.col("precision_raw").cast("string"), F.when(F.col("is_nan") == 1, " recall=x").otherwise(F.concat(F.lit(" recall="), F.col("recall_raw").cast("string"))))
    p, r = io.parse_topology_line(line)
    v = io.parse_path_line(F.concat(F.lit("0 1 "), F.col("recall_raw").cast("string")))
    return t.select("run_id", "image_id", v.alias("v"), p.alias("p"), r.alias("r"))


@query("s11_summary", "select 'run ' || run_id || ': ' || n line from (select run_id, count(*) n from fx_score group by 1) t")
def _(s, d):
    path = f"{shared_dir(s)}/summary-{uuid.uuid4().hex}"
    t = table(s, d, "fx_score").groupBy("run_id").agg(F.count("*").alias("value")).select("run_id", F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("name"), "value")
    for k in (0, 1, 0):  # two runs of a job append to one summary, one of them twice
        io.append_summary(t.where(F.col("run_id") % 2 == k), path, f"job-{k}")
    return s.read.text(path).select(F.col("value").alias("line"))


@query("s9_score_sink", "select run_id, image_id, apls_raw, case when image_id % 2 = 0 then 'even' else 'odd' end as batch from fx_score")
def _(s, d):
    path = f"{shared_dir(s)}/scores-{uuid.uuid4().hex}"
    t = table(s, d, "fx_score").select("run_id", "image_id", "apls_raw")
    for k, name in ((0, "even"), (1, "odd"), (1, "odd")):
        io.write_scores(t.where(F.col("image_id") % 2 == k), path, name)
    return s.read.parquet(path).select("run_id", "image_id", "apls_raw", "batch")


@query("s3_dataset_round_trip", f"select patch_id, cast(kp_seq as int) kp_seq, x::double x, y::double y, cast(sector as int) sector, sin(radians(deg)) sin, cos(radians(deg)) cos from (select k.patch_id, k.kp_seq, x, y, unnest(a) deg, unnest(subset) sector from {_ALLOC} t join fx_keypoint k using (patch_id, kp_seq)) u")
def _(s, d):
    kp = table(s, d, "fx_keypoint").select(*KEYS, "x", "y")
    flat = directions.pack(directions.with_vectors(directions.allocate(_d(s, d), KEYS)), KEYS).join(kp, KEYS)
    path = f"{shared_dir(s)}/dataset-{uuid.uuid4().hex}"
    io.write_dataset_json(flat.select(F.col("patch_id").cast("string").alias("image_name"), F.lit(448).alias("height"), F.lit(448).alias("width"), "kp_seq", F.col("x").cast("double"), F.col("y").cast("double"), "flat"), path)
    back = io.read_dataset_json(s, path, lines=True).select(F.col("image_name").cast("long").alias("patch_id"), "kp_seq", "x", "y", "flat")
    got = directions.unpack(back, ["patch_id", "kp_seq", "x", "y"])
    return got.select("patch_id", "kp_seq", "x", "y", "sector", "sin", "cos")


@query("s1_geojson_round_trip", "select image_id, cast(road_id % 50 as int) road_id, cast(seq as int) seq, x::double lon, y::double lat from fx_vertex")
def _(s, d):
    path = f"{shared_dir(s)}/geojson-{uuid.uuid4().hex}"
    v = table(s, d, "fx_vertex")
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    roads = v.groupBy("image_id", "road_id").agg(line.alias("line"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.when(F.col("road_id") % 2 == 0, "LineString").otherwise("MultiLineString").alias("type"), F.when(F.col("road_id") % 2 == 0, F.to_json("line")).otherwise(F.to_json(F.array("line"))).alias("coordinates")).alias("geometry"))
    files = roads.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("road_id", feature.alias("f")))), lambda x: x["f"]).alias("features"))
    # coordinates are JSON themselves, not text
    text = F.regexp_replace(F.to_json(F.struct("features")), r'"coordinates":"(\[[^"]*\])"', r'"coordinates":$1')
    files.select("image_id", text.alias("value")).repartition("image_id").write.partitionBy("image_id").text(path)
    got = io.read_geojson(s, f"{path}/*/*.txt")
    return got.select(F.regexp_extract("file", r"image_id=(\d+)", 1).cast("long").alias("image_id"), "road_id", "seq", "lon", "lat")


@query("s12_pairing", "select 'both' side, image_id from (select image_id from fx_edge_gt intersect select image_id from fx_edge_pred where image_id % 3 <> 0) a union all select 'truth', image_id from (select image_id from fx_edge_gt except select image_id from fx_edge_pred where image_id % 3 <> 0) b")
def _(s, d):
    both, lone = io.pair_inputs(table(s, d, "fx_edge_pred").where("image_id % 3 <> 0"), table(s, d, "fx_edge_gt"), "image_id")
    return both.select(F.lit("both").alias("side"), "image_id").union(lone.select("side", "image_id"))


@query("s13_unscored", "select run_id, image_id from fx_score a where run_id = 1 and not exists (select 1 from fx_score b where b.run_id = 2 and b.image_id = a.image_id)")
def _(s, d):
    t = table(s, d, "fx_score")
    return io.unscored(t.where("run_id = 1"), t.where("run_id = 2"), ["image_id"]).select("run_id", "image_id")


_FOREST = "(select road_id tree_id, seq id, greatest(seq-1, 0) parent, cast(y as double) lat, cast(x as double) lon, case when ord_key % 9 = 0 then road_id end sim_tree, case when ord_key % 9 = 0 then 0 end sim_id, case when ord_key % 11 = 0 then 1 else 0 end out_region from fx_vertex)"


def _forest(s, d):
    hit = F.col("ord_key") % 9 == 0
    return table(s, d, "fx_vertex").select(F.col("road_id").alias("tree_id"), F.col("seq").alias("id"), F.greatest(F.col("seq") - 1, F.lit(0)).alias("parent"), F.col("y").cast("double").alias("lat"), F.col("x").cast("double").alias("lon"), F.when(hit, F.col("road_id")).alias("sim_tree"), F.when(hit, F.lit(0).cast("long")).alias("sim_id"), F.when(F.col("ord_key") % 11 == 0, 1).otherwise(0).alias("out_region"))


@query("s14_forest_edges", f"with f as (select * from {_FOREST} q) select distinct c.tree_id t1, c.parent i1, coalesce(c.sim_tree, c.tree_id) t2, coalesce(c.sim_id, c.id) i2, p.lat lat1, p.lon lon1, coalesce(l.lat, c.lat) lat2, coalesce(l.lon, c.lon) lon2 from f c join f p on p.tree_id=c.tree_id and p.id=c.parent left join f l on l.tree_id=c.sim_tree and l.id=c.sim_id where c.lat between 50 and 400 and c.lon between 50 and 400")
def _(s, d):
    e = io.forest_edges(_forest(s, d), (50, 50, 400, 400))[0]
    return e.select(F.col("n1.t").alias("t1"), F.col("n1.i").alias("i1"), F.col("n2.t").alias("t2"), F.col("n2.i").alias("i2"), "lat1", "lon1", "lat2", "lon2")


@query("s14_forest_terminals", f"select distinct tree_id t, parent i from {_FOREST} q where out_region = 1 and lat between 50 and 400 and lon between 50 and 400")
def _(s, d):
    return io.forest_edges(_forest(s, d), (50, 50, 400, 400))[1].select("node.t", "node.i")


@query("b1_sequential_batches", "select epoch, o_orderkey, (n // 64) batch, cast(n % 64 as int) slot from (select epoch, o_orderkey, row_number() over (partition by epoch order by o_orderkey)-1 n from orders cross join (select unnest([1,2]) epoch) e) t where n < (select count(*) // 64 * 64 from orders)")
def _(s, d):
    return experiment.epoch_batches(table(s, d, "orders").select("o_orderkey"), "o_orderkey", [1, 2], 64, None).select("epoch", "o_orderkey", "batch", "slot")


@query("b1_shuffled_batches")
def _(s, d):
    return experiment.epoch_batches(table(s, d, "orders").select("o_orderkey"), "o_orderkey", [1, 2], 64, 7)


@query("b2_epoch_means", "select run_id, image_id // 1000 epoch, avg(apls_raw) apls_raw, avg(precision_raw) precision_raw from fx_score group by 1,2")
def _(s, d):
    return experiment.epoch_means(table(s, d, "fx_score").withColumn("epoch", F.floor(F.col("image_id") / 1000)), ["run_id", "epoch"], ["apls_raw", "precision_raw"])


@query("b3_best_checkpoints", "select run_id, image_id, apls_raw from (select *, coalesce(max(apls_raw) over (partition by run_id order by image_id rows between unbounded preceding and 1 preceding), -999) b from fx_score where image_id >= 10 and image_id % 5 = 0) t where apls_raw > b")
def _(s, d):
    return experiment.best_checkpoints(table(s, d, "fx_score"), "run_id", "image_id", "apls_raw", 5, 10).select("run_id", "image_id", "apls_raw")


@query("b4_score_tiles", "select image_id, row_, col_, cast(b+g+r as double)/3 loc from fx_pixel")
def _(s, d):
    return experiment.score_tiles(table(s, d, "fx_pixel"), lambda p: p.assign(loc=(p["b"] + p["g"] + p["r"]) / 3)[["image_id", "row_", "col_", "loc"]], "image_id long, row_ int, col_ int, loc double")


def _heat(s, d):
    """Heat maps of patches, four to an image, drawn around keypoints."""
    kp = table(s, d, "fx_keypoint")
    maps = raster.gaussian_maps(kp, 3, 448, 448)
    v = directions.with_vectors(_d(s, d).withColumnRenamed("dir_idx", "slot"))
    j = raster.direction_arrays(maps, v)
    return j.select(F.floor(F.col("patch_id") / 4).alias("image_id"), (F.col("patch_id") % 4).cast("int").alias("patch_seq"), "row_", "col_", "loc", "dirs")


@query("b4_stitch")
def _(s, d):
    return jobs.stitch(_heat(s, d), 768, 768, 448, 128, logits=False)


@query("b5_stitch_centrelines")
def _(s, d):
    p = table(s, d, "fx_pixel").where("heat > 0.35")
    px = p.select(F.floor(F.col("image_id") / 4).alias("image_id"), (F.col("image_id") % 4).cast("int").alias("patch_seq"), "row_", "col_")
    return jobs.stitch_centrelines(px, 60, 60, 32, 4, eps=2)


@query("b6_training_samples")
def _(s, d):
    kp = table(s, d, "fx_keypoint").select(*KEYS, "x", "y")
    out = jobs.training_samples(kp, _d(s, d).select(*KEYS, "dir_idx", "deg"), [1], 448, 1, 9)
    return out.groupBy("patch").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"), F.sum("prob").alias("prob")).select("patch.*", "n", "loc", "prob")


@query("b6_sample_pixels")
def _(s, d):
    px = table(s, d, "fx_pixel").withColumnRenamed("image_id", "patch_id")
    return jobs.sample_pixels(px, [1, 2], 32, 9).select("patch.*", "row_", "col_", "b", "g", "r", "valid")


@query("b7_truth_relink")
def _(s, d):
    return graph.to_adjacency(jobs.relink(_directed(s, d))).select("image_id", F.col("node.x").alias("x"), F.col("node.y").alias("y"), F.size("neighbors").alias("n"))


@query("b8_image_dataset")
def _(s, d):
    v = table(s, d, "fx_vertex").withColumn("road_id", F.col("road_id") % 50)
    records, _lone = jobs.image_dataset(v, table(s, d, "fx_edge_pred").select("image_id"))
    return records.select("image_id", "kp_seq", "x", "y", F.posexplode("flat").alias("k", "v")).where("v is not null")


@query("b9_cropped_dataset")
def _(s, d):
    px = table(s, d, "fx_edge_gt").select("image_id").distinct().join(table(s, d, "fx_pixel").drop("image_id").distinct().groupBy("row_", "col_").agg(*(F.max(c).alias(c) for c in ("b", "g", "r"))).where("row_ < 28 and col_ < 28").select((F.col("row_") * 16).alias("row_"), (F.col("col_") * 16).alias("col_"), "b", "g", "r"))
    records, _mask = jobs.cropped_dataset(table(s, d, "fx_edge_gt"), px, 448, 448, 224)
    return records.select("image_id", "tile", "kp_seq", "x", "y", F.posexplode("flat").alias("k", "v")).where("v is not null")


@query("b10_heat_export", "select image_id, cast(2*(row_//16) + col_//16 as int) patch_seq, row_ % 16 row_, col_ % 16 col_, cast(floor(255/(1+exp(-heat))) as int) level from fx_pixel")
def _(s, d):
    p = raster.assign_patches(table(s, d, "fx_pixel"), 32, 32, 16, 0)
    p = raster.heat_overlay(p)
    return p.select("image_id", "patch_seq", (F.col("row_") - F.col("top")).alias("row_"), (F.col("col_") - F.col("left")).alias("col_"), F.floor("heat8").cast("int").alias("level"))


@query("b10_heat_maps", "select image_id, cast(2*py + px as int) patch_seq, cast(m as int) map, row_ - 12*py row_, col_ - 12*px col_, cast(floor(255/(1+exp(-(case when m=0 then heat else cast(b + m*g - r as double)/64 end)))) as int) level from fx_pixel cross join (select unnest(range(7)) m) maps join (select unnest([0,1]) py) a on row_ between 12*py and 12*py+19 join (select unnest([0,1]) px) c on col_ between 12*px and 12*px+19")
def _(s, d):
    none = F.lit(0.0)
    slot = lambda m: F.struct(((F.col("b") + m * F.col("g") - F.col("r")) / 64.0).alias("prob"), none.alias("sin"), none.alias("cos"))
    px = table(s, d, "fx_pixel").select("image_id", "row_", "col_", F.col("heat").alias("loc"), F.array(*(slot(m) for m in range(1, 7))).alias("dirs"))
    return jobs.heat_export(px, 32, 32, 20, 8)


@query("st1_running_scores", "select run_id, sum(case when is_nan=0 then apls_raw end) total, count(case when is_nan=0 then 1 end) n, avg(case when is_nan=0 then apls_raw end) mean from fx_score group by 1")
def _(s, d):
    return running_scores(_score(s, d))


@query("st1_running_stream", "select run_id, image_id // 10 epoch, sum(case when is_nan=0 then apls_raw end) total, count(case when is_nan=0 then 1 end) n, avg(case when is_nan=0 then apls_raw end) mean from fx_score group by 1,2")
def _(s, d):
    home = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    scores = _score(s, d).select("run_id", F.floor(F.col("image_id") / 10).alias("epoch"), "apls")
    scores.repartition(3).write.parquet(f"{home}/in")
    arriving = s.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    keep_running(arriving, f"{home}/out", f"{home}/log", by=("run_id", "epoch")).awaitTermination()
    return current_scores(s, f"{home}/out")


@query("st2_score_on_arrival", "select p.image_id, cast(count(*) as bigint) n, cast(sum(case when t.x1 is not null then 1 else 0 end) as bigint) hits, sum(abs(p.x1-p.x2) + abs(p.y1-p.y2)) length from fx_edge_pred p left join fx_edge_gt t on t.image_id=p.image_id and t.x1=p.x1 and t.y1=p.y1 and t.x2=p.x2 and t.y2=p.y2 group by 1")
def _(s, d):
    home = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    e, truth = table(s, d, "fx_edge_pred"), iterate.cut(table(s, d, "fx_edge_gt"))
    ends = ["image_id", "x1", "y1", "x2", "y2"]
    e.repartition(3, F.xxhash64("image_id", "x1", "y1")).write.parquet(f"{home}/in")  # an image's edges arrive in several files
    arriving = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")

    def metric(whole, same):
        both = whole.join(same.select(*ends, F.lit(1).alias("hit")), ends, "left")
        return both.groupBy("image_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"), F.sum(F.abs(F.col("x1") - F.col("x2")) + F.abs(F.col("y1") - F.col("y2"))).alias("length"))

    score_on_arrival(arriving, metric, f"{home}/out", f"{home}/log", truth).awaitTermination()
    return latest_scores(s, f"{home}/out")


@query("l7_detector_labels", "select sample_id, avg(a) loss_loc, avg(b) loss_prob, avg(c) loss_vec from (select sample_id, part, case when part='loc' then l end a, case when part='prob' then l end b, case when part='vec' then l end c from (select sample_id, part, least(sum(pow(pred-gt,2)*w*valid)/greatest(sum(w*valid)/n,1e-8),100) l from (select sample_id, pred, gt, valid, case pos % 4 when 0 then 'loc' when 1 then 'prob' else 'vec' end part, case when pos % 4 < 2 then 1 else 2 end n, case when g = 0 and pos % 4 < 2 then 0.002e0 else g end w from (select *, max(case when pos % 4 = 0 then gt end) over (partition by sample_id, pos // 4) g from fx_loss) p) q group by sample_id, part, n) r) t group by 1")
def _(s, d):
    from waymesh.plans.raster_queries import detector_rows

    return losses.detector(detector_rows(s, d), "sample_id", ("mse", "mse", "mse"), channels=(1, 1, 2)).drop("loss_sum")
