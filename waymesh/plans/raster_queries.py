"""Queries of raster, loss and direction operators, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymesh.operators import losses, raster
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


def _p(s, d):
    return table(s, d, "fx_pixel")


_AT = "image_id, row_, col_"


@query("r1_rescale8", "select image_id, row_, col_, cast(trunc((b-bl)*255e0/(bh-bl)) as int) b, cast(trunc((g-gl)*255e0/(gh-gl)) as int) g, cast(trunc((r-rl)*255e0/(rh-rl)) as int) r from fx_pixel join (select image_id, min(b) bl, max(b) bh, min(g) gl, max(g) gh, min(r) rl, max(r) rh from fx_pixel group by 1) using (image_id)")
def _(s, d):
    return raster.rescale8(_p(s, d)).select("image_id", "row_", "col_", "b", "g", "r")


@query("r2_clahe")
def _(s, d):
    return raster.clahe(_p(s, d), "b", 16)


@query("r3_valid_ratio", "select image_id, avg(case when b=5 and g=5 and r=5 then 0e0 else 1e0 end) valid_ratio from fx_pixel group by 1")
def _(s, d):
    return raster.valid_ratio(_p(s, d))


_S = "(select unnest([0, 10, 20]) a)"


@query("r4_patch_of_pixel", f"select image_id, row_, col_, cast(3*(t.a//10) + l.a//10 as int) patch_seq from fx_pixel cross join {_S} l cross join {_S} t where col_ >= l.a and col_ < l.a+12 and row_ >= t.a and row_ < t.a+12")
def _(s, d):
    return raster.assign_patches(_p(s, d), 32, 32, 12, 2).select("image_id", "row_", "col_", "patch_seq")


@query("r6_ownership", f"select image_id, row_, col_, min(cast(3*(t.a//10) + l.a//10 as int)) patch_seq from fx_pixel cross join {_S} l cross join {_S} t where col_ >= l.a + (case when l.a=0 then 0 else 1 end) and col_ < l.a+12-(case when l.a=20 then 0 else 1 end) and row_ >= t.a + (case when t.a=0 then 0 else 1 end) and row_ < t.a+12-(case when t.a=20 then 0 else 1 end) group by 1,2,3")
def _(s, d):
    return raster.ownership(_p(s, d), 32, 32, 12, 2)


@query("r4_patches", "select cast(3*(t.a//10) + l.a//10 as int) patch_seq, l.a lft, t.a tp, l.a+12 rgt, t.a+12 btm, n from (select unnest([0, 10, 20]) a) l cross join (select unnest([0, 10, 20]) a) t cross join (select count(*) n from fx_pixel) c")
def _(s, d):
    n = _p(s, d).agg(F.count("*").alias("n"))
    return raster.patches(s, 32, 32, 12, 2).crossJoin(n).select("patch_seq", F.col("left").alias("lft"), F.col("top").alias("tp"), F.col("right").alias("rgt"), F.col("bottom").alias("btm"), "n")


@query("r7_border_penalty", f"select {_AT}, case when near then heat - 0.1e0 else heat end heat, case when near then b/255e0 - 0.1e0 else b/255e0 end p0, case when near then g/255e0 - 0.1e0 else g/255e0 end p1 from (select *, col_ < 5 or col_ >= 27 or row_ < 5 or row_ >= 27 near from fx_pixel) t")
def _(s, d):
    one = lambda c: F.struct((F.col(c) / 255.0).alias("prob"), F.lit(0.0).alias("sin"), F.lit(1.0).alias("cos"))
    p = raster.border_penalty(_p(s, d).withColumn("dirs", F.array(one("b"), one("g"))), 32, 32, 5, dirs="dirs")
    return p.select("image_id", "row_", "col_", "heat", F.col("dirs")[0]["prob"].alias("p0"), F.col("dirs")[1]["prob"].alias("p1"))


_SUP = "(select a.image_id, a.row_, a.col_, case when a.heat = max(b.heat) then a.heat else 0 end heat from fx_pixel a join fx_pixel b on a.image_id=b.image_id and abs(a.row_-b.row_)<=2 and abs(a.col_-b.col_)<=2 group by a.image_id, a.row_, a.col_, a.heat)"


@query("r8_suppress", f"select * from {_SUP} q")
def _(s, d):
    return raster.suppress(_p(s, d).select("image_id", "row_", "col_", "heat"), 5)


@query("r9_top_k", f"select * from (select {_AT}, heat, row_number() over (partition by image_id order by heat desc, row_, col_) rank from {_SUP} q) t where rank <= 20 and heat >= 0.3")
def _(s, d):
    return raster.top_k(raster.suppress(_p(s, d).select("image_id", "row_", "col_", "heat"), 5), 20, 0.3)


@query("r11_decode_keypoints", f"select t.*, b, g, r from (select {_AT}, heat, row_number() over (partition by image_id order by heat desc, row_, col_) rank from {_SUP} q) t join fx_pixel p using (image_id, row_, col_) where rank <= 20 and t.heat >= 0.3")
def _(s, d):
    return raster.decode_keypoints(_p(s, d), 5, 20, 0.3)


_GA = "(select patch_id, kp_seq, y+dy row_, x+dx col_, exp(-(dx*dx+dy*dy)/0.5e0) wt from fx_keypoint cross join (select unnest([-1,0,1]) dx) a cross join (select unnest([-1,0,1]) dy) b)"


@query("r13_gaussian_maps", f"select patch_id, row_, col_, max(wt) loc, arg_max(kp_seq, (wt, -kp_seq)) kp_seq from {_GA} q where row_ between 0 and 447 and col_ between 0 and 447 group by 1,2,3")
def _(s, d):
    return raster.gaussian_maps(table(s, d, "fx_keypoint"), 1, 448, 448)


_WON = f"(select patch_id, row_, col_, max(wt) loc, arg_max(kp_seq, (wt, -kp_seq)) kp_seq from {_GA} q where row_ between 0 and 447 and col_ between 0 and 447 group by 1,2,3)"
_SIX = f"{_WON} m cross join (select unnest(range(6)) slot) six left join fx_direction f on f.patch_id=m.patch_id and f.kp_seq=m.kp_seq and f.dir_idx=slot"


@query("r13_direction_maps", f"select m.patch_id, row_, col_, cast(slot as int) slot, coalesce(prob, 0) prob, coalesce(sin(radians(deg)), 0) sin, coalesce(cos(radians(deg)), 0) cos from {_SIX}")
def _(s, d):
    from waymesh.operators.directions import with_vectors

    m = raster.gaussian_maps(table(s, d, "fx_keypoint"), 1, 448, 448)
    return raster.direction_maps(m, with_vectors(table(s, d, "fx_direction")).withColumnRenamed("dir_idx", "slot"), False)


@query("r14_direction_weights", f"select m.patch_id, row_, col_, cast(slot as int) slot, loc prob, coalesce(sin(radians(deg)), 0) sin, coalesce(cos(radians(deg)), 0) cos from {_SIX}")
def _(s, d):
    from waymesh.operators.directions import with_vectors

    m = raster.gaussian_maps(table(s, d, "fx_keypoint"), 1, 448, 448)
    return raster.direction_maps(m, with_vectors(table(s, d, "fx_direction")).withColumnRenamed("dir_idx", "slot"), True)


@query("r15_location_map", f"select patch_id, row_, col_, 3*max(wt) loc from {_GA} q where row_ between 0 and 447 and col_ between 0 and 447 group by 1,2,3")
def _(s, d):
    return raster.gaussian_maps(table(s, d, "fx_keypoint"), 1, 448, 448, k=3.0).drop("kp_seq")


@query("r16_keypoint_mask", "select p.image_id, row_, col_, case when k.patch_id is null then 0 else 1 end mask from fx_pixel p left join (select distinct patch_id, x % 32 x, y % 32 y from fx_keypoint) k on k.patch_id=p.image_id and k.x=col_ and k.y=row_")
def _(s, d):
    kp = table(s, d, "fx_keypoint").select(F.col("patch_id").alias("image_id"), (F.col("x") % 32).alias("x"), (F.col("y") % 32).alias("y"))
    return raster.keypoint_mask(_p(s, d), kp)


_LP = "select distinct image_id, cast(round_even(x1+(x2-x1)*i::double/n,0) as int) x, cast(round_even(y1+(y2-y1)*i::double/n,0) as int) y from (select *, unnest(range(n+1)) i from (select *, greatest(abs(x2-x1),abs(y2-y1)) n from fx_edge_gt) a) b"


@query("r17_centerline", _LP)
def _(s, d):
    return raster.centerline(table(s, d, "fx_edge_gt"))


@query("r18_thick_mask", "select distinct image_id, x, y from (select *, greatest(0, least(1, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))::double/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) t from (select *, unnest(range(least(y1,y2)-4, greatest(y1,y2)+5)) y from (select *, unnest(range(least(x1,x2)-4, greatest(x1,x2)+5)) x from fx_edge_gt) a) b) c where sqrt(pow(x-x1-t*(x2-x1),2)+pow(y-y1-t*(y2-y1),2)) <= 3.25")
def _(s, d):
    return raster.thick_mask(table(s, d, "fx_edge_gt"), 6.5)


@query("r19_flip_rotate", "select image_id, 31 - col_ row_, 31 - row_ col_, b from fx_pixel")
def _(s, d):
    return raster.rotate(raster.flip(_p(s, d), 32, 32, True), 32, 1).select("image_id", "row_", "col_", "b")


@query("r20_noise")
def _(s, d):
    return raster.noise(_p(s, d), "b", 10.0, 0.5, 7).select("image_id", "row_", "col_", "b")


@query("r21_hsv_jitter")
def _(s, d):
    return raster.hsv_jitter(_p(s, d), 0.2, 0.2, 10.0, 7).select("image_id", "row_", "col_", "b", "g", "r")


@query("r22_heat_overlay", f"select {_AT}, 255/(1+exp(-heat)) heat8, 0.2e0*(b+g+r)/3 + 0.8e0*255/(1+exp(-heat)) overlay from fx_pixel")
def _(s, d):
    return raster.heat_overlay(_p(s, d)).select("image_id", "row_", "col_", "heat8", "overlay")


@query("r23_one_hot", "select vec_id, cast(i as int) i, case when i = label then 0.9e0 else 0.1e0/9 end v from embeddings cross join (select unnest(range(10)) i) t")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.posexplode(raster.one_hot(F.col("label"), 10, 0.1)).alias("i", "v"))
    return e


_W = "(select *, case when gt = 0 then 0.002e0 else gt end w from fx_loss)"


def _l(s, d):
    return table(s, d, "fx_loss").withColumn("w", F.when(F.col("gt") == 0, 0.002).otherwise(F.col("gt")))


_P = "(select *, 1/(1+exp(-pred)) p from (select *, case when gt = 0 then 0.002e0 else gt end w from fx_loss) q0)"
_BCE = "-(ln(greatest(p, 1e-8))*gt + ln(greatest(1-p, 1e-8))*(1-gt))"
_SQ = "(greatest(gt - 0.002e0, 0) + 0.001e0)"
_FOCAL = f"-(pow(1-greatest(p, 1e-8), 2)*pow({_SQ}, 4)*ln(greatest(p, 1e-8)) + pow(greatest(p, 1e-8), 2)*pow(1-{_SQ}, 4)*ln(greatest(1-greatest(p, 1e-8), 1e-8)))"


def _mean(e, weight=None, valid=None):
    """SQL of a mean by its denominator, capped."""
    f = "*".join(x for x in (weight, valid) if x)
    return f"least(sum(({e})*{f})/greatest(sum({f}), 1e-8), 100)" if f else f"least(avg({e})*10, 100)"


@query("l1_mse", f"select sample_id, {_mean('pow(pred-gt, 2)', 'w', 'valid')} loss from {_P} q group by 1")
def _(s, d):
    return losses.mse(_l(s, d), "sample_id")


@query("l2_smooth_l1", f"select sample_id, sum(case when abs((pred-gt)*w) < 1 then 0.5*pow((pred-gt)*w,2) else abs((pred-gt)*w)-0.5 end)/greatest(sum(w), 1e-8) loss from {_P} q group by 1")
def _(s, d):
    return losses.smooth_l1(_l(s, d), "sample_id")


@query("l3_bce_mean", f"select sample_id, {_mean(_BCE, 'w', 'valid')} loss from {_P} q group by 1")
def _(s, d):
    return losses.bce(_l(s, d), "sample_id")


@query("l3_bce_weight_only", f"select sample_id, {_mean(_BCE, 'w')} loss from {_P} q group by 1")
def _(s, d):
    return losses.bce(_l(s, d), "sample_id", valid=None)


@query("l3_bce_mask_only", f"select sample_id, {_mean(_BCE, None, 'valid')} loss from {_P} q group by 1")
def _(s, d):
    return losses.bce(_l(s, d), "sample_id", weight=None)


@query("l3_bce_sum", f"select sample_id, sum(({_BCE})*valid*w) loss from {_P} q group by 1")
def _(s, d):
    return losses.bce(_l(s, d), "sample_id", "sum")


@query("l3_bce_none", f"select sample_id, avg(({_BCE})*valid*w) loss from {_P} q group by 1")
def _(s, d):
    return losses.bce(_l(s, d), "sample_id", "none")


@query("l3_bce_unweighted", f"select sample_id, {_mean(_BCE)} loss from {_P} q group by 1")
def _(s, d):
    return losses.bce(_l(s, d), "sample_id", weight=None, valid=None)


@query("l4_focal", f"select sample_id, {_mean(_FOCAL, 'w', 'valid')} loss from {_P} q group by 1")
def _(s, d):
    return losses.focal(_l(s, d), "sample_id")


@query("l4_focal_unweighted", f"select sample_id, {_mean(_FOCAL)} loss from {_P} q group by 1")
def _(s, d):
    return losses.focal(_l(s, d), "sample_id", weight=None, valid=None)


_DICE = "1 - 2*sum(p*gt)/greatest(sum(gt)+sum(p), 1e-8)"


@query("l5_dice", f"select sample_id, {_DICE} loss from {_P} q group by 1")
def _(s, d):
    return losses.dice(_l(s, d), "sample_id")


@query("l5_dice_mean", f"select batch, avg(l) loss from (select sample_id % 10 batch, sample_id, {_DICE} l from {_P} q group by 1,2) t group by 1")
def _(s, d):
    return losses.dice(_l(s, d).withColumn("batch", F.col("sample_id") % 10), "sample_id", batch="batch")


@query("l6_bce_dice", f"select sample_id, {_mean(_BCE)} + {_DICE} loss from {_P} q group by 1")
def _(s, d):
    return losses.composed(_l(s, d), "sample_id")


def detector_rows(s, d):
    """Loss rows as pixels of four channels: location, probability and a vector of two."""
    t = table(s, d, "fx_loss")
    g = F.max(F.when(F.col("pos") % 4 == 0, F.col("gt"))).over(Window.partitionBy("sample_id", F.floor(F.col("pos") / 4)))
    part = F.when(F.col("pos") % 4 == 0, "loc").when(F.col("pos") % 4 == 1, "prob").otherwise("vec")
    return t.withColumns({"w": g, "part": part})


_DET = "(select *, 1/(1+exp(-pred)) p from (select sample_id, pred, gt, valid, pos % 4 ch, case when g = 0 and pos % 4 < 2 then 0.002e0 else g end w from (select *, max(case when pos % 4 = 0 then gt end) over (partition by sample_id, pos // 4) g from fx_loss) p0) q0)"


@query("l7_detector", f"select sample_id, loss_loc, loss_prob, loss_vec, loss_loc + 5*loss_prob + 10*loss_vec loss_sum from (select sample_id, {_mean(_FOCAL, 'w', 'valid')} loss_loc from {_DET} q where ch = 0 group by 1) a join (select sample_id, {_mean(_FOCAL, 'w', 'valid')} loss_prob from {_DET} q where ch = 1 group by 1) b using (sample_id) join (select sample_id, least(sum(pow(pred-gt, 2)*w*valid)/greatest(sum(w*valid)/2, 1e-8), 100) loss_vec from {_DET} q where ch > 1 group by 1) c using (sample_id)")
def _(s, d):
    return losses.detector(detector_rows(s, d), "sample_id", channels=(1, 1, 2))


@query("r12_skeleton_keypoints")
def _(s, d):
    from waymesh.operators import jobs

    p = _p(s, d).where("heat > 0.35")
    one = lambda k, c: F.struct((F.col(c) / 255.0).alias("prob"), F.sin(F.lit(float(k))).alias("sin"), F.cos(F.lit(float(k))).alias("cos"))
    px = p.select("image_id", "row_", "col_", F.col("heat").alias("loc"), F.array(one(0, "b"), one(1, "g"), one(2, "r")).alias("dirs"))
    return jobs.skeleton_keypoints(px, 4)[0].select("image_id", "x", "y", F.col("dirs")[0]["prob"].alias("p0"), F.col("dirs")[1]["prob"].alias("p1"))


@query("r24_augment", "select image_id, 31 - col_ row_, 31 - row_ col_, (b/255e0-0.3336e0)/0.2078e0 b from fx_pixel")
def _(s, d):
    from waymesh.functions import geo
    from waymesh.operators.jobs import augment

    steps = [lambda t: raster.flip(t, 32, 32, True), lambda t: raster.rotate(t, 32, 1), lambda t: t.withColumn("b", geo.standardise("b", 0.3336, 0.2078))]
    return augment(_p(s, d), steps).select("image_id", "row_", "col_", "b")
