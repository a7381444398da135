"""Road, keypoint, pixel, score and loss tables derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymesh.session import trust_no_unions

VERTEX = """select image_id, road_id, seq, ord_key, cast(16*least(27,greatest(0, sx + cx)) as int) x, cast(16*least(27,greatest(0, sy + cy)) as int) y, prio
from (select image_id, road_id, seq, ord_key, sx, sy, prio,
        sum(dx) over (partition by road_id order by seq) cx, sum(dy) over (partition by road_id order by seq) cy
      from (select cast(floor(o_orderkey/400) as bigint) image_id, cast(floor(o_orderkey/8) as bigint) road_id,
              o_orderkey % 8 seq, o_orderkey ord_key, (o_custkey % 3) - 1 dx,
              (cast(floor(o_totalprice) as bigint) % 3) - 1 dy,
              (cast(floor(o_orderkey/8) as bigint)*7) % 28 sx, (cast(floor(o_orderkey/8) as bigint)*11) % 28 sy,
              o_orderpriority prio from orders) a) b"""
EDGE = """select distinct image_id, case when fwd then x else x2 end x1, case when fwd then y else y2 end y1,
       case when fwd then x2 else x end x2, case when fwd then y2 else y end y2
from (select image_id, x, y, x2, y2, (x < x2 or (x = x2 and y < y2)) fwd
      from (select image_id, x, y, lead(x) over (partition by road_id order by seq) x2, lead(y) over (partition by road_id order by seq) y2
            from {v}) p where x2 is not null and not (x = x2 and y = y2)) q"""
PIXEL = """select cast(floor(event_id/1024) as bigint) image_id, cast(floor((event_id % 1024)/32) as int) row_, cast(event_id % 32 as int) col_,
 case when event_type = 'error' then 5 else cast(floor(value) as int) % 256 end b, case when event_type = 'error' then 5 else cast(floor(value*3) as int) % 256 end g,
 case when event_type = 'error' then 5 else cast(floor(value*7) as int) % 256 end r, value / 500 heat from events"""
KEYPOINT = """select cast(floor(o_orderkey/40) as bigint) patch_id, o_orderkey % 40 kp_seq, cast((o_orderkey*7919 + o_custkey*31) % 448 as int) x,
 cast((o_orderkey*104729 + o_custkey*17) % 448 as int) y, o_custkey % 5 + 1 n_dirs from orders"""
DIRECTION = """select patch_id, kp_seq, x, y, d dir_idx, (kp_seq*37 + x*3 + d*67) % 360 deg, cast((kp_seq*13 + d*29 + y) % 100 as double) / 100 prob
 from fx_keypoint cross join (select 0 d union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) s where d < n_dirs"""
SCORE = """select cast(l_linenumber as int) run_id, l_orderkey image_id, cast(min(l_discount*10) as double) apls_raw, cast(max(l_tax*10) as double) precision_raw, cast(min(l_quantity/50) as double) recall_raw, case when max(l_returnflag)='N' and min(l_suppkey) % 7 = 0 then 1 else 0 end is_nan from lineitem group by 1,2"""
LOSS_DUCK = """select vec_id sample_id, cast(pos as int) pos, cast(embedding[pos + 1] as double) * 8 pred, case when pos % 10 = label then 1.0::double when pos % 10 = (label + 1) % 10 then 0.5 else 0.0 end gt, case when pos % 16 = 15 then 0 else 1 end valid from embeddings cross join (select unnest(range(64)) pos) p"""
LOSS_SPARK = """select vec_id sample_id, pos, cast(e as double) * 8 pred, case when pos % 10 = label then 1.0D when pos % 10 = (label + 1) % 10 then 0.5D else 0.0D end gt, case when pos % 16 = 15 then 0 else 1 end valid from embeddings lateral view posexplode(embedding) t as pos, e"""

DUCK = {
    "fx_vertex": VERTEX,
    "fx_vertex_pred": "select image_id, road_id, seq, x, y from fx_vertex where road_id % 11 <> 0 and not (seq = 7 and road_id % 5 = 0)",
    "fx_edge_gt": EDGE.format(v="fx_vertex"),
    "fx_edge_pred": EDGE.format(v="fx_vertex_pred"),
    "fx_pixel": PIXEL,
    "fx_keypoint": KEYPOINT,
    "fx_direction": DIRECTION,
    "fx_score": SCORE,
    "fx_loss": LOSS_DUCK,
}
SOURCE = {"fx_vertex": "orders", "fx_vertex_pred": "fx_vertex", "fx_pixel": "events", "fx_keypoint": "orders", "fx_direction": "fx_keypoint", "fx_score": "lineitem", "fx_loss": "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived one."""
    trust_no_unions(spark)
    if not name.startswith("fx_"):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name.startswith("fx_edge"):
        from waymesh.operators.graph import edges_from_vertices

        return edges_from_vertices(table(spark, sf_dir, "fx_vertex" if name == "fx_edge_gt" else "fx_vertex_pred"))
    source = SOURCE[name]
    text = LOSS_SPARK if name == "fx_loss" else DUCK[name]
    return spark.sql(text.replace(f"from {source}", "from {src}"), src=table(spark, sf_dir, source))


def duck(sql: str) -> str:
    """sql for DuckDB with the derived tables it names defined in front."""
    need: list[str] = []

    def want(text: str) -> None:
        for n in DUCK:
            if n in text.replace("fx_vertex_pred", "" if n == "fx_vertex" else "fx_vertex_pred") and n not in need:
                want(DUCK[n])
                need.append(n)

    want(sql)
    head = ", ".join(f"{n} as ({DUCK[n]})" for n in need)
    if not head:
        return sql
    body = sql.strip()
    if body.startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if body.startswith("with ") else f"with {head} {body}"
