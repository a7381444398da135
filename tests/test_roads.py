"""Road operators against sequential twins, hand fixtures and invariants."""

import itertools
import random

import numpy as np
import pytest

from waymesh.operators import graph, iterate, matching, raster
from waymesh.plans import registry
from waymesh.sources import io

SF = "/root/testdata/sf0.001"


def edges(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "image_id long, x1 int, y1 int, x2 int, y2 int")


def test_ordered_greedy_equals_a_scan(spark):
    r = random.Random(1)
    rows, want = [], {}
    for g in range(20):
        pairs = {(a, b) for a, b in itertools.combinations(range(15), 2) if r.random() < 0.2}
        rows += [(g, a, b) for a, b in pairs]
        taken = set()
        for i in range(15):
            if not any(a in taken and b == i for a, b in pairs):
                taken.add(i)
        want |= {(g, i): i in taken for i in range(15)}
    items = spark.createDataFrame([(g, i) for g in range(20) for i in range(15)], "image_id int, id int")
    got = iterate.ordered_greedy(items, spark.createDataFrame(rows, "image_id int, a int, b int")).collect()
    assert {(x["image_id"], x["id"]): x["taken"] for x in got} == want


def test_chains_and_rings(spark):
    road = [(0, 0, 10, 0), (10, 0, 20, 1), (20, 1, 30, 0)]
    ring = [(100, 0, 110, 0), (110, 0, 110, 10), (100, 10, 110, 10), (100, 0, 100, 10)]
    tail = [(100, 0, 100, -20)]
    got = graph.chain_table(edges(spark, road + ring + tail)).collect()
    assert len({(x["cx1"], x["cy1"], x["cx2"], x["cy2"]) for x in got}) == 3
    simple = {tuple(x)[1:] for x in graph.simplify(edges(spark, road), 3.0).collect()}
    assert simple == {(0, 0, 30, 0)}
    assert graph.simplify(edges(spark, ring), 1.0, raster=False).count() == 4


def test_merge_close(spark):
    got = {tuple(x)[1:] for x in graph.merge_close(edges(spark, [(0, 0, 4, 0), (4, 0, 50, 0)]), 5).collect()}
    assert got == {(2, 0, 50, 0)}


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 6)):
        c = r.random((n, m))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        got = matching.assignment(c)
        assert len(set(got)) == n and abs(c[np.arange(n), got].sum() - best) < 1e-9


def test_ownership_covers_each_pixel_once(spark):
    px = spark.range(32 * 32).selectExpr("1L image_id", "cast(id / 32 as int) row_", "cast(id % 32 as int) col_")
    got = raster.ownership(px, 32, 32, 12, 2)
    assert got.count() == got.select("row_", "col_").distinct().count() == 1024


def test_geojson(spark, tmp_path):
    p = tmp_path / "a.geojson"
    p.write_text('{"features":[{"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}},{"geometry":{"type":"MultiLineString","coordinates":[[[5,6]],[[7,8],[9,1]]]}}]}')
    got = [(r["road_id"], r["part"], r["seq"], r["lon"], r["lat"]) for r in io.read_geojson(spark, f"file://{p}").orderBy("road_id", "part", "seq").collect()]
    assert got == [(0, 0, 0, 1.0, 2.0), (0, 0, 1, 3.0, 4.0), (1, 0, 0, 5.0, 6.0), (1, 1, 0, 7.0, 8.0), (1, 1, 1, 9.0, 1.0)]
    with pytest.raises(Exception, match="unexpected geometry"):
        io.read_geojson(spark, f"file://{p}", ("LineString",)).collect()


def test_queries_and_sql_share_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
