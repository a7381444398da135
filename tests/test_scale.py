"""Steps that have to stay linear, against plain versions."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from waymesh.operators import graph, iterate, matching
from waymesh.session import cut


def test_size_on_disk_does_not_make_a_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    t = cut(spark.range(400_000).selectExpr("id", "id % 3 as x", "id % 5 as y"))
    plan = t.alias("a").join(t.alias("b"), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a lower one stays
    cut(spark.range(3))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")


def test_greedy_selection_by_one_task_and_in_rounds(spark):
    r = random.Random(4)
    rows = [(g, r.randrange(25), r.randrange(25), r.randrange(9)) for g in range(6) for _ in range(200)]
    rows += [(9, 0, k, 1) for k in range(3000)]  # one end of all pairs: 4.5 million clashes
    rows = sorted({(g, a, b): (g, a, b, c) for g, a, b, c in rows}.values())
    want, used = set(), set()
    for g, a, b, c in sorted(rows, key=lambda x: (x[0], x[3], x[1], x[2])):
        if (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            want.add((g, a, b))
    df = spark.createDataFrame(rows, "g long, a long, b long, cost long")
    text = df.selectExpr("g", "cast(a as string) a", "cast(b as string) b", "cost", "a as x", "b as y")
    assert {(x["g"], x["a"], x["b"]) for x in matching.select_ascending(df, "g").collect()} == want
    ends = [F.expr(f"named_struct('s', {k}, 'n', {c})") for k, c in enumerate("ab")]
    for t, most in ((df, 50), (text, 500_000)):
        order = ["cost", *(("a", "b") if t is df else ("x", "y"))]
        got = matching._greedy(t, "g", order, ends, most=most)
        assert {(x["g"], int(x["a"]), int(x["b"])) for x in got.collect()} == want


def test_searches_of_whole_groups_equal_rounds(spark):
    r = random.Random(5)
    edges = [(g, r.randrange(30), r.randrange(30), r.random()) for g in range(4) for _ in range(60)]
    e = spark.createDataFrame(edges, "image_id long, a long, b long, w double")
    seeds = [(g, (s, float(s)), n, d) for g in range(5) for s in range(6) for n, d in ((s, 0.1), (s + 7, 0.2 * s))]
    src = spark.createDataFrame(seeds, "image_id long, source struct<s:long,r:double>, node long, dist double")
    for how in ({"max_dist": 1.2}, {"directed": True}):
        got = [sorted(map(str, iterate.shortest_paths(e, src, most=most, **how).collect())) for most in (1000, 0)]
        assert got[0] == got[1] and len(got[0]) > 60


def test_apart_by_one_task_equals_conflicts(spark):
    r = random.Random(6)
    links = [(g, r.randrange(60), r.randrange(60)) for g in range(5) for _ in range(55)]
    items = [(g, i, r.randrange(60), r.random() < 0.2, r.randrange(30)) for g in range(5) for i in range(40)]
    e = spark.createDataFrame(links, "image_id long, a long, b long")
    x = spark.createDataFrame(items, "image_id long, id long, node long, free boolean, key long")
    got = [sorted((y["image_id"], y["id"]) for y in iterate.apart(x, e, 2, most=most).collect()) for most in (1000, 0)]
    assert got[0] == got[1] and 60 < len(got[0]) < 240


def test_assignment_costs_what_brute_force_finds():
    r = np.random.default_rng(7)
    for k in range(200):
        n = int(r.integers(1, 5))
        m = n + int(r.integers(0, 3))
        c = r.integers(0, 4, (n, m)).astype(float) if k % 2 else r.random((n, m))
        got = matching.assignment(c)
        want = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert len(set(got.tolist())) == n and abs(c[np.arange(n), got].sum() - want) < 1e-9


def test_tries_of_border_ends_are_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    rows = [(g, 0, 100 * k + d, 30, 100 * k + d) for g in range(3) for k in range(4) for d in (0, 4)]
    e = spark.createDataFrame(rows, "image_id long, x1 int, y1 int, x2 int, y2 int")
    out = graph.separate_border_ends(e, 448, 448, 10, 10, 3)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert not any("BroadcastHashJoin" in x and "try#" in x for x in plan.splitlines())
    assert out.count() == len(rows)
