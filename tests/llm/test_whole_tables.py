"""Whitening, mixing and manifests: whole results against brute force, and edge rows."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.llm import manifest, mixing, registry, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, idx long, tree long, key string, part int, kept int, target double"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, 9, "k", 1, 2, 0.5) for r in rows], DOCS)


#: Nulls in every column, empty and long texts, repeated rows and ids, ties.
ROWS = [
    (1, "a few words", "en", "s1", 11),
    (1, "a few words", "en", "s1", 11),
    (1, "a few words", "en", "s1", 11),
    (1, "other words here", "en", "s1", None),
    (None, "no id", "en", "s2", 5),
    (None, "no id", "en", "s2", 5),
    (5, None, None, "s2", 0),
    (6, "", "", None, 0),
    (7, "x " * 60_000, "fr", None, 120_000),
    (8, " \t\n", None, "", 3),
    (9, None, None, None, None),
    (18, "é 漢字 \U0001f600", "z", "\U0001f600", 6),
    (19, "tied", "z", "￿", 6),
]


# ---- operator 11


def spectrum(x, k):
    u = np.unique(x, axis=0)
    y = u - u.mean(0)
    e, q = np.linalg.eigh(y.T @ y / len(u))
    return u, e[::-1][:k], q[:, ::-1][:, :k]


def test_whitening_query_against_lapack(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = registry.op11_embedding_whitening(spark, SF).toPandas()
    x = np.floor(256 * np.stack(emb.select("embedding").toPandas()["embedding"]).astype(float)).astype(int)
    ids = emb.select("vec_id").toPandas()["vec_id"].tolist()
    u, e, q = spectrum(x, 4)
    assert len(got) == 4 * len(ids) and set(got["n"]) == {len(u)}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(np.abs(wide) - np.abs((x - u.mean(0)) @ q / np.sqrt(e))).max() < 1e-9
    one = got[got["component"] == 1].set_index("vec_id").loc[ids]
    assert one["deviation"].tolist() == ((len(u) * x - u.sum(0)) ** 2).sum(1).tolist()
    share = got.groupby("component")["explained"].first().to_numpy()
    whole = u - u.mean(0)
    assert np.allclose(share, e / (whole**2).sum() * len(u), rtol=1e-10)
    assert got["identity_error"].max() < 1e-9


@pytest.mark.parametrize("seed", range(40))
def test_eigenpairs_of_odd_matrices(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 30))
    kind = seed % 5
    if kind == 0:
        a = rng.standard_normal((d, d))
        v = a @ a.T
    elif kind == 1:  # few different eigenvalues
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        v = (q * rng.integers(0, 3, d)) @ q.T
    elif kind == 2:  # already diagonal, with repeats
        v = np.diag(rng.integers(0, 4, d).astype(float))
    elif kind == 3:  # low rank
        a = rng.standard_normal((d, 2))
        v = a @ a.T
    else:  # close pairs
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        v = (q * (1 + np.arange(d) // 2 + 1e-9 * np.arange(d))) @ q.T
    v = (v + v.T) / 2
    values, rows = whitening.leading_components(v, 4)
    k = min(4, d)
    size = max(np.abs(v).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:k]).max() < 1e-13 * d * size + 1e-300
    assert np.abs(rows @ rows.T - np.eye(k)).max() < 1e-12
    assert np.abs(rows @ v - values[:, None] * rows).max() < 1e-12 * d * size + 1e-300


def test_sturm_counts():
    rng = np.random.default_rng(3)
    for _ in range(20):
        diag, off = rng.integers(-3, 4, 9).astype(float), rng.integers(-1, 2, 8).astype(float)
        e = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
        for x in rng.uniform(-6, 6, 10):
            assert whitening.below(diag, off, x) == (e < x).sum()


def test_whitening_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 0.1]), (1, [0.5, -0.25, 0.1]), (2, [0.125, 0.0, -0.0]), (None, [-1.0, 2.0, 0.3]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 0.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, [1.0]), (9, [-0.001]), (10, [0.25, 0.25, 0.25])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, x int, d int")
    got = whitening.whiten(df).toPandas()
    three = got[got["n"] == 4]
    assert sorted(three["vec_id"].dropna()) == sorted([1, 1, 2, 10] * 3) and three["vec_id"].isna().sum() == 3
    assert sorted(set(three["component"])) == [1, 2, 3] and three["identity_error"].max() < 1e-10
    one = got[got["n"] == 2]
    assert sorted(one["vec_id"]) == [8, 9] and set(one["component"]) == {1}
    assert sorted(one["whitened"].round(12)) == [-1.0, 1.0] and one["explained"].tolist() == [1.0, 1.0]
    assert set(one["deviation"]) == {257**2}
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.75, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["component"], round(r["explained"], 12), r["whitened"] is None) for r in flat) == [(1, 1.0, False)] * 2 + [(2, 0.0, True)] * 2
    big = whitening.whiten(spark.createDataFrame([("a", [3e7, 1.0]), ("b", [-2e7, 5e7])], "vec_id string, embedding array<double>")).collect()
    assert {int(r["deviation"]) for r in big} == {(256 * 5 * 10**7) ** 2 + (256 * (5 * 10**7 - 1)) ** 2}
    assert whitening.whiten(df.where("false")).count() == 0 and whitening.whiten(df.where("vec_id = 3")).count() == 0


def test_whitening_does_not_depend_on_partitions(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").limit(150)
    a, b = (whitening.whiten(emb.repartition(n)).toPandas().set_index(["vec_id", "component"]).sort_index() for n in (1, 7))
    assert np.abs(a["whitened"] - b["whitened"]).max() < 1e-9 and (a["deviation"] == b["deviation"]).all()


# ---- operator 12


def mixed(rows, weights=(5, 2, 1), limit=3, seed=12):
    """What the mix takes, scanned in order."""
    import hashlib
    import re

    size = Counter()
    by = defaultdict(list)
    for d, text, _, source, _ in rows:
        n = len(re.findall(mixing.WORD, text or ""))
        size[source] += n
        by[source].append((n, d))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), sum(size.values())
    while True:
        share = {s: w[s] * left / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= limit * size[s]]
        if not full:
            break
        for s in full:
            target[s] = float(limit * size[s])
            left -= limit * size[s]
            open_.remove(s)
        if not open_:
            share = {}
            break
    target |= share
    out = []
    for s, docs in by.items():
        docs.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        up, down = docs[0::2], docs[1::2][::-1]
        name = f"{seed}-" if s is None else f"{seed}+{s}"
        u = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52
        rate = target[s] / size[s] if size[s] else 0.0
        for i, (n, d) in enumerate(up + down):
            copies = int(rate * (i + 1) + u) - int(rate * i + u)
            out.append((d, n, size[s], target[s], n * min(copies, limit)))
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def test_mix_of_edge_rows(spark):
    m = mixing.mix(documents(spark, ROWS), keep=("doc_id", "text", "size", "part"))
    got = [(r["kept"]["doc_id"], r["size"], r["source_size"], r["target"], r["size"] * r["copies"]) for r in m.collect()]
    assert sorted(got, key=key) == sorted(mixed(ROWS), key=key)
    out = mixing.emitted(m)
    assert out.columns == ["doc_id", "text", "size", "part", "copy"]
    assert out.count() == m.agg(F.sum("copies")).first()[0]
    assert mixing.mix(documents(spark, [])).count() == 0
    blank = mixing.mix(documents(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in blank] == [(0, 0.0, 0)] * 2


def test_mix_query_equals_sql_and_comes_near_its_targets(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(mixing.mix_sql()).fetchall())
    for _ in range(2):
        got = sorted(tuple(r) for r in registry.op12_source_mixing(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect())
        assert got == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = mixing.mix(docs, keep=("doc_id",)).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("size").alias("most"), F.max("copies").alias("copies"))
    for r in m.collect():
        assert abs(r["taken"] - r["t"]) <= r["most"] and r["copies"] <= 3


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_water_levels(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i:02d}" if i else None, int(v)) for i, v in enumerate(rng.integers(0, 9, 12) ** 4)]
    got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    total = sum(v for _, v in rows)
    assert abs(sum(r["target"] for r in got.values()) - total) < 1e-6 * max(total, 1)
    assert all(r["target"] <= 3 * r["size"] + 1e-9 for r in got.values())
    level = {r["target"] / r["weight"] for r in got.values() if r["target"] < 3 * r["size"] - 1e-9}
    assert not level or max(level) - min(level) < 1e-9 * max(level)
    assert all(r["target"] / r["weight"] <= max(level) * (1 + 1e-9) for r in got.values() if level)


def test_a_hot_source_spans_partitions(spark):
    rows = [(None, "one two three", "en", "hot", 1)] * 900 + [(i, "four five", "en", f"s{i % 3}", 1) for i in range(300)]
    from waymesh.llm.ranks import placed

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        at, _ = placed(documents(spark, rows).select("source", "doc_id"), "source", [F.col("doc_id")])
        sizes = [r["count"] for r in at.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 450
    m = mixing.mix(documents(spark, rows))
    got = m.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("t")).collect()
    assert all(abs(r["taken"] - r["t"]) <= 3 for r in got) and m.count() == 1200


# ---- operator 13


def hashed(s):
    return sha256(s.encode()).hexdigest()


def proved(rows):
    def leaf(values):
        return hashed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([hashed("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    by = defaultdict(list)
    for d, text, lang, source, n in rows:
        own = leaf((d, source, lang, n, text))
        hit = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        by[lang].append((d, own, leaf((d, source, lang, n + 1, text)) if hit else own))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = levels([x[1] for x in by[lang]])
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for t, lang in enumerate(langs):
        for j, (d, own, node) in enumerate(by[lang]):
            proof = ""
            for tree, i in ((trees[lang], j), (top, t)):
                for level in tree[:-1]:
                    s = level[i ^ 1] if i ^ 1 < len(level) else ""
                    proof, node, i = proof + s, hashed(s + node if i & 1 else node + s), i >> 1
            out.append((d, own, trees[lang][-1][0], top[-1][0], hashed(proof), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("span", [1, 2, 10])
def test_manifest_of_edge_rows(spark, span):
    rows = ROWS + [(i, f"text {i}", "en" if i % 3 else "de", "s", i) for i in range(20, 57)]
    got = [tuple(r) for r in manifest.verified(documents(spark, rows), span=span).collect()]
    assert sorted(got, key=key) == sorted(proved(rows), key=key)


def test_small_manifests(spark):
    assert manifest.verified(documents(spark, [])).count() == 0
    for rows in (ROWS[:1], ROWS[:3], [(5, None, None, None, 9)]):
        assert sorted(tuple(r) for r in manifest.verified(documents(spark, rows)).collect()) == sorted(proved(rows))


def test_manifest_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(manifest.verified_sql()).fetchall())
    got = sorted(tuple(r) for r in registry.op13_dataset_manifest(spark, SF).collect())
    assert got == want and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [*range(1, 20), 31, 32, 33, 64, 100])
def test_postorder_positions(n):
    top = manifest.height(n)
    levels = [[hashed(str(i)) for i in range(n)]]
    while len(levels[-1]) > 1:
        levels.append([hashed("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    for more in (0, 2):  # an edge builder goes on to the level of its neighbours
        want = list(levels)
        for _ in range(more):
            want.append([hashed(want[-1][0])])
        log = manifest.append_log(levels[0], top + more)
        assert len(log) == sum(map(len, want))
        for level, nodes in enumerate(want):
            at = manifest.log_position(level, np.arange(len(nodes)), n).tolist()
            assert [log[p] for p in at] == nodes


def test_whole_logs_are_in_postorder(spark):
    rows = [(i, "t", "en" if i % 5 else "de", "s", i) for i in range(41)]
    m = manifest.manifest(documents(spark, rows), span=2)
    for _, g in m.trees.log().toPandas().groupby("tree"):
        g = g.sort_values("position")
        assert g["position"].tolist() == list(range(len(g)))
        at = {(r.level, r.i): (r.position, r.hash) for r in g.itertuples()}
        for (level, i), (p, h) in at.items():
            below = [at[level - 1, c] for c in (2 * i, 2 * i + 1) if (level - 1, c) in at]
            assert all(q < p for q, _ in below) and (not level or h == hashed("".join(x for _, x in below)))
