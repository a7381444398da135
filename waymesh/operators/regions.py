"""Groups cut into regions that one task can hold: adaptive cells, scans by region, labels and runs of whole small groups.

A group (an image) is usually small and is then one region, finished by one task
in one step. A larger one is cut up; what hangs on a border between regions goes
through rounds, and no task holds more than a region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.session import cut


def quad_cells(points: DataFrame, cell: float, most: int, g: str = "image_id", levels: int = 24) -> DataFrame:
    """points(g, ..., x, y) with _cell: the largest square of a quadtree that holds at most `most` of them.

    Squares of level k have 2 ** k times the side `cell`, the last one holds the
    group. One of side `cell` is kept however many it holds. Counts are summed
    before they are shuffled, and only those of cells that are kept or split go on.
    """
    ix, iy = F.floor(F.col("x") / cell).cast("long"), F.floor(F.col("y") / cell).cast("long")
    at = lambda k: F.when(k < levels, F.struct(k.cast("int").alias("k"), F.call_function("shiftright", ix, k).alias("cx"), F.call_function("shiftright", iy, k).alias("cy"))).otherwise(F.struct(F.lit(levels).alias("k"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")))
    every = points.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))
    counts = cut(every.groupBy(g, "_cell").agg(F.count("*").alias("n")))
    full = counts.where(F.col("n") > most).select(g, F.col("_cell").alias("_up"))
    up = F.when(F.col("_cell.k") < levels - 1, F.struct((F.col("_cell.k") + 1).alias("k"), F.shiftright("_cell.cx", 1).alias("cx"), F.shiftright("_cell.cy", 1).alias("cy"))).otherwise(F.struct(F.lit(levels).alias("k"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")))
    fits = counts.where((F.col("n") <= most) | (F.col("_cell.k") == 0)).withColumn("_up", up)
    top = fits.where(F.col("_cell.k") == levels).select(g, "_cell")
    leaves = top.union(fits.where(F.col("_cell.k") < levels).join(full, [g, "_up"], "left_semi").select(g, "_cell"))
    return every.join(leaves, [g, "_cell"], "left_semi")


def crowded_cells(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """(keys, na, nb) of the cells with more than `most` rows of left or right and some of both, or None; counted before they are shuffled."""
    one = left.groupBy(*keys).agg(F.count("*").alias("na"), F.lit(0).cast("long").alias("nb"))
    two = right.groupBy(*keys).agg(F.lit(0).cast("long").alias("na"), F.count("*").alias("nb"))
    both = one.union(two).groupBy(*keys).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    full = cut(both.where((F.greatest("na", "nb") > most) & (F.least("na", "nb") > 0)))
    return None if full.isEmpty() else full


def over_limit(rows: DataFrame, g: str, most: int) -> DataFrame | None:
    """(g, n) of groups with more than `most` rows, or None."""
    sizes = rows.groupBy(g).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return None if sizes.isEmpty() else cut(sizes)


def _name(c: str | Column, kind: T.DataType) -> Column:
    """A key as text."""
    col = F.col(c) if isinstance(c, str) else c
    return F.to_json(F.struct(col.alias("k"))) if isinstance(kind, T.StructType) else col.cast("string")


#: What a scan knows of a conflict's earlier item: it is to be decided in the region, it is open elsewhere, it is taken, it is dropped.
INSIDE, OPEN, TAKEN, DROPPED = 0, 1, 2, 3


def _scanned(rows: pd.DataFrame) -> pd.DataFrame:
    """Items b of one region's conflicts (a, b, known) and whether a scan takes them; null where that hangs on an open item."""
    codes, names = pd.factorize(pd.concat([rows["a"], rows["b"]], ignore_index=True))
    n = len(rows)
    a, b, known = codes[:n].tolist(), codes[n:].tolist(), rows["known"].tolist()
    taken: list[bool | None] = [None] * len(names)
    waits, lost, after = [0] * len(names), [False] * len(names), [[] for _ in names]
    later, shut = [False] * len(names), [False] * len(names)
    for p, q, k in zip(a, b, known, strict=True):
        later[q] = True
        if k == TAKEN:
            lost[q] = True
        elif k == OPEN:
            shut[q] = True
        elif k == INSIDE:
            waits[q] += 1
            after[p].append(q)
    outside = {p for p, k in zip(a, known, strict=True) if k != INSIDE}
    ready = [x for x in range(len(names)) if lost[x] or not waits[x] and not shut[x] and not (x in outside and not later[x])]
    while ready:
        x = ready.pop()
        if taken[x] is not None:
            continue
        taken[x] = not lost[x]
        for q in after[x]:
            waits[q] -= 1
            if taken[x] and not lost[q]:
                lost[q] = True
                ready.append(q)
            elif not waits[q] and not shut[q]:
                ready.append(q)
    at = [x for x in range(len(names)) if later[x]]
    return pd.DataFrame({"id": [names[x] for x in at], "taken": pd.array([taken[x] for x in at], "boolean")})


def scan(items: DataFrame, conflicts: DataFrame, g: str = "image_id", region: Callable[[Column], Column] | None = None, most: int = 200_000) -> DataFrame:
    """First-come-first-served selection: items(g, id) with taken.

    conflicts(g, a, b): a comes before b and they can't both be taken; a clash
    of an item with itself is none. A group with at most `most` conflicts is one
    region. Others are cut into regions of items, by `region` of an id (a place)
    or else by hash, each further by hash if it is still too large. A region's
    task decides every item that hangs on its own items alone, or on what is
    known of others; borders pass on what is known, and the rest goes round
    again. Conflicts that run in a circle are an error.
    """
    kind = items.schema["id"].dataType
    left = cut(conflicts.where("a <> b").select(F.col(g).alias("_g"), _name("a", kind).alias("a"), _name("b", kind).alias("b"), *([region(F.col("a")).alias("ra"), region(F.col("b")).alias("rb")] if region else [])).distinct())
    big = over_limit(left, "_g", most)
    name = _name("_g", left.schema["_g"].dataType)

    def decided(rows: DataFrame) -> DataFrame:
        """rows(key, region, a, b, known), key naming the group: (key, id, taken)."""

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            return _scanned(pdf).assign(key=pdf["key"].iloc[0])

        return rows.groupBy("key", "region").applyInPandas(one, "id string, taken boolean, key string")

    whole = left if big is None else left.join(big, "_g", "left_anti")
    got = decided(whole.select(name.alias("key"), F.lit(0).cast("long").alias("region"), "a", "b", F.lit(INSIDE).alias("known")))
    if big is not None:
        got = got.union(_rounds(left.join(big, "_g"), name, region is not None, most, decided))
    found = got.select("key", F.col("id").alias("_id"), "taken")
    every = items.select(g, "id").distinct().withColumns({"key": _name(g, items.schema[g].dataType), "_id": _name("id", kind)})
    return every.join(found, ["key", "_id"], "left").select(g, "id", F.coalesce("taken", F.lit(True)).alias("taken"))


def _rounds(left: DataFrame, name: Column, placed: bool, most: int, decided: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Decisions (id, taken, key) of the conflicts of large groups, region by region, border by border."""
    part = lambda c, r: F.xxhash64(r, F.pmod(F.xxhash64(c), F.ceil(F.col("m") / most))) if placed else F.pmod(F.xxhash64(c), F.ceil(F.col("m") * 2 / most))
    if placed:  # a place that holds too much is cut by hash
        dense = left.groupBy("_g", F.col("rb").alias("r")).agg(F.count("*").alias("m"))
        left = left.join(dense.withColumnRenamed("r", "rb"), ["_g", "rb"]).withColumn("pb", part("b", "rb")).drop("m")
        left = left.join(dense.withColumnRenamed("r", "ra"), ["_g", "ra"], "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("pa", part("a", "ra"))
    else:
        left = left.withColumn("m", F.col("n")).withColumns({"pa": part("a", None), "pb": part("b", None)})
    rows = left.select(name.alias("key"), "a", "b", "pa", F.col("pb").alias("region"))
    later = rows.select("key", F.col("b").alias("a"), F.lit(True).alias("later")).distinct()
    known = F.when(F.col("pa") == F.col("region"), INSIDE).when(F.col("later"), OPEN).otherwise(TAKEN)
    rows = cut(rows.join(later, ["key", "a"], "left").select("key", "region", "a", "b", known.alias("known")))
    done = None
    while not rows.isEmpty():
        out = cut(decided(rows))
        fresh = out.where("taken is not null").select("id", "taken", "key")
        if fresh.isEmpty():
            raise ValueError("conflicts run in a circle")
        done = fresh if done is None else done.union(fresh)
        rest = rows.join(fresh.select("key", F.col("id").alias("b")), ["key", "b"], "left_anti")
        rest = rest.join(fresh.select("key", F.col("id").alias("a"), "taken"), ["key", "a"], "left")
        # an open item keeps all its rows, so that its region goes on to tell of it
        told = F.when(F.col("taken").isNull(), F.col("known")).when(F.col("taken"), TAKEN).otherwise(DROPPED)
        rows = cut(rest.select("key", "region", "a", "b", told.alias("known")))
    return done


def _numbers(col: pa.Array) -> np.ndarray:
    """Whole numbers, or structs of them, as rows of a matrix that sort as they do."""
    if pa.types.is_struct(col.type):
        return np.column_stack([_numbers(c) for c in col.flatten()])
    return col.to_numpy(zero_copy_only=False).astype(np.int64)[:, None]


def begins(col: pa.Array) -> np.ndarray:
    """Whether a row of whole numbers, or structs of them, nulls included, differs from the one before."""

    def leaves(c: pa.Array) -> list[np.ndarray]:
        if pa.types.is_struct(c.type):
            return [x for f in c.flatten() for x in leaves(f)]
        return [c.is_null().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy(zero_copy_only=False)]

    new = np.ones(len(col), bool)
    if len(col):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in leaves(col)])
    return new


def close_pairs(ga: np.ndarray, ax: np.ndarray, ay: np.ndarray, gb: np.ndarray, bx: np.ndarray, by: np.ndarray, radius: float, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in a and b of points of one group at most radius apart, about `most` candidates at a time; groups are numbered from 0."""
    if not len(ga) or not len(gb):
        return
    # of cells in use and those around a's: neighbours keep neighbouring numbers, others may close up
    ca, cb = [np.floor(v / radius) for v in (ax, ay)], [np.floor(v / radius) for v in (bx, by)]
    used = [np.unique(np.concatenate([p - 1, p, p + 1, q])) for p, q in zip(ca, cb, strict=True)]
    nx, ny = (len(u) for u in used)
    place = lambda k, v: np.searchsorted(used[k], v)
    column = lambda g, v: g * nx + place(0, v)
    columns = np.unique(column(gb, cb[0]))
    key = np.searchsorted(columns, column(gb, cb[0])) * ny + place(1, cb[1])
    order = np.argsort(key, kind="stable")
    key = key[order]
    low, high = place(1, ca[1] - 1), place(1, ca[1] + 1)
    for step in (-1, 0, 1):
        c = column(ga, ca[0] + step)
        at = np.minimum(np.searchsorted(columns, c), len(columns) - 1)
        own = np.flatnonzero(columns[at] == c)
        lo = np.searchsorted(key, at[own] * ny + low[own], "left")
        n = np.searchsorted(key, at[own] * ny + high[own], "right") - lo
        own, lo, n = own[n > 0], lo[n > 0], n[n > 0]
        # runs of a's points whose candidates are some `most`
        part = np.cumsum(n) // most
        stops = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(n) else []
        for p, q in zip(stops[:-1], stops[1:], strict=True):
            k = n[p:q]
            i = np.repeat(own[p:q], k)
            j = order[np.repeat(lo[p:q] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())]
            near = np.sqrt((ax[i] - bx[j]) ** 2 + (ay[i] - by[j]) ** 2) <= radius
            if near.any():
                yield i[near], j[near]


def countable(kind: T.DataType) -> bool:
    """Whether _numbers can hold a type."""
    return isinstance(kind, T.IntegralType) or isinstance(kind, T.StructType) and all(countable(f.dataType) for f in kind)


def _indexed(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Both ends of links (a, b), where each different node stands first among them, and the ends as node numbers in order."""
    ends = pa.concat_arrays([t.column(c).combine_chunks() for c in ("a", "b")])
    _, first, code = np.unique(_numbers(ends), axis=0, return_index=True, return_inverse=True)
    code = code.reshape(-1)
    return ends, first, code[: len(t)], code[len(t) :]


def _taken(col: pa.Array, at: np.ndarray) -> pa.Array:
    return col.take(pa.array(at))


def labels(edges: DataFrame, g: str) -> DataFrame:
    """(g, node, component) of groups that a task can hold: the smallest node that each node reaches."""

    def one(t: pa.Table) -> pa.Table:
        ends, first, a, b = _indexed(t)
        low = np.arange(len(first))
        while True:
            m = np.minimum(low[a], low[b])
            new = low.copy()
            for side in (a, b):
                np.minimum.at(new, low[side], m)
                np.minimum.at(new, side, m)
            new = new[new]
            if (new == low).all():
                break
            low = new
        group = t.column(g).combine_chunks()
        return pa.table({g: _taken(group, np.zeros(len(first), np.int64)), "node": _taken(ends, first), "component": _taken(ends, first[low])})

    kinds = {c: edges.schema[c].dataType.simpleString() for c in (g, "a")}
    return edges.select(g, "a", "b").groupBy(g).applyInArrow(one, f"`{g}` {kinds[g]}, node {kinds['a']}, component {kinds['a']}")


def walked_runs(edges: DataFrame, g: str) -> DataFrame:
    """(g, chain, pos, a, b, n_edges, closed) of groups that a task can hold; as iterate.runs."""

    def one(t: pa.Table) -> pa.Table:
        ends, first, a, b = _indexed(t)
        near: list[list[int]] = [[] for _ in first]
        for p, q in sorted({(min(p, q), max(p, q)) for p, q in zip(a.tolist(), b.tolist(), strict=True) if p != q}):
            near[p].append(q)
            near[q].append(p)
        for x in near:
            x.sort()
        rows, walked = [], [False] * len(near)

        def follow(start: int, second: int) -> list[int]:
            run = [start, second]
            while len(near[run[-1]]) == 2 and run[-1] != start:
                p, q = near[run[-1]]
                run.append(q if p == run[-2] else p)
            return run

        def keep(run: list[int]) -> None:
            for x in run:
                walked[x] = True
            n, closed = len(run) - 1, run[0] == run[-1]
            rows.extend((run[0], run[1], i, run[i], run[i + 1], n, closed) for i in range(n))

        for start, around in enumerate(near):
            if around and len(around) != 2:
                for second in around:
                    run = follow(start, second)
                    # of the two ways through, the smaller first step counts
                    if (run[0], run[1]) <= (run[-1], run[-2]):
                        keep(run)
        for start, around in enumerate(near):
            if len(around) == 2 and not walked[start]:
                keep(follow(start, around[0]))
        c = np.array(rows, np.int64).reshape(-1, 7)
        node = lambda i: _taken(ends, first[c[:, i]])
        group = _taken(t.column(g).combine_chunks(), np.zeros(len(c), np.int64))
        return pa.table({g: group, "chain": pa.StructArray.from_arrays([node(0), node(1)], ["a", "b"]), "pos": pa.array(c[:, 2]), "a": node(3), "b": node(4), "n_edges": pa.array(c[:, 5]), "closed": pa.array(c[:, 6] == 1)})

    kinds = {c: edges.schema[c].dataType.simpleString() for c in (g, "a")}
    node = kinds["a"]
    return edges.select(g, "a", "b").groupBy(g).applyInArrow(one, f"`{g}` {kinds[g]}, chain struct<a:{node},b:{node}>, pos long, a {node}, b {node}, n_edges long, closed boolean")
