"""Loops over tables: greedy selection, components, chains, shortest paths, grid joins.

Groups (images) that one task can hold are finished by one task each, all of
them in one step. Larger ones go through rounds together; lineage is cut by
reliable checkpoints. No loop has a cap: each ends when nothing changes.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.operators import regions
from waymesh.session import cut

#: What a group's distances become: (idx, nodes, distances) to columns; and how groups that a task can't hold are searched: (edges, points) to rows.
Emit = Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, pa.Array]]
Rest = Callable[[DataFrame, DataFrame], DataFrame]
#: The columns of one table's rows of a group.
Side = dict[str, np.ndarray]


def fixpoint(df: DataFrame, step: Callable[[DataFrame], DataFrame], open_rows: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Apply step, each time on a checkpointed table, until open_rows(before, after) is empty."""
    df = cut(df)
    while True:
        after = cut(step(df))
        if open_rows(df, after).isEmpty():
            return after
        df = after


def ordered_greedy(items: DataFrame, conflicts: DataFrame, g: str = "image_id", region: Callable[[Column], Column] | None = None, most: int = 200_000) -> DataFrame:
    """First-come-first-served selection: items(g, id) with taken; conflicts(g, a, b): a comes before b and they can't both be taken.

    A group of at most `most` conflicts is scanned by one task at once, larger
    ones region by region; see regions.scan.
    """
    return regions.scan(items, conflicts, g, region, most)


def _split(edges: DataFrame, g: str, most: int, small: Callable[[DataFrame, str], DataFrame], large: Callable[[DataFrame, str], DataFrame], ready: bool = False) -> DataFrame:
    """small(edges, g) of groups of at most `most` edges, large(edges, g) of the others; ready: edges are a table, not a plan."""
    edges = edges if ready else cut(edges)
    if not regions.countable(edges.schema["a"].dataType):
        return large(edges, g)
    big = regions.over_limit(edges, g, most)
    if big is None:
        return small(edges, g)
    return small(edges.join(big, g, "left_anti"), g).union(large(edges.join(big, g, "left_semi"), g))


def components(edges: DataFrame, g: str = "image_id", most: int = 500_000, region: Callable[[Column], Column] | None = None) -> DataFrame:
    """(g, node, component) of edges(g, a, b): the smallest node that each node reaches; a self-link is a component.

    Groups of at most `most` edges are labelled by one task each. Larger ones go
    by star contraction: of all edges, or, where `region` gives a node's place,
    of the labels on borders alone, after each place has been labelled by a task.
    """

    def large(e: DataFrame, g: str) -> DataFrame:
        return _two_levels(e, g, region) if region is not None and regions.countable(e.schema["a"].dataType) else _contracted(e, g)

    return _split(edges.select(g, "a", "b"), g, most, regions.labels, large)


def _two_levels(edges: DataFrame, g: str, region: Callable[[Column], Column]) -> DataFrame:
    """Components by labels within places and contraction of the links between them."""
    e = edges.withColumns({"ra": region(F.col("a")), "rb": region(F.col("b"))})
    inside = e.where("ra = rb").select(F.struct(F.col(g).alias("g"), F.col("ra").alias("r")).alias("place"), "a", "b")
    local = regions.labels(inside, "place").select(F.col("place.g").alias(g), "node", F.col("component").alias("label"))
    across = e.where("ra <> rb").select(g, "a", "b")
    ends = across.select(g, F.col("a").alias("node")).union(across.select(g, "b")).distinct()
    local = cut(local.union(ends.join(local, [g, "node"], "left_anti").select(g, "node", F.col("node").alias("label"))))
    for c in ("a", "b"):
        across = across.join(local.withColumnRenamed("node", c), [g, c]).withColumn(c, F.col("label")).drop("label")
    whole = _contracted(across.select(g, "a", "b").distinct(), g).withColumnRenamed("node", "label")
    return local.join(whole, [g, "label"], "left").select(g, "node", F.coalesce("component", "label").alias("component"))


def _contracted(edges: DataFrame, g: str) -> DataFrame:
    """Components by alternating star contraction.

    Each round links every node's larger neighbours to its smallest one, then
    its smaller neighbours to that, until the edges are stars: log rounds, and a
    node of any degree is spread by its edges.
    """
    lone = edges.where("a = b").select(g, F.col("a").alias("node"), F.col("a").alias("component"))
    start = edges.where("a <> b").select(g, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def step(e: DataFrame) -> DataFrame:
        both = e.union(e.select(g, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(g, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, [g, "u"]).select(g, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(g, "u").agg(F.min("v").alias("m"))
        return large.join(least, [g, "u"]).select(g, F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def loose(_: DataFrame, e: DataFrame) -> DataFrame:
        """Nodes of two centres, and centres that have one."""
        several = e.groupBy(g, "u").agg(F.count("*").alias("n")).where("n > 1").select(g, "u")
        return several.union(e.select(g, F.col("v").alias("u")).distinct().join(e.select(g, "u"), [g, "u"], "left_semi"))

    e = fixpoint(start, step, loose)
    stars = e.select(g, F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(g, F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return stars.union(lone.join(stars.select(g, "node"), [g, "node"], "left_anti")).distinct()


def shortest_paths(edges: DataFrame, sources: DataFrame, g: str = "image_id", max_dist: float | None = None, max_hops: int | None = None, directed: bool = False, most: int = 500_000) -> DataFrame:
    """(g, source, node, dist) over edges(g, a, b, w) from sources(g, source[, node, dist]), to the end; w isn't negative.

    Groups of at most `most` edges whose nodes are whole numbers are searched by
    one task for some of their sources (`_reached`). Larger ones, and those with a number of hops,
    go through rounds, label-correcting: only nodes whose distance fell in a
    round go on, and only they are written; what is known is read for the
    comparison alone.
    """
    both = edges.select(g, "a", "b", "w")
    if not directed:
        both = both.union(edges.select(g, F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = cut(both.groupBy(g, "a", "b").agg(F.min("w").alias("w")))
    if "node" not in sources.columns:
        sources = sources.select(g, "source", F.col("source").alias("node"), F.lit(0).cast(edges.schema["w"].dataType).alias("dist"))
    first = sources.where(F.col("dist") <= max_dist) if max_dist is not None else sources
    first = first.groupBy(g, "source", "node").agg(F.min("dist").alias("dist"))
    if max_hops is None and all(isinstance(x.schema[c].dataType, T.IntegralType) for x, c in ((both, "a"), (both, "b"), (first, "node"))):
        first = cut(first)
        big = regions.over_limit(both, g, most)
        if big is None:
            return _reached(both, first, g, max_dist)
        got = _reached(both.join(big, g, "left_anti"), first.join(big, g, "left_anti"), g, max_dist)
        both, first = cut(both.join(big, g, "left_semi")), first.join(big, g, "left_semi")
        return got.union(_relaxed(both, first, g, max_dist, None))
    return _relaxed(both, first, g, max_dist, max_hops)


def _reached(both: DataFrame, first: DataFrame, g: str, max_dist: float | None, each: int = 256, blocks: int = 64) -> DataFrame:
    """shortest_paths of groups that a task can hold, from first(g, source, node, dist); a task searches from about `each` sources, unless they take more than `blocks` tasks."""
    kinds = {c: first.schema[c].dataType.simpleString() for c in (g, "source", "node", "dist")}
    seeds = first.groupBy(g, "source").agg(F.collect_list("node").alias("nodes"), F.collect_list("dist").alias("dists"))
    n = first.select(g, "source").distinct().groupBy(g).agg(F.least(F.ceil(F.count("*") / each), F.lit(blocks)).cast("int").alias("_n"))
    n = cut(n)
    seeds = seeds.join(n, g).withColumn("_part", F.pmod(F.xxhash64("source"), F.col("_n").cast("long")).cast("int")).drop("_n")
    e = both.where("a is not null and b is not null").join(n, g).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(g, "_part", "a", "b", "w")

    def search(es: pa.Table, ss: pa.Table) -> pa.Table:
        near: dict[int, list[tuple]] = {}
        if len(ss):
            for a, b, w in zip(es["a"].to_pylist(), es["b"].to_pylist(), es["w"].to_pylist(), strict=True):
                near.setdefault(a, []).append((b, w))
        at, node, dist = [], [], []
        for i, (nodes, dists) in enumerate(zip(ss["nodes"].to_pylist(), ss["dists"].to_pylist(), strict=True)):
            best: dict = {}
            heap = list(zip(dists, nodes, strict=True))
            heapq.heapify(heap)
            while heap:
                d, x = heapq.heappop(heap)
                if x not in best:
                    best[x] = d
                    for m, w in near.get(x, ()):
                        if m not in best and (max_dist is None or d + w <= max_dist):
                            heapq.heappush(heap, (d + w, m))
            at.extend([i] * len(best))
            node.extend(best)
            dist.extend(best.values())
        own = pa.array(at, pa.int64())
        kind = lambda c: ss.schema.field(c).type.value_type
        return pa.table({g: ss[g].take(own), "source": ss["source"].take(own), "node": pa.array(node, kind("nodes")), "dist": pa.array(dist, kind("dists"))})

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return e.groupBy(g, "_part").cogroup(seeds.groupBy(g, "_part")).applyInArrow(search, schema)


def _relaxed(both: DataFrame, first: DataFrame, g: str, max_dist: float | None, max_hops: int | None) -> DataFrame:
    """shortest_paths in rounds of joins."""
    best = front = cut(first)
    rounds = 0
    while max_hops is None or rounds < max_hops:
        step = front.withColumnRenamed("node", "a").join(both, [g, "a"]).select(g, "source", F.col("b").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        if max_dist is not None:
            step = step.where(F.col("dist") <= max_dist)
        step = step.groupBy(g, "source", "node").agg(F.min("dist").alias("dist")).alias("s")
        same = [F.col(f"s.{c}") == F.col(f"k.{c}") for c in (g, "source", "node")]
        front = cut(step.join(best.alias("k"), same[0] & same[1] & same[2] & (F.col("k.dist") <= F.col("s.dist")), "left_anti"))
        if front.isEmpty():
            break
        best = best.union(front)
        rounds += 1
        if rounds % 8 == 0:  # keep one row of each, and few partitions
            best = cut(best.groupBy(g, "source", "node").agg(F.min("dist").alias("dist")))
    return best.groupBy(g, "source", "node").agg(F.min("dist").alias("dist"))


def within_hops(edges: DataFrame, sources: DataFrame, hops: int, g: str = "image_id", most: int = 500_000) -> DataFrame:
    """(g, source, node), all longs: nodes at most `hops` edges (g, a, b), either way, from sources(g, source), itself among them.

    Groups of at most `most` edges are searched by one task each. In larger ones
    each of a few joins, with a link of every node to itself, widens the whole
    neighbourhood; they make one plan.
    """
    kind = dict(edges.dtypes)[g]
    e = edges.select(g, F.col("a").cast("long"), F.col("b").cast("long"))
    s = sources.select(g, F.col("source").cast("long")).distinct()
    big = regions.over_limit(e, g, most)

    def around(es: pd.DataFrame, ss: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(es["a"].tolist(), es["b"].tolist(), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        rows = []
        for x in ss["source"].tolist():
            seen = ring = {x}
            for _ in range(hops):
                ring = {m for n in ring for m in near.get(n, ())} - seen
                seen = seen | ring
            rows.extend((x, n) for n in seen)
        out = pd.DataFrame(rows, columns=["source", "node"], dtype="int64")
        return out.assign(_k=ss["_g"].iloc[0] if len(ss) else None)

    few_e, few_s = (e, s) if big is None else (e.join(big, g, "left_anti"), s.join(big, g, "left_anti"))
    got = few_e.groupBy(g).cogroup(few_s.withColumnRenamed(g, "_g").groupBy("_g")).applyInPandas(around, f"source long, node long, _k {kind}").select(F.col("_k").alias(g), "source", "node")
    if big is None:
        return got
    e, near = e.join(big, g, "left_semi"), s.join(big, g, "left_semi").withColumn("node", F.col("source"))
    steps = e.union(e.select(g, F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(g, "a").agg(F.collect_set("b").alias("next"))
    for _ in range(hops):
        wide = near.withColumnRenamed("node", "a").join(steps, [g, "a"], "left")
        near = wide.select(g, "source", F.explode(F.concat(F.array("a"), F.coalesce("next", F.array().cast("array<bigint>")))).alias("node")).distinct()
    return got.union(near)


def apart(items: DataFrame, links: DataFrame, hops: int, g: str = "image_id", most: int = 500_000) -> DataFrame:
    """(g, id): items(g, id, node, free, key) taken in order of id.

    An item counts if none of its key was taken and, unless it is free, no node
    taken is within `hops` links (g, a, b), either way, of its own. Groups of at
    most `most` links are scanned by one task each, which marks what lies around
    a node as it is taken; in larger ones all close pairs are a table of conflicts.
    """
    kind = dict(items.dtypes)[g]
    x = items.select(g, F.col("id").cast("long"), F.col("node").cast("long"), "free", F.to_json(F.struct("key")).alias("key"))
    big = regions.over_limit(links, g, most)

    def one(es: pa.Table, xs: pa.Table) -> pa.Table:
        near: dict[int, list[int]] = {}
        for a, b in zip(es["a"].to_pylist(), es["b"].to_pylist(), strict=True) if len(xs) else ():
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        shut, keys, taken = set(), set(), []
        rows = zip(*(xs[c].to_pylist() for c in ("id", "node", "free", "key")), strict=True)
        for i, n, free, key in sorted(rows, key=lambda r: r[0]):
            if key in keys or n in shut and not free:
                continue
            keys.add(key)
            taken.append(i)
            seen = ring = {n}
            for _ in range(hops):
                ring = {m for k in ring for m in near.get(k, ())} - seen
                seen = seen | ring
            shut |= seen
        group = xs["_g"].take(pa.array(np.zeros(len(taken), np.int64))) if taken else xs["_g"].slice(0, 0)
        return pa.table({g: group, "id": pa.array(taken, pa.int64())})

    few_e, few_x = (links, x) if big is None else (links.join(big, g, "left_anti"), x.join(big, g, "left_anti"))
    few_x = few_x.where(F.col(g).isNotNull()).withColumnRenamed(g, "_g")
    got = few_e.select(g, F.col("a").cast("long"), F.col("b").cast("long")).groupBy(g).cogroup(few_x.groupBy("_g")).applyInArrow(one, f"`{g}` {kind}, id long")
    if big is None:
        return got
    e, x = links.join(big.select(g), g, "left_semi"), cut(x.join(big.select(g), g, "left_semi"))
    reach = within_hops(e, x.select(g, F.col("node").alias("source")), hops, g, most)
    close = reach.join(x.select(g, F.col("node").alias("source"), F.col("id").alias("a")), [g, "source"]).join(x.select(g, "node", F.col("id").alias("b"), "free"), [g, "node"]).where("a < b and not free").select(g, "a", "b")
    same = x.select(g, "key", F.col("id").alias("a")).join(x.select(g, "key", F.col("id").alias("b")), [g, "key"]).where("a < b").select(g, "a", "b")
    return got.union(ordered_greedy(x.select(g, "id"), close.union(same), g).where("taken").select(g, "id"))


def grid_join(a: DataFrame, b: DataFrame, radius: float, g: str = "image_id", most: int = 20_000) -> DataFrame:
    """Pairs of a(g, ida, ax, ay) and b(g, idb, bx, by) at most radius apart, with dist.

    Groups of at most `most` rows of a and of b are joined where they lie
    (`_meeting`): each row is shuffled once. Larger ones go through cells.
    """
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    if not regions.countable(a.schema[g].dataType):
        return _by_cells(a, b, radius, g, most).withColumn("dist", d).where(F.col("dist") <= radius)
    big = regions.crowded_cells(a, b, [g], most)
    if big is None:
        pairs = _meeting(a, b, radius, g)
    else:
        big = big.select(g)
        pairs = _by_cells(a.join(big, g, "left_semi"), b.join(big, g, "left_semi"), radius, g, most)
        pairs = pairs.unionByName(_meeting(a.join(big, g, "left_anti"), b.join(big, g, "left_anti"), radius, g))
    return pairs.withColumn("dist", d).where(F.col("dist") <= radius)


def whole_groups(batches: Iterator[pa.RecordBatch], g: str, at_once: int) -> Iterator[pa.Table]:
    """Rows in order of g as tables of whole groups, some `at_once` rows or one group each."""
    held, n = [], 0
    for t in batches:
        held.append(t)
        n += len(t)
        if n >= at_once:
            whole = pa.Table.from_batches(held)
            last = int(np.flatnonzero(regions.begins(whole.column(g).combine_chunks()))[-1])
            if last:  # the last group may go on
                yield whole.slice(0, last)
                held, n = whole.slice(last).to_batches(), n - last
    if n:
        yield pa.Table.from_batches(held)


def by_group(sides: list[DataFrame], work: Callable[[list[Side]], Iterator[dict[str, np.ndarray]]], schema: str, rows: int, g: str = "image_id", at_once: int = 50_000) -> DataFrame:
    """(g, schema): what work gives for the rows of every group of all sides, as arrays; a task has some `rows` rows of the last side, and holds a group or `at_once` rows at a time."""
    inner = [[c for c in s.columns if c != g] for s in sides]
    kinds = [", ".join(f"`{c}`:{s.schema[c].dataType.simpleString()}" for c in cols) for s, cols in zip(sides, inner, strict=True)]
    both = None
    for k, (s, cols) in enumerate(zip(sides, inner, strict=True)):
        part = s.select(g, *(F.struct(*cols).alias(f"_{i}") if i == k else F.lit(None).cast(f"struct<{kinds[i]}>").alias(f"_{i}") for i in range(len(sides))))
        both = part if both is None else both.union(part)
    n = max(-(-sides[-1].count() // rows), both.sparkSession.sparkContext.defaultParallelism)
    both = both.where(F.col(g).isNotNull()).repartition(n, F.struct(g)).sortWithinPartitions(g)
    kind = sides[0].schema[g].dataType.simpleString()
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, g, at_once):
            groups = t.column(g).combine_chunks()
            whole = [t.column(f"_{k}").combine_chunks() for k in range(len(inner))]
            stops = [*np.flatnonzero(regions.begins(groups)).tolist(), len(t)]
            for p, q in zip(stops[:-1], stops[1:], strict=True):
                tables = []
                for c, cols in zip(whole, inner, strict=True):
                    x = c.slice(p, q - p)
                    x = x.filter(x.is_valid())
                    tables.append({n: x.field(n).to_numpy(zero_copy_only=False) for n in cols})
                if not len(tables[-1][inner[-1][0]]):
                    continue
                for out in work(tables):
                    k = len(out[names[0]])
                    if k:
                        yield pa.RecordBatch.from_arrays([groups.take(pa.array(np.full(k, p))), *(pa.array(out[c]) for c in names)], [g, *names])

    return both.mapInArrow(run, f"`{g}` {kind}, {schema}")


def _meeting(a: DataFrame, b: DataFrame, radius: float, g: str, at_once: int = 100_000) -> DataFrame:
    """Pairs of rows of a and b within radius, of groups that a task can hold.

    Both sides stand together, group by group in order; a task reads some
    `at_once` rows of whole groups, sorts b's by cell and looks up the three by
    three cells around each of a's.
    """
    mine, theirs = [c for c in a.columns if c != g], [c for c in b.columns if c != g]
    kinds = {c: t.schema[c].dataType.simpleString() for t, cols in ((a, [g, *mine]), (b, theirs)) for c in cols}
    row = lambda cols: "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in cols) + ">"
    none = lambda cols: F.lit(None).cast(row(cols))
    both = a.select(g, F.struct(*mine).alias("_a"), none(theirs).alias("_b")).union(b.select(g, none(mine), F.struct(*theirs)))
    # by a struct, which neither side can be dealt by already: a shuffle dropped here would lose pairs (session.trust_no_unions)
    both = both.where(F.col(g).isNotNull()).repartition(F.struct(g)).sortWithinPartitions(g)

    def joined(t: pa.Table) -> Iterator[pa.RecordBatch]:
        groups, side = t.column(g).combine_chunks(), {c: t.column(c).combine_chunks() for c in ("_a", "_b")}
        code = np.cumsum(regions.begins(groups)) - 1
        at, x, y = {}, {}, {}
        for c, cx, cy in (("_a", "ax", "ay"), ("_b", "bx", "by")):
            place = [side[c].field(v).to_numpy(zero_copy_only=False).astype(np.float64) for v in (cx, cy)]
            ok = side[c].is_valid().to_numpy(zero_copy_only=False) & np.isfinite(place[0]) & np.isfinite(place[1])
            at[c] = np.flatnonzero(ok)
            x[c], y[c] = place[0][ok], place[1][ok]
        for i, j in regions.close_pairs(code[at["_a"]], x["_a"], y["_a"], code[at["_b"]], x["_b"], y["_b"], radius):
            p, q = pa.array(at["_a"][i]), pa.array(at["_b"][j])
            yield pa.RecordBatch.from_arrays([groups.take(p), *(side["_a"].field(c).take(p) for c in mine), *(side["_b"].field(c).take(q) for c in theirs)], [g, *mine, *theirs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, g, at_once):
            yield from joined(t)

    return both.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (g, *mine, *theirs)))


def _by_cells(a: DataFrame, b: DataFrame, radius: float, g: str, most: int) -> DataFrame:
    """Pairs of rows of a and b in one cell of size radius or in neighbouring ones.

    b's rows go to their cell of that size and the eight around it, a's to
    their own, so no cell meets all others. A cell with more than `most` rows of
    a or b is split on (`_crowded`), so that no key joins more than about `most`
    rows of either side, but for rows of b that repeat one id and place.
    """
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    left = a.select("*", F.floor(F.col("ax") / radius).alias("cx"), F.floor(F.col("ay") / radius).alias("cy"))
    right = b.select("*", F.explode(near).alias("ox")).select("*", F.explode(near).alias("oy"))
    right = right.select(*b.columns, (F.floor(F.col("bx") / radius) + F.col("ox")).alias("cx"), (F.floor(F.col("by") / radius) + F.col("oy")).alias("cy"))
    keys = [g, "cx", "cy"]
    full = regions.crowded_cells(left, right, keys, most)
    if full is None:
        return left.join(right, keys).drop("cx", "cy")
    rest = left.join(full, keys, "left_anti").join(right, keys).drop("cx", "cy")
    return rest.unionByName(_crowded(left, right, full, radius, keys, most))


def _crowded(left: DataFrame, right: DataFrame, full: DataFrame, radius: float, keys: list[str], most: int, depth: int = 6) -> DataFrame:
    """Rows of left and right in the cells full(keys, na, nb) that can be within radius, each pair once.

    A cell's rows of left go to the leaves of a quadtree of 2 ** depth squares a
    side, rows of right to every leaf within radius of them. Where a smallest
    square still holds more than `most`, or right's rows do, they are dealt into
    parts by a hash, and the other side's rows go to every part.
    """
    least = radius / 2**depth
    split = full.select(*keys, F.ceil(F.greatest("nb", F.lit(1)) / most).cast("int").alias("_nb"))
    inside = lambda v, c: F.greatest(F.lit(0.0), F.least(F.col(v) - F.col(c) * radius, F.lit(radius - least / 2)))
    base = F.struct(*keys).alias("_base")
    own = [c for c in left.columns if c not in keys]
    p = left.join(split, keys).select(base, F.struct(*own).alias("_a"), "_nb", inside("ax", "cx").alias("x"), inside("ay", "cy").alias("y"))
    p = regions.quad_cells(p, least, most, "_base", depth).drop("x", "y")
    leaves = cut(p.groupBy("_base", "_cell", "_nb").agg(F.ceil(F.count("*") / most).cast("int").alias("_na")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n).cast("long")).cast("int")
    p = p.join(leaves.drop("_nb"), ["_base", "_cell"]).select("_base", "_cell", "_a", part("_na", "_a.ida", "_a.ax", "_a.ay").alias("_pa"), every("_nb").alias("_pb"))
    theirs = [c for c in right.columns if c not in keys]
    q = right.join(split, keys).select(base, F.struct(*theirs).alias("_b"), part("_nb", "idb", "bx", "by").alias("_pb"))
    # the leaves too are dealt into right's parts, so that no key holds all of a cell's rows
    q = q.join(leaves.select("_base", "_cell", "_na", every("_nb").alias("_pb")), ["_base", "_pb"])
    side = least * F.pow(F.lit(2.0), F.col("_cell.k"))
    gap = lambda v, c: F.greatest(F.col(f"_base.{c}") * radius + F.col(f"_cell.{c}") * side - F.col(v), F.col(v) - F.col(f"_base.{c}") * radius - (F.col(f"_cell.{c}") + 1) * side, F.lit(0.0))
    slack = 1e-9 * radius + 1e-12 * (F.abs("_b.bx") + F.abs("_b.by"))
    reach = F.sqrt(gap("_b.bx", "cx") ** 2 + gap("_b.by", "cy") ** 2) <= radius + slack
    q = q.where(reach).select("_base", "_cell", "_b", "_pb", every("_na").alias("_pa"))
    return p.join(q, ["_base", "_cell", "_pa", "_pb"]).select(f"_base.{keys[0]}", "_a.*", "_b.*")


def box_cells(cell: float, left: Column, low: Column, right: Column, high: Column) -> Column:
    """Array of the grid cells (cx, cy) that a box touches."""
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    return F.flatten(F.transform(span(left, right), lambda i: F.transform(span(low, high), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def box_join(a: DataFrame, b: DataFrame, cell: float, g: str = "image_id") -> DataFrame:
    """Pairs of a(g, ..., al, ab, ar, at) and b(g, ..., bl, bb, br, bt) whose boxes (left, low, right, high) touch, each once, through grid cells."""
    p = a.withColumn("_c", F.explode(box_cells(cell, F.col("al"), F.col("ab"), F.col("ar"), F.col("at"))))
    q = b.withColumn("_c", F.explode(box_cells(cell, F.col("bl"), F.col("bb"), F.col("br"), F.col("bt"))))
    j = p.join(q, [g, "_c"]).where("al <= br and bl <= ar and ab <= bt and bb <= at")
    # of the cells that both touch, the one with the lowest corner of the overlap counts
    first = (F.col("_c.cx") == F.floor(F.greatest("al", "bl") / cell)) & (F.col("_c.cy") == F.floor(F.greatest("ab", "bb") / cell))
    return j.where(first).drop("_c")


def _doubled(half: DataFrame, g: str) -> DataFrame:
    """half(g, a, b, na, nb) with ja, jb, d: the last half-edge that each leads to and how many steps on; rows of rings are left open.

    Pointer doubling: as long as a run that ends has open rows, some close in
    every round, so rows that stay open are rings.
    """
    start = F.col("na").isNull()
    state = cut(half.select(g, "a", "b", "na", "nb", F.coalesce("na", "a").alias("ja"), F.coalesce("nb", "b").alias("jb"), F.when(start, 0).otherwise(1).cast("long").alias("d"), (~start).alias("open")))
    n = -1
    while True:
        had, n = n, state.where("open").count()
        if n in (0, had):
            return state
        far = state.select(g, F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("ja").alias("ka"), F.col("jb").alias("kb"), F.col("d").alias("e"), F.col("open").alias("more"))
        moved = state.where("open").join(far, [g, "ja", "jb"]).select(g, "a", "b", "na", "nb", F.col("ka").alias("ja"), F.col("kb").alias("jb"), (F.col("d") + F.col("e")).alias("d"), F.col("more").alias("open"))
        state = cut(state.where("not open").union(moved))


def _half_edges(edges: DataFrame, g: str) -> DataFrame:
    """(g, a, b, na, nb) both ways of every edge, with what follows where b has two neighbours, and whether a has (mid)."""
    und = edges.select(g, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    both = und.union(und.select(g, F.col("b").alias("a"), F.col("a").alias("b")))
    two = both.groupBy(g, F.col("a").alias("n")).agg(F.count("*").alias("c"), F.min("b").alias("lo"), F.max("b").alias("hi")).where("c = 2").drop("c")
    h = both.join(two.withColumnRenamed("n", "b"), [g, "b"], "left").select(g, "a", "b", F.when(F.col("lo").isNotNull(), F.col("b")).alias("na"), F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("nb"))
    return h.join(two.select(g, F.col("n").alias("a"), F.lit(True).alias("mid")), [g, "a"], "left").select(g, "a", "b", "na", "nb", F.coalesce("mid", F.lit(False)).alias("mid"))


def runs(edges: DataFrame, g: str = "image_id", most: int = 500_000, ready: bool = False) -> DataFrame:
    """(g, chain, pos, a, b, n_edges, closed): the edges of every maximal run through nodes of degree 2, in order.

    A run starts at its smaller end, a loop at its junction (a ring at its
    smallest node) towards the smaller neighbour; chain is its first half-edge.
    Groups of at most `most` edges are walked by one task each, larger ones go
    by pointer doubling.
    """
    return _split(edges.select(g, "a", "b"), g, most, regions.walked_runs, _doubled_runs, ready)


def _doubled_runs(edges: DataFrame, g: str) -> DataFrame:
    half = cut(_half_edges(edges, g))
    state = _doubled(half.drop("mid"), g)
    closed = state.where("not open").select(g, "a", "b", "ja", "jb", "d")
    ring = state.where("open").select(g, "a", "b", "na", "nb")
    if not ring.isEmpty():
        low = _contracted(ring.select(g, "a", "b"), g).where("node = component").select(g, F.col("node").alias("b"), F.lit(True).alias("cut"))
        opened = ring.join(low, [g, "b"], "left").select(g, "a", "b", F.when(F.col("cut").isNull(), F.col("na")).alias("na"), F.when(F.col("cut").isNull(), F.col("nb")).alias("nb"))
        closed = closed.union(_doubled(opened, g).select(g, "a", "b", "ja", "jb", "d"))
        heads = half.where("not mid").select(g, "a", "b").union(ring.join(low.select(g, F.col("b").alias("a")), [g, "a"], "left_semi").select(g, "a", "b"))
    else:
        heads = half.where("not mid").select(g, "a", "b")
    closed = cut(closed)
    # a run's first half-edge names it; of the two ways through, the smaller first half-edge counts
    first = closed.join(heads, [g, "a", "b"], "left_semi").where(F.struct("a", "b") <= F.struct(F.col("jb").alias("a"), F.col("ja").alias("b")))
    first = first.select(g, F.struct("a", "b").alias("chain"), "ja", "jb", F.col("d").alias("last"), (F.col("a") == F.col("jb")).alias("closed"))
    return closed.join(first, [g, "ja", "jb"]).select(g, "chain", (F.col("last") - F.col("d")).alias("pos"), "a", "b", (F.col("last") + 1).alias("n_edges"), "closed")


def chains(edges: DataFrame, g: str = "image_id") -> DataFrame:
    """(g, a, b, chain): every undirected edge with its maximal run through nodes of degree 2.

    Two edges that meet in a node of degree 2 belong to one run; chain is the
    run's smallest edge. A ring is a run of its own.
    """
    r = runs(edges, g).select(g, F.col("chain").alias("run"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    low = r.groupBy(g, "run").agg(F.min(F.struct("a", "b")).alias("chain"))
    return r.join(low, [g, "run"]).select(g, "a", "b", "chain")


def chain_positions(edges: DataFrame, g: str = "image_id") -> DataFrame:
    """(g, chain, pos, node, n_edges, closed): the nodes of every run in order; a closed run ends where it starts."""
    r = runs(edges, g)
    last = r.where("pos = n_edges - 1").select(g, "chain", F.col("n_edges").alias("pos"), F.col("b").alias("node"), "n_edges", "closed")
    return r.select(g, "chain", "pos", F.col("a").alias("node"), "n_edges", "closed").union(last)


def degree(edges: DataFrame, g: str = "image_id") -> DataFrame:
    """(g, node, degree) counting different neighbours other than the node itself."""
    both = edges.select(g, F.col("a").alias("node"), F.col("b").alias("n")).union(edges.select(g, F.col("b").alias("node"), F.col("a").alias("n")))
    return both.where("node <> n").groupBy(g, "node").agg(F.count_distinct("n").cast("int").alias("degree"))


def quotient(edges: DataFrame, mapping: DataFrame, g: str = "image_id") -> DataFrame:
    """edges(g, a, b) with ends replaced by mapping(g, old, new); self-loops go, repeats merge."""
    for c in ("a", "b"):
        edges = edges.join(mapping.select(g, F.col("old").alias(c), F.col("new").alias("_n")), [g, c], "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    return edges.where("a <> b").select(g, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _nearest(near: dict[int, list[tuple[int, int]]], source: int, targets: set[int]) -> dict[int, int]:
    """Distances from a source until all targets that it reaches are settled."""
    best, heap, left = {}, [(0, source)], set(targets)
    while heap and left:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            left.discard(n)
            for m, w in near.get(n, ()):
                if m not in best:
                    heapq.heappush(heap, (d + w, m))
    return best


def _links_of(es: pd.DataFrame) -> dict[int, list[tuple[int, int]]]:
    near: dict[int, list[tuple[int, int]]] = {}
    for a, b, w in zip(es["a"].tolist(), es["b"].tolist(), es["w"].tolist(), strict=True):
        near.setdefault(a, []).append((b, w))
    return near


def overlay(edges: DataFrame, pairs: DataFrame, places: DataFrame, cell: float, most: int, g: str = "image_id") -> DataFrame:
    """edges(g, a, b, w) between the ends of pairs(g, source, node) and nodes on borders of cells alone, with the same distances between them.

    The graph is cut into cells of at most `most` edges by places(g, node, x, y)
    of nodes. One task a cell searches from its sources and border nodes to its
    targets and border nodes, along edges inside; edges across stay.
    """
    spots = edges.select(g, F.col("a").alias("node")).join(places.select(g, "node", "x", "y"), [g, "node"])
    cells = cut(regions.quad_cells(spots, cell, most, g).select(g, "node", F.xxhash64("_cell").alias("cell")).distinct())
    every = pairs.select(g, F.col("source").alias("node")).union(pairs.select(g, "node")).union(edges.select(g, F.col("b").alias("node"))).distinct()
    # a node that no edge leaves is a cell of its own
    alone = every.join(cells, [g, "node"], "left_anti").select(g, "node", F.xxhash64("node", F.lit("alone")).alias("cell"))
    cells = cut(cells.union(alone))
    named = edges.join(cells.toDF(g, "a", "ca"), [g, "a"]).join(cells.toDF(g, "b", "cb"), [g, "b"])
    named = cut(named.select(g, "a", "b", "w", "ca", "cb"))
    across = named.where("ca <> cb")
    out = across.select(g, F.col("a").alias("node"), F.lit(False).alias("enters")).union(pairs.select(g, "node", F.lit(False)))
    into = across.select(g, F.col("b").alias("node"), F.lit(True).alias("enters")).union(pairs.select(g, F.col("source"), F.lit(True)))
    ends = out.union(into).join(cells, [g, "node"]).groupBy(g, "cell", "node").agg(F.max("enters").alias("enters"), F.min("enters").alias("only"))
    ends = ends.select(F.col(g).alias("_g"), "cell", "node", "enters", (~F.col("only")).alias("leaves"))

    def search(es: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        near, rows = _links_of(es), []
        to = set(ts.loc[ts["leaves"], "node"].tolist())
        for s in ts.loc[ts["enters"], "node"].tolist():
            best = _nearest(near, s, to)
            rows.extend((s, t, best[t]) for t in to if t != s and t in best)
        return pd.DataFrame(rows, columns=["a", "b", "w"], dtype="int64").assign(_k=ts["_g"].iloc[0] if len(ts) else es[g].iloc[0])

    kind = dict(edges.dtypes)[g]
    inner = named.where("ca = cb").select(g, F.col("ca").alias("cell"), "a", "b", "w")
    inside = inner.groupBy(g, "cell").cogroup(ends.groupBy("_g", "cell")).applyInPandas(search, f"a long, b long, w long, _k {kind}").select(F.col("_k").alias(g), "a", "b", "w")
    return cut(inside.union(across.select(g, "a", "b", "w")))


def paths_by_group(edges: DataFrame, pairs: DataFrame, g: str = "image_id", blocks: int = 8, most: int = 500_000, places: DataFrame | None = None, cell: float = 1.0, per_cell: int = 50_000) -> DataFrame:
    """(g, source, node, dist) of pairs(g, source, node) that edges(g, a, b, w) connect; all longs, edges directed.

    A group of at most `most` edges is searched by `blocks` tasks, each from its
    own sources and only until their targets are settled. A larger group with
    places(g, node, x, y) of its nodes is searched in its overlay of cells of
    `per_cell` edges; without, or if the overlay is as large, in rounds of joins.
    """
    want = pairs.select(g, F.col("source").cast("long"), F.col("node").cast("long")).distinct()
    e = edges.select(g, F.col("a").cast("long"), F.col("b").cast("long"), F.col("w").cast("long"))
    big = regions.over_limit(e, g, most)
    small_e, small_w = (e, want) if big is None else (e.join(big, g, "left_anti"), want.join(big, g, "left_anti"))
    out = _searched(small_e, small_w, g, blocks)
    if big is None:
        return out
    e, want = cut(e.join(big.select(g), g, "left_semi")), cut(want.join(big.select(g), g, "left_semi"))
    if places is not None:
        e = overlay(e, want, places.select(g, F.col("node").cast("long"), "x", "y"), cell, per_cell, g)
        left = regions.over_limit(e, g, most)
        fits = e if left is None else e.join(left, g, "left_anti")
        out = out.union(_searched(fits, want if left is None else want.join(left, g, "left_anti"), g, blocks))
        if left is None:
            return out
        e, want = e.join(left, g, "left_semi"), want.join(left, g, "left_semi")
    far = shortest_paths(e, want.select(g, "source").distinct(), g, directed=True, most=most)
    return out.union(far.join(want, [g, "source", "node"], "left_semi").select(g, "source", "node", "dist"))


def _searched(edges: DataFrame, want: DataFrame, g: str, blocks: int) -> DataFrame:
    """paths_by_group of groups that a task can hold."""
    kind = dict(edges.dtypes)[g]
    part = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    s = want.groupBy(g, "source").agg(F.collect_list("node").alias("nodes")).withColumn("part", F.pmod(F.col("source"), F.lit(blocks)).cast("int")).toDF("_g", "source", "nodes", "part")

    def search(es: pd.DataFrame, ss: pd.DataFrame) -> pd.DataFrame:
        near, rows = _links_of(es) if len(ss) else {}, []
        for src, nodes in zip(ss["source"].tolist(), ss["nodes"], strict=True):
            best = _nearest(near, src, set(nodes.tolist()))
            rows.extend((ss["_g"].iloc[0], src, n, best[n]) for n in set(nodes.tolist()) if n in best)
        return pd.DataFrame(rows, columns=[g, "source", "node", "dist"])

    return edges.withColumn("part", part).groupBy(g, "part").cogroup(s.groupBy("_g", "part")).applyInPandas(search, f"{g} {kind}, source long, node long, dist long")


def distance_rows(edges: DataFrame, points: DataFrame, g: str = "image_id", blocks: int = 8, most: int = 500_000, places: DataFrame | None = None, cell: float = 1.0, per_cell: int = 50_000) -> DataFrame:
    """(g, idx, dists): for every one of points(g, idx, node), numbered from 0 in its group, its distances to all of them in order, -1 without a way.

    One row a point instead of one a pair. Searched as by paths_by_group.
    """
    e = edges.select(g, F.col("a").cast("long"), F.col("b").cast("long"), F.col("w").cast("long"))
    p = points.select(g, F.col("idx").cast("long"), F.col("node").cast("long"))
    big = regions.over_limit(e, g, most)
    kind = dict(edges.dtypes)[g]
    part = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    small_e, small_p = (e, p) if big is None else (e.join(big, g, "left_anti"), p.join(big, g, "left_anti"))
    s = small_p.groupBy(g).agg(F.array_sort(F.collect_list(F.struct("idx", "node")))["node"].alias("nodes")).withColumn("part", part).toDF("_g", "nodes", "part")

    def search(es: pd.DataFrame, ss: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(ss):
            near, k, nodes = _links_of(es), int(ss["part"].iloc[0]), ss["nodes"].iloc[0].tolist()
            for i in range(k, len(nodes), blocks):
                best = _nearest(near, nodes[i], set(nodes))
                rows.append((ss["_g"].iloc[0], i, [best.get(n, -1) for n in nodes]))
        return pd.DataFrame(rows, columns=[g, "idx", "dists"])

    schema = f"{g} {kind}, idx long, dists array<long>"
    out = small_e.withColumn("part", part).groupBy(g, "part").cogroup(s.groupBy("_g", "part")).applyInPandas(search, schema)
    if big is None:
        return out
    p = cut(p.join(big.select(g), g, "left_semi"))
    pairs = p.select(g, F.col("idx").alias("i"), F.col("node").alias("source")).join(p.select(g, F.col("idx").alias("j"), "node"), g)
    got = paths_by_group(e.join(big.select(g), g, "left_semi"), pairs, g, blocks, most, places, cell, per_cell)
    far = pairs.join(got, [g, "source", "node"], "left").groupBy(g, F.col("i").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("j", F.coalesce("dist", F.lit(-1)).alias("d"))))["d"].alias("dists"))
    return out.union(far)


def as_rows(idx: np.ndarray, nodes: np.ndarray, dist: np.ndarray) -> dict[str, pa.Array]:
    """A row a point with its distances to all points in order."""
    k = len(idx)
    return {"idx": pa.array(idx), "dists": pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * k), pa.array(dist.reshape(-1)))}


def as_pairs(idx: np.ndarray, nodes: np.ndarray, dist: np.ndarray) -> dict[str, pa.Array]:
    """A row for every two points, in order."""
    i, j = np.triu_indices(len(idx), 1)
    return {"source": pa.array(nodes[i]), "node": pa.array(nodes[j]), "dist": pa.array(dist[i, j])}


def two_of(points: DataFrame, g: str = "image_id") -> DataFrame:
    """(g, source, node): every two of points(g, node), source < node."""
    p = points.select(g, "node")
    return p.withColumnRenamed("node", "source").join(p, g).where("source < node")


def searched_whole(edges: DataFrame, points: DataFrame, near: Callable[[pa.Table, np.ndarray], dict], schema: str, emit: Emit, rest: Rest, g: str, most: int, many: int) -> DataFrame:
    """emit(idx, nodes, distances, -1 without a way) of points(g, idx, node), in order of idx, of every group with at most `most` edges and `many` points, by one task.

    near(edges, nodes): the links (b, w) of each node that is searched. Other
    groups are rest(edges, points). Groups without points give no rows.
    """
    a, b = edges.groupBy(g).agg(F.count("*").alias("n")).where(F.col("n") > most), points.groupBy(g).agg(F.count("*").alias("n")).where(F.col("n") > many)
    big = a.select(g).union(b.select(g)).distinct()
    big = None if big.isEmpty() else cut(big)
    kind = dict(edges.dtypes)[g]
    few_e, few_p = (edges, points) if big is None else (edges.join(big, g, "left_anti"), points.join(big, g, "left_anti"))
    few_p = few_p.where(F.col(g).isNotNull()).withColumnRenamed(g, "_g")
    columns = T._parse_datatype_string(schema).names

    def one(es: pa.Table, ps: pa.Table) -> pa.Table:
        order = np.argsort(ps["idx"].to_numpy(), kind="stable")
        idx, nodes = ps["idx"].to_numpy()[order], ps["node"].to_numpy()[order]
        own, place = np.unique(nodes, return_inverse=True)
        dist = np.full((len(own), len(own)), -1, np.int64)
        at = {x: i for i, x in enumerate(own.tolist())}
        links = near(es, own) if len(es) and len(ps) else {}
        for x, i in at.items():
            best, heap, row = {}, [(0, x)], dist[i]
            while heap:
                d, y = heapq.heappop(heap)
                if y not in best:
                    best[y] = d
                    if (j := at.get(y)) is not None:
                        row[j] = d
                    for m, w in links.get(y, ()):
                        if m not in best:
                            heapq.heappush(heap, (d + w, m))
        got = emit(idx, nodes, dist[np.ix_(place, place)])
        n = len(got[columns[0]])
        group = ps["_g"].take(pa.array(np.zeros(n, np.int64))) if len(ps) else es[g].slice(0, 0)
        return pa.table({g: group, **got})

    out = few_e.groupBy(g).cogroup(few_p.groupBy("_g")).applyInArrow(one, f"`{g}` {kind}, {schema}")
    if big is None:
        return out
    left = rest(cut(edges.join(big, g, "left_semi")), cut(points.join(big, g, "left_semi")))
    return out.union(left.select(g, *columns))


def all_paths(edges: DataFrame, points: DataFrame, g: str = "image_id", most: int = 500_000, many: int = 1_000) -> DataFrame:
    """(g, source, node, dist) of every two of points(g, node), source < node, over edges(g, a, b, w), directed, all longs; -1 without a way.

    A group of at most `most` edges and `many` points is searched by one task,
    which writes its pairs itself: no table of pairs is made, sent or joined.
    """
    e = edges.select(g, F.col("a").cast("long"), F.col("b").cast("long"), F.col("w").cast("long"))
    p = points.select(g, F.col("node").cast("long")).where("node is not null").distinct()

    def near(t: pa.Table, _: np.ndarray) -> dict:
        links: dict[int, list[tuple[int, int]]] = {}
        for a, b, w in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["w"].to_pylist(), strict=True):
            links.setdefault(a, []).append((b, w))
        return links

    def rest(e: DataFrame, p: DataFrame) -> DataFrame:
        pairs = two_of(p, g)
        return pairs.join(paths_by_group(e, pairs, g, most=most), [g, "source", "node"], "left").select(g, "source", "node", F.coalesce("dist", F.lit(-1)).alias("dist"))

    return searched_whole(e, p.withColumn("idx", F.col("node")), near, "source long, node long, dist long", as_pairs, rest, g, most, many)
