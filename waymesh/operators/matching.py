"""Linking directions, keypoints and graph nodes one to one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.functions import geo
from waymesh.operators import iterate, regions
from waymesh.session import dealt


def direction_pairs(dirs: DataFrame, g: str = "patch_id") -> DataFrame:
    """(g, i, si, j, sj): directions (slots si, sj) of different keypoints, i < j, that point to 60-degree sectors two to four apart modulo six.

    dirs: (g, kp_seq, slot, deg).
    """
    return _facing(dirs, g, (), ()).select(g, "i", "si", "j", "sj")


def _facing(dirs: DataFrame, g: str, mine: tuple[Column, ...], theirs: tuple[Column, ...]) -> DataFrame:
    """direction_pairs with further columns of the one direction and of the other."""
    sector = (F.floor(F.col("deg") / 60) % 6).cast("int")
    left = dirs.select(g, F.col("kp_seq").alias("i"), F.col("slot").alias("si"), *mine, F.explode(F.array(*((sector + k) % 6 for k in (2, 3, 4)))).alias("_s"))
    right = dirs.select(g, F.col("kp_seq").alias("j"), F.col("slot").alias("sj"), *theirs, sector.alias("_s"))
    return left.join(right, [g, "_s"]).where("i < j").drop("_s")


def _sides(*columns: str) -> list[tuple[Column, ...]]:
    """Place and vector of a direction as columns of a pair's one side, and of the other."""
    return [tuple(F.col(c).alias(k + c[:1]) for c in ("x", "y", "sin", "cos")) for k in columns]


def _with_sums(pairs: DataFrame, penalty: float = 1e4) -> DataFrame:
    """Pairs (i, si, j, sj) that carry both sides' places and vectors (_sides), with the keypoints' distance, the sum of both angles to the other keypoint, and of both line distances.

    What a pair needs comes with it from the join that made it: pairs are many
    times the directions, so they are never shuffled to look it up.
    """
    q = pairs.where("si is not null and sj is not null").withColumn("dist", geo.euclidean("ix", "iy", "jx", "jy"))
    ux, uy = F.col("jx") - F.col("ix"), F.col("jy") - F.col("iy")
    l1, l2 = geo.ray_distance("jx", "jy", "ix", "iy", "ic", "is", penalty), geo.ray_distance("ix", "iy", "jx", "jy", "jc", "js", penalty)
    return q.withColumns({"angle_sum": geo.vector_angle("ic", "is", ux, uy) + geo.vector_angle("jc", "js", -ux, -uy), "line_sum": l1 + l2})


def _in_reach(dirs: DataFrame, g: str, top: float) -> DataFrame:
    """_facing with both sides' places and vectors (_sides), of pairs whose line distances sum to less than `top`.

    Few pairs do. The cost's expression is longer than what the JVM compiles, so
    it is kept for them: rows are handed on as they are, which keeps Spark from
    working the cost out within the join.
    """
    pairs = _facing(dirs, g, *_sides("i", "j"))
    lines = geo.ray_distance("jx", "jy", "ix", "iy", "ic", "is") + geo.ray_distance("ix", "iy", "jx", "jy", "jc", "js")
    return pairs.where(lines < top).mapInArrow(lambda batches: batches, pairs.schema)


def pair_costs(dirs: DataFrame, g: str = "patch_id", reject: float = 1000.0, **limits) -> DataFrame:
    """direction_pairs of keypoints apart with the cost of joining them (geo.pair_cost with these limits), those below reject only.

    dirs: (g, kp_seq, slot, x, y, deg, sin, cos).
    """
    q = _with_sums(_in_reach(dirs, g, max(limits.get("line_range", (70.0, 140.0))))).where("dist > 0")
    q = q.withColumn("cost", F.round(geo.pair_cost("dist", "angle_sum", "line_sum", reject=reject, **limits), 9))
    return q.where(F.col("cost") < reject).select(g, "i", "si", "j", "sj", "dist", "cost")


def line_costs(dirs: DataFrame, g: str = "patch_id", distance_range: tuple[float, float] = (30.0, 448.0), line_range: tuple[float, float] = (50.0, 140.0), penalty: float = 1e4) -> DataFrame:
    """All directions (g, i, si, j, sj, dist, cost) of two keypoints, i < j, whose line distances sum to at most the limit at their distance.

    A patch has as many keypoints as its decoder's top k, which bounds its pairs.
    """
    mine, theirs = _sides("i", "j")
    # dealt by rows: a task's pairs are many times what comes in
    d = dealt(dirs, 50_000, g)
    pairs = d.select(g, F.col("kp_seq").alias("i"), F.col("slot").alias("si"), *mine).join(d.select(g, F.col("kp_seq").alias("j"), F.col("slot").alias("sj"), *theirs), g).where("i < j")
    q = _with_sums(pairs, penalty).where(F.col("line_sum") <= geo.lerp_clamped("dist", *distance_range, *line_range))
    return q.select(g, "i", "si", "j", "sj", "dist", F.round("line_sum", 9).alias("cost"))


def designed_distances(dirs: DataFrame, width: int, height: int, g: str = "patch_id") -> DataFrame:
    """(g, i, j, dist) of keypoints of one patch that have directions: geo.designed_distance, i < j."""
    d = dirs.select(g, F.col("kp_seq").alias("i"), F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("sin").alias("is"), F.col("cos").alias("ic"))
    # a task's table of pairs is as large as its patches are many, so these are dealt
    d = dealt(d, 50_000, g)
    p = d.join(d.toDF(g, "j", "jx", "jy", "js", "jc"), g).where("i < j")
    gap = F.min(F.sqrt((F.col("is") + F.col("js")) ** 2 + (F.col("ic") + F.col("jc")) ** 2))
    best = p.groupBy(g, "i", "j").agg(F.min(geo.euclidean("ix", "iy", "jx", "jy")).alias("apart"), gap.alias("gap"))
    return best.select(g, "i", "j", geo.designed_distance("apart", "gap", min(width, height)).alias("dist"))


def nearest_candidate(cands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loc_idx, dir_idx): of candidates (keys, dist, dir_dist, loc_idx, dir_idx) the nearest, the least direction distance at a tie, then the first."""
    best = F.min(F.struct("dist", "dir_dist", "loc_idx", "dir_idx"))
    return cands.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.loc_idx", "b.dir_idx")


def _end_codes(t: pa.Table, names: list[str]) -> list[list[int]]:
    """The ends of every row of a group as numbers, equal ends having one number; nulls are values like any other."""
    if pa.types.is_struct(t.schema.field(names[0]).type):
        whole = [[x.field(i) for i in range(x.type.num_fields)] for x in (t.column(n).combine_chunks() for n in names)]
        rows = [np.column_stack([y for c in cols for y in (c.is_null().to_numpy(zero_copy_only=False), c.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))]) for cols in whole]
        code = np.unique(np.concatenate(rows), axis=0, return_inverse=True)[1].reshape(len(names), -1)
    else:
        code = pd.factorize(pd.concat([t.column(n).to_pandas() for n in names], ignore_index=True))[0].reshape(len(names), -1)
    return code.T.tolist()


def _greedy(pairs: DataFrame, g: str, order: list, ends: list, also: list | None = None, most: int = 500_000) -> DataFrame:
    """Pairs that a scan by `order` takes, no two with an end in common.

    A group of at most `most` pairs is scanned by one task, which knows the ends
    that are taken: no table of clashes, of which an end of n pairs has n * n / 2.
    Larger groups go through rounds (_taken_in_rounds).
    """
    every = [*ends, *(also or [])]
    named = {f"_end{k}": e for k, e in enumerate(every)}
    keyed = pairs.where(F.col(g).isNotNull()).withColumns(named)
    kinds = {keyed.schema[n].dataType for n in named}
    if len(kinds) > 1 or not all(regions.countable(k) for k in kinds):
        keyed = keyed.withColumns({n: F.to_json(n) for n in named})
    ranked = lambda t: t.withColumn("_id", F.row_number().over(Window.partitionBy(g).orderBy(*order)).cast("long"))
    by = list(order)
    if any(isinstance(keyed.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) for c in order):
        keyed, by = ranked(keyed), ["_id"]
    p = iterate.cut(keyed)
    columns, names = pairs.columns, list(named)

    def scan(t: pa.Table) -> pa.Table:
        # put in order here: a window before would shuffle and sort all pairs once more
        t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in by], null_placement="at_start"))
        used: set[int] = set()
        keep = []
        for i, at in enumerate(_end_codes(t, names)):
            if used.isdisjoint(at):
                used.update(at)
                keep.append(i)
        return t.take(pa.array(keep, pa.int64())).select(columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    big = regions.over_limit(p, g, most)
    if big is None:
        return p.groupBy(g).applyInArrow(scan, schema)
    big = big.select(g)
    got = p.join(big, g, "left_anti").groupBy(g).applyInArrow(scan, schema)
    large = p.join(big, g, "left_semi").select(p.columns)
    large = iterate.cut(large if by == ["_id"] else ranked(large))
    return got.union(_taken_in_rounds(large, g, names).select(columns))


def _taken_in_rounds(pairs: DataFrame, g: str, ends: list[str]) -> DataFrame:
    """Pairs (g, _id, ends) that a scan by _id takes: in every round those that are first at all their ends, and what clashes with them goes."""
    left, taken = iterate.cut(pairs.select(g, "_id", F.array(*ends).alias("_ends"))), None
    while not left.isEmpty():
        at = left.select(g, "_id", F.explode("_ends").alias("_end"))
        first = at.groupBy(g, "_end").agg(F.min("_id").alias("_first"))
        won = iterate.cut(at.join(first, [g, "_end"]).groupBy(g, "_id").agg(F.min(F.col("_id") == F.col("_first")).alias("_won")).where("_won").select(g, "_id"))
        taken = won if taken is None else taken.union(won)
        used = at.join(won, [g, "_id"], "left_semi").select(g, "_end").distinct()
        lost = at.join(used, [g, "_end"], "left_semi").select(g, "_id").distinct()
        left = iterate.cut(left.join(lost, [g, "_id"], "left_anti"))
    return pairs.join(taken, [g, "_id"], "left_semi")


def link_greedy(costs: DataFrame, g: str = "patch_id") -> DataFrame:
    """Links by rising cost, each direction in one link at most."""
    ends = [F.struct(F.col("i").alias("k"), F.col("si").alias("s"), F.lit(0).alias("o")), F.struct(F.col("j").alias("k"), F.col("sj").alias("s"), F.lit(0).alias("o"))]
    return _greedy(costs, g, ["cost", "i", "si", "j", "sj"], ends)


def link_closest(costs: DataFrame, g: str = "patch_id") -> DataFrame:
    """Links by rising distance of keypoints, the cheapest unused directions first, one link for two keypoints; costs as of line_costs."""
    ends = [F.struct(F.col("i").alias("k"), F.col("si").cast("long").alias("s"), F.lit(0).alias("o")), F.struct(F.col("j").alias("k"), F.col("sj").cast("long").alias("s"), F.lit(0).alias("o"))]
    pair = [F.struct(F.col("i").alias("k"), F.col("j").cast("long").alias("s"), F.lit(1).alias("o"))]
    return _greedy(costs, g, ["dist", "i", "j", "cost", "si", "sj"], ends, pair)


def select_ascending(pairs: DataFrame, g: str, a: str = "a", b: str = "b", cost: str = "cost") -> DataFrame:
    """One-to-one selection of pairs by rising cost."""
    ends = [F.struct(F.lit(0).alias("side"), F.col(a).cast("long").alias("n")), F.struct(F.lit(1).alias("side"), F.col(b).cast("long").alias("n"))]
    return _greedy(pairs, g, [cost, a, b], ends)


def ascending_totals(pairs: DataFrame, g: str) -> DataFrame:
    """(g, matched, total) of select_ascending(pairs(g, a, b, cost))."""
    return select_ascending(pairs, g).groupBy(g).agg(F.count("*").alias("matched"), F.sum("cost").alias("total"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment (rows <= columns).

    Rows first take what is worth most to them and put others out while prices
    fall, four offers a row at most; what is free then is placed by shortest
    augmenting paths. Columns that nobody took keep the price zero.
    """
    n, m = cost.shape
    v, of_row, of_col = np.zeros(m), np.full(n, -1), np.full(m, -1)
    free, left = list(range(n - 1, -1, -1)), 4 * n
    while free and left and m > 1:
        i, left = free.pop(), left - 1
        net = cost[i] - v
        j = int(net.argmin())
        first, net[j] = net[j], np.inf
        k = int(net.argmin())
        if net[k] == first and of_col[j] >= 0 and of_col[k] < 0:
            j = k
        elif net[k] > first:
            v[j] -= net[k] - first
        elif of_col[j] >= 0:
            free.append(i)
            break
        if (out := of_col[j]) >= 0:
            of_row[out] = -1
            free.append(int(out))
        of_row[i], of_col[j] = j, i
    u = (cost - v).min(axis=1) if n else np.zeros(0)
    placed = of_row >= 0
    u[placed] = cost[np.flatnonzero(placed), of_row[placed]] - v[of_row[placed]]
    for root in np.flatnonzero(~placed):
        least, came, used, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool), []
        i, low, end = root, 0.0, -1
        while end < 0:
            seen.append(i)
            way = cost[i] - v + (low - u[i])
            better = (way < least) & ~used
            least[better], came[better] = way[better], i
            j = int(np.where(used, np.inf, least).argmin())
            low, used[j] = least[j], True
            i = of_col[j]
            end = j if i < 0 else -1
        u[root] += low
        for i in seen[1:]:
            u[i] += low - least[of_row[i]]
        v[used] -= low - least[used]
        while True:
            i = came[end]
            of_col[end], of_row[i], end = i, end, of_row[i]
            if i == root:
                break
    return of_row


def largest_matching(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many of the pairs as can be without a common end: a greedy start, then breadth-first augmenting paths."""
    near: dict[int, list[int]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    of_b: dict[int, int] = {}
    free = []
    for a, bs in near.items():
        b = next((b for b in bs if b not in of_b), None)
        if b is None:
            free.append(a)
        else:
            of_b[b] = a
    for root in free:
        came: dict[int, int] = {}  # which row reached each column
        had: dict[int, int] = {}  # the column that a row held before
        queue, end = [root], None
        for a in queue:
            for b in near[a]:
                if b not in came:
                    came[b] = a
                    if b not in of_b:
                        end = b
                        break
                    had[of_b[b]] = b
                    queue.append(of_b[b])
            if end is not None:
                break
        while end is not None:
            a = came[end]
            of_b[end], end = a, had.get(a)
    return [(a, b) for b, a in of_b.items()]


def _matched_whole(pairs: DataFrame, g: str) -> DataFrame:
    """(g, a, b, cost): as many of pairs(g, a, b, cost) as can be, a task a group; of repeated pairs the cheapest."""

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by([("a", "ascending"), ("b", "ascending"), ("cost", "ascending")])
        rows: dict[tuple, int] = {}
        for i, ab in enumerate(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)):
            rows.setdefault(ab, i)
        return t.take(pa.array([rows[ab] for ab in largest_matching(list(rows))], pa.int64())).select([g, "a", "b", "cost"])

    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in (g, "a", "b", "cost"))
    known = F.col(g).isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull()
    return pairs.select(g, "a", "b", "cost").where(known).groupBy(g).applyInArrow(solve, schema)


def matching_rounds(pairs: DataFrame, g: str, most: int = 500_000) -> DataFrame:
    """(g, a, b): a largest set of pairs(g, a, b) without a common end, in rounds of joins for groups of more than `most` pairs, which may be of any size.

    Smaller groups are solved by one task each, so they need no round. From every free a alternating trees grow, each node in one tree only; every
    tree that reaches a free b gives one path, all these are turned over at
    once, and it ends when no tree reaches one.
    """
    every = iterate.cut(pairs.select(g, "a", "b"))
    big = regions.over_limit(every, g, most)
    few = every if big is None else every.join(big.select(g), g, "left_anti")
    small = _matched_whole(few.withColumn("cost", F.lit(0)), g).select(g, "a", "b")
    if big is None:
        return small
    e = iterate.cut(every.join(big.select(g), g, "left_semi").distinct())
    # in order of a hash, so that large groups need few rounds
    m = iterate.cut(select_ascending(e.withColumn("cost", F.xxhash64("a", "b")), g).select(g, "a", "b"))
    while True:
        front = iterate.cut(e.select(g, "a").distinct().join(m.select(g, "a"), [g, "a"], "left_anti").withColumn("root", F.col("a")))
        tree = None  # (g, b, a, root): b was reached from a
        ends = None
        while not front.isEmpty():
            step = front.join(e, [g, "a"])
            if tree is not None:
                step = step.join(tree.select(g, "b"), [g, "b"], "left_anti")
            step = iterate.cut(step.groupBy(g, "b").agg(F.min(F.struct("root", "a")).alias("p")).select(g, "b", "p.a", "p.root"))
            tree = step if tree is None else tree.union(step)
            hit = step.join(m.select(g, "b"), [g, "b"], "left_anti").groupBy(g, "root").agg(F.min("b").alias("b"))
            ends = hit if ends is None else ends.union(hit.join(ends.select(g, "root"), [g, "root"], "left_anti"))
            ends = iterate.cut(ends)
            # trees that have their path stop growing
            front = iterate.cut(step.join(m.toDF(g, "next", "b"), [g, "b"]).select(g, F.col("next").alias("a"), "root").join(ends.select(g, "root"), [g, "root"], "left_anti"))
        if ends is None or ends.isEmpty():
            return small.union(m.select(g, "a", "b"))
        # walk every path back from its free b: the pair (a, b) comes in, a's old pair goes
        at = ends
        while not at.isEmpty():
            add = iterate.cut(at.join(tree, [g, "b", "root"]).select(g, "a", "b", "root"))
            old = m.join(add.select(g, "a", "root"), [g, "a"]).select(g, "root", "a", "b")
            at = iterate.cut(old.select(g, "root", "b"))
            m = iterate.cut(m.join(add.select(g, "a"), [g, "a"], "left_anti").union(add.select(g, "a", "b")))


def auction(pairs: DataFrame, g: str, filler: float, unit: float = 1e-9, shrink: int = 4) -> DataFrame:
    """(g, a, b): a least-cost assignment of pairs(g, a, b, cost), a and b long, in which a row may stay alone at `filler`; by auction, for components of any size.

    Costs count in whole units. Every row may take a column or its own blank,
    every column's shadow that column or the blank of a row it is paired with,
    so all can be placed and prices never block one. In a round every free
    bidder offers for what is worth most to it, as much as that is better than
    its next best, and the step; the highest offer holds. Steps shrink from the
    range of costs down to less than one unit over all bidders, where the
    assignment is exact; prices are kept in between. A round is joins of
    tables; the last ends when nobody is free.
    """
    e = iterate.cut(pairs.where(F.col("cost") < filler).groupBy(g, "a", "b").agg(F.min("cost").alias("cost")))
    sides = e.select(g, F.struct(F.lit(0).alias("s"), F.col("a").alias("n")).alias("p")).union(e.select(g, F.struct(F.lit(1).alias("s"), F.col("b").alias("n")))).distinct()
    most = sides.groupBy(g).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if most is None:
        return e.select(g, "a", "b")
    whole = lambda c: (F.round(c / F.lit(unit)) * F.lit(most + 1)).cast("long")
    row, shade = F.col("a") * 2, F.col("b") * 2 + 1
    column, blank = F.col("b") * 2, F.col("a") * 2 + 1
    zero = F.lit(0).cast("long")
    worth = [F.struct(row.alias("p"), column.alias("o"), (-whole(F.col("cost"))).alias("v")), F.struct(row.alias("p"), blank.alias("o"), (-whole(F.lit(filler))).alias("v")), F.struct(shade.alias("p"), column.alias("o"), zero.alias("v")), F.struct(shade.alias("p"), blank.alias("o"), zero.alias("v"))]
    offers = iterate.cut(e.select(g, F.explode(F.array(*worth)).alias("w")).select(g, "w.*").groupBy(g, "p", "o").agg(F.max("v").alias("v")))
    bidders = iterate.cut(offers.select(g, "p").distinct())
    state = iterate.cut(offers.select(g, "o").distinct().select(g, "o", zero.alias("price")))
    span = offers.agg((F.max("v") - F.min("v")).alias("c")).first()["c"]
    step = max(int(span) // shrink, 1)
    order = Window.partitionBy(g, "p").orderBy(F.desc("net"), "o")
    while True:
        state = state.select(g, "o", "price", F.lit(None).cast("long").alias("owner"))
        while True:
            free = bidders.join(state.select(g, F.col("owner").alias("p")), [g, "p"], "left_anti")
            net = offers.join(free, [g, "p"]).join(state.select(g, "o", "price"), [g, "o"]).withColumn("net", F.col("v") - F.col("price"))
            best = net.withColumns({"rank": F.row_number().over(order), "next": F.lead("net").over(order)}).where("rank = 1")
            # a bidder has a second choice always
            bids = best.select(g, "o", "p", (F.col("price") + F.col("net") - F.col("next") + F.lit(step)).alias("bid"))
            won = iterate.cut(bids.groupBy(g, "o").agg(F.max(F.struct("bid", "p")).alias("top")).select(g, "o", "top.*"))
            if won.isEmpty():
                break
            state = iterate.cut(state.join(won, [g, "o"], "left").select(g, "o", F.coalesce("bid", "price").alias("price"), F.coalesce("p", "owner").alias("owner")))
        if step == 1:
            break
        step = max(step // shrink, 1)
    return state.where("o % 2 = 0 and owner % 2 = 0").select(g, F.shiftright("owner", 1).alias("a"), F.shiftright("o", 1).alias("b"))


def component_match(pairs: DataFrame, g: str, filler: float | None = None, most: int = 200_000, unit: float = 1e-9) -> DataFrame:
    """pairs(g, a, b, cost) matched exactly.

    With a filler, a least-cost assignment in which a row may stay alone at
    that cost; without, as many pairs as can be. A group of at most `most`
    pairs is solved by one task, with a filler component by component. The
    components of larger ones are split in Spark and solved apart, which is
    exact for both. A component of more than `most` pairs is matched by
    matching_rounds; with a filler by auction.
    """
    # read for components and for costs: a plan would work all pairs out twice
    keyed = iterate.cut(pairs.select(g, F.col("a").cast("long"), F.col("b").cast("long"), F.col("cost").cast("double")))
    if filler is not None and not regions.countable(keyed.schema[g].dataType):
        return _by_component(keyed, g, filler, most, unit)
    solved = (lambda x: _matched_whole(x, g)) if filler is None else (lambda x: _assigned_whole(x, g, filler))
    big = regions.over_limit(keyed, g, most)
    if big is None:
        return solved(keyed)
    whole = solved(keyed.join(big.select(g), g, "left_anti"))
    return whole.union(_by_component(iterate.cut(keyed.join(big.select(g), g, "left_semi").select(keyed.columns)), g, filler, most, unit))


def _assigned_whole(pairs: DataFrame, g: str, filler: float) -> DataFrame:
    """component_match of pairs(g, a, b, cost) with a filler, of groups that a task can hold: their components are found and solved one by one where the group lies."""

    def work(t: list[iterate.Side]) -> Iterator[iterate.Side]:
        order = np.lexsort((t[0]["cost"], t[0]["b"], t[0]["a"]))
        a, b, cost = (t[0][c][order] for c in ("a", "b", "cost"))
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b, cost = a[new], b[new], cost[new]
        row, col = (np.unique(x, return_inverse=True)[1] for x in (a, b))
        col += row.max() + 1
        low = np.arange(col.max() + 1)
        while True:
            m = np.minimum(low[row], low[col])
            was = low.copy()
            for side in (row, col):
                np.minimum.at(low, low[side], m)
                np.minimum.at(low, side, m)
            low = low[low]
            if (low == was).all():
                break
        comp = low[row]
        order = np.argsort(comp, kind="stable")
        stops = np.flatnonzero(np.r_[True, comp[order][1:] != comp[order][:-1], True])
        keep = []
        for p, q in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            at = order[p:q]
            if q - p > 1:
                (ri, rows), (ci, cols) = pd.factorize(a[at]), pd.factorize(b[at])
                c = np.full((len(rows), len(cols) + len(rows)), filler)
                c[ri, ci] = cost[at]
                at = at[assignment(c)[ri] == ci]
            keep.append(at[cost[at] < filler])
        keep = np.concatenate(keep)
        yield {"a": a[keep], "b": b[keep], "cost": cost[keep]}

    known = pairs.select(g, "a", "b", "cost").where("a is not null and b is not null and cost is not null")
    return iterate.by_group([known], work, "a long, b long, cost double", 50_000, g)


def _by_component(keyed: DataFrame, g: str, filler: float | None, most: int, unit: float) -> DataFrame:
    """component_match of a table, each component by itself."""
    e = keyed.select(g, (F.col("a") * 2).alias("a"), (F.col("b") * 2 + 1).alias("b"))
    comp = iterate.components(e, g).select(g, F.col("node").alias("_a"), "component")
    full = iterate.cut(keyed.groupBy(g, "a", "b").agg(F.min("cost").alias("cost")).withColumn("_a", F.col("a") * 2).join(comp, [g, "_a"]).drop("_a"))
    large = iterate.cut(full.groupBy(g, "component").agg(F.count("*").alias("n")).where(F.col("n") > most).select(g, "component"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"], kind="stable")
        if filler is None:
            keep = largest_matching(list(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True)))
        else:
            (ri, rows), (ci, cols) = pd.factorize(pdf["a"]), pd.factorize(pdf["b"])
            c = np.full((len(rows), len(cols) + len(rows)), filler)
            c[ri, ci] = pdf["cost"]
            return pdf[(assignment(c)[ri] == ci) & (pdf["cost"].to_numpy() < filler)][[g, "a", "b", "cost"]]
        return pdf.merge(pd.DataFrame(keep, columns=["a", "b"], dtype="int64"), on=["a", "b"])[[g, "a", "b", "cost"]]

    schema = f"{g} {full.schema[g].dataType.simpleString()}, a long, b long, cost double"
    if large.isEmpty():
        return full.groupBy(g, "component").applyInPandas(solve, schema)
    rest = full.join(large, [g, "component"], "left_semi").select(g, "a", "b", "cost")
    few = full.join(large, [g, "component"], "left_anti").groupBy(g, "component").applyInPandas(solve, schema)
    found = matching_rounds(rest, g, 0) if filler is None else auction(rest, g, filler, unit)
    return few.union(found.join(rest, [g, "a", "b"]).select(g, "a", "b", "cost"))


def matching_sizes(pairs: DataFrame, keys: list[str], most: int = 2_000_000) -> DataFrame:
    """(keys, matched): how many of pairs(keys, a, b) go together without a common end, per key.

    A key's pairs, which come from samples within one walk's radius, are solved
    by one task; those of a key with more than `most` of them by matching_rounds.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"], kind="stable")
        n = len(largest_matching(list(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))))
        return pdf.iloc[:1][keys].assign(matched=n)

    kind = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {kind[k]}" for k in keys) + ", matched long"
    big = regions.over_limit(pairs.select(F.struct(*keys).alias("key")), "key", most)
    if big is None:
        return pairs.groupBy(*keys).applyInPandas(solve, schema)
    keyed = pairs.withColumn("key", F.struct(*keys))
    few = keyed.join(big, "key", "left_anti").select(pairs.columns).groupBy(*keys).applyInPandas(solve, schema)
    rounds = matching_rounds(keyed.join(big, "key", "left_semi").select("key", "a", "b"), "key")
    return few.union(rounds.groupBy("key").agg(F.count("*").alias("matched")).select("key.*", "matched"))


def link_assign(costs: DataFrame, g: str = "patch_id", filler: float = 1000.0, most: float = 500.0) -> DataFrame:
    """Least-cost assignment over the full symmetric table of directions; pairs below `most`, each once."""
    i, j = F.col("i") * 6 + F.col("si"), F.col("j") * 6 + F.col("sj")
    costs = iterate.cut(costs)
    both = costs.select(g, i.alias("a"), j.alias("b"), "cost").union(costs.select(g, j, i, "cost"))
    got = component_match(both, g, filler).where(F.col("cost") < most)
    return got.select(g, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cost").distinct()


def seam_match(nodes: DataFrame, seams: DataFrame, buffer: float, most: float, g: str = "image_id") -> DataFrame:
    """Nodes (g, id, x, y) on both sides of seams matched at least total distance; pairs at most `most` apart, with truncated midpoints.

    seams: (g, seam, vertical, at, lo, hi). The first side is the seam's own
    line and up to `buffer` before it, the second up to `buffer` behind. The cut
    comes after the assignment, so a seam's nodes are solved together: as many
    as pixels on its two strips at most.
    """
    across = F.when(F.col("vertical"), F.col("x")).otherwise(F.col("y"))
    along = F.when(F.col("vertical"), F.col("y")).otherwise(F.col("x"))
    near = nodes.join(seams, g).where((across >= F.col("at") - buffer) & (across <= F.col("at") + buffer) & along.between(F.col("lo"), F.col("hi")))
    near = near.select(g, "seam", "id", "x", "y", (across > F.col("at")).alias("second"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[~pdf["second"]].sort_values("id"), pdf[pdf["second"]].sort_values("id")
        cols = [g, "seam", "a", "b", "x", "y", "dist"]
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=cols)
        d = np.hypot(a["x"].to_numpy()[:, None] - b["x"].to_numpy(), a["y"].to_numpy()[:, None] - b["y"].to_numpy())
        turned = len(a) > len(b)
        got = assignment(d.T if turned else d)
        pairs = [(c, r) for r, c in enumerate(got)] if turned else list(enumerate(got))
        rows = [(pdf[g].iloc[0], pdf["seam"].iloc[0], a["id"].iloc[i], b["id"].iloc[j], int((a["x"].iloc[i] + b["x"].iloc[j]) / 2), int((a["y"].iloc[i] + b["y"].iloc[j]) / 2), d[i, j]) for i, j in pairs if d[i, j] <= most]
        return pd.DataFrame(rows, columns=cols)

    kind = dict(near.dtypes)
    return near.groupBy(g, "seam").applyInPandas(solve, f"{g} {kind[g]}, seam {kind['seam']}, a long, b long, x int, y int, dist double")


def segment_box_join(points: DataFrame, segments: DataFrame, reach: float, cell: float, g: str = "image_id") -> DataFrame:
    """Points (g, lat, lon, ...) with every segment (g, lat1, lon1, lat2, lon2, ...) whose bounding box touches the square `reach` around them."""
    p = points.withColumns({"al": F.col("lat") - reach, "ar": F.col("lat") + reach, "ab": F.col("lon") - reach, "at": F.col("lon") + reach})
    q = segments.withColumns({"bl": F.least("lat1", "lat2"), "br": F.greatest("lat1", "lat2"), "bb": F.least("lon1", "lon2"), "bt": F.greatest("lon1", "lon2")})
    return iterate.box_join(p, q, cell, g).drop("al", "ar", "ab", "at", "bl", "br", "bb", "bt")


def knn_join(a: DataFrame, b: DataFrame, k: int, radius: float, g: str = "image_id") -> DataFrame:
    """The k nearest of b(g, idb, bx, by) within radius of each of a(g, ida, ax, ay), with dist and rank; ties by idb."""
    w = Window.partitionBy(g, "ida").orderBy("dist", "idb")
    return iterate.grid_join(a, b, radius, g).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


