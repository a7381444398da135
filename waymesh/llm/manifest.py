"""Merkle manifest of a dataset: a tree per language over its documents, one tree over those.

A tree has its leaves in order; every two nodes in a row (the last one alone, if
the number is odd) become the hash of theirs, level by level, until one is left.

Trees are append logs in postorder. An aligned builder takes 2 ** k leaves in a
row and writes the nodes over them as they complete; what the builders of a tree
leave are the leaves of its next layer, until a layer has one builder. No search
is needed to read a log: a node that covers whole leaves completes right after
its last leaf and the nodes below it that end there, so the node of level l that
ends with leaf j stands at 2 * j - popcount(j) + l; the unfinished nodes at the
right edge follow the last leaf, level by level. The numbers of nodes below give
the addresses of a leaf's siblings, in a builder's log and in the whole tree's.

Proofs go the other way: a layer's builders hand every leaf its siblings within
and those that came from above, so a document's proof needs its own builder's
log and one short path, not a lookup a level.

Edge rows: nulls in any column are written as "-", so differ from the empty
text. Rows without a language are a tree of their own, the first. Within a tree
rows without a doc_id come first, rows with the same one by their leaf; repeated
rows are leaves each. An empty table has no root and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.ranks import numbered, placed
from waymesh.session import materialise

#: Documents of a builder are 2 ** SPAN.
SPAN = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of some strings in a row."""
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves."""
    return max(n - 1, 0).bit_length()


def log_position(level: np.ndarray, i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Place in the postorder log of n leaves of node i of a level."""
    level, i, n = (np.asarray(v, np.int64) for v in (level, i, n))
    last = ((i + 1) << level) - 1
    whole = 2 * last - np.bitwise_count(last).astype(np.int64) + level
    # the right edge: unfinished levels are those above the lowest set bit of n
    lowest = np.bitwise_count((n & -n) - 1).astype(np.int64)
    edge = 2 * n - np.bitwise_count(n).astype(np.int64) + level - 1 - lowest
    return np.where(last < n, whole, edge)


def append_log(leaves: list[str], top: int) -> list[str]:
    """Nodes over some leaves in order of completion, up to the one node of level top."""
    log: list[str] = []
    open_: list[str | None] = [None] * (top + 1)
    for node in leaves:
        level = 0
        log.append(node)
        while level < top and (left := open_[level]) is not None:
            node, open_[level] = digest(left, node), None
            level += 1
            log.append(node)
        open_[level] = node
    rest = None
    for level in range(top):
        left = open_[level]
        if left is not None or rest is not None:
            rest = digest(left or "", rest or "")
            log.append(rest)
    return log


def siblings(log: str, m: int, top: int, above: list[str]) -> list[list[str]]:
    """For each of a builder's m leaves its siblings from the bottom up, then those above: "<" or ">" for the side and the hash, "" for none."""
    i = np.arange(m, dtype=np.int64)
    columns = []
    for level in range(top):
        other = (i >> level) ^ 1
        at = np.where(other << level < m, log_position(level, other, m), -1)
        side = np.where(other < i >> level, "<", ">")
        columns.append([s + log[64 * p : 64 * p + 64] if p >= 0 else "" for s, p in zip(side.tolist(), at.tolist(), strict=True)])
    return [[*own, *above] for own in zip(*columns, strict=True)] if top else [list(above) for _ in range(m)]


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for s in path:
        leaf = digest(s[1:], leaf) if s[:1] == "<" else digest(leaf, s[1:])
    return leaf


@dataclass
class Forest:
    """Logs of some trees: layers[t] has a row (tree, block, n, top, log) a builder, n leaves in its tree and layer; a log is its hashes in a row."""

    layers: list[DataFrame]
    span: int

    def roots(self) -> DataFrame:
        """(tree, root)."""
        out = None
        for layer in self.layers:
            r = layer.where(F.col("n") <= 2**self.span).select("tree", F.col("top").alias("root"))
            out = r if out is None else out.union(r)
        return out

    def log(self) -> DataFrame:
        """(tree, position, level, i, hash): every tree's log, a row a node."""
        span, out = self.span, None
        leaves = self.layers[0].where("block = 0").select("tree", F.col("n").alias("leaves"))

        def nodes(first_layer: bool, lift: int):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for tree, block, n, log, total in b[["tree", "block", "n", "log", "leaves"]].itertuples(index=False, name=None):
                        m, top = _shape(block, n, span)
                        for level in range(0 if first_layer else 1, top + 1):
                            i = np.arange(-(-m >> level) if level else m, dtype=np.int64)
                            at, place = log_position(level, i, m), (block << span - level) + i
                            yield pd.DataFrame({"tree": tree, "position": log_position(level + lift, place, total), "level": level + lift, "i": place, "hash": [log[64 * p : 64 * p + 64] for p in at.tolist()]})

            return run

        for t, layer in enumerate(self.layers):
            rows = layer.join(leaves, "tree").mapInPandas(nodes(t == 0, t * span), "tree long, position long, level int, i long, hash string")
            out = rows if out is None else out.union(rows)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, block, n, log, up, ...) of every lowest builder, up being the siblings from its top to the end of above(tree, up, ...)."""
        span, carried = self.span, None
        more = [f for f in above.schema if f.name not in ("tree", "up")]
        names = ["tree", "block", "up", *(f.name for f in more)]
        kind = ", ".join(["tree long", "block long", "up array<string>", *(f"{f.name} {f.dataType.simpleString()}" for f in more)])

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.to_dict("records"):
                    m, top = _shape(r["block"], r["n"], span)
                    ups = siblings(r["log"], m, top, list(r["up"]))
                    yield pd.DataFrame([[r["tree"], (r["block"] << span) + i, up, *(r[f.name] for f in more)] for i, up in enumerate(ups)], columns=names)

        for layer in reversed(self.layers):
            ends = layer.where(F.col("n") <= 2**span).join(above, "tree").select("tree", "block", "n", "log", *names[2:])
            got = ends if carried is None else ends.union(layer.where(F.col("n") > 2**span).join(carried, ["tree", "block"]).select("tree", "block", "n", "log", *names[2:]))
            if layer is self.layers[0]:
                return got
            carried = got.mapInPandas(spread, kind)
        raise ValueError("a forest has a layer")


def _shape(block: int, n: int, span: int) -> tuple[int, int]:
    """Leaves of a builder and the level of its top, in a layer of n leaves."""
    return min(n - (block << span), 1 << span), span if n > 1 << span else height(n)


def build(leaves: DataFrame, span: int = SPAN) -> Forest:
    """Logs over leaves(tree, idx, hash, n): idx from 0 in a tree of n leaves."""

    def builder(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, block, n = (int(pdf[c].iloc[0]) for c in ("tree", "block", "n"))
        log = append_log(pdf.sort_values("idx")["hash"].tolist(), _shape(block, n, span)[1])
        return pd.DataFrame({"tree": [tree], "block": [block], "n": [n], "top": [log[-1]], "log": ["".join(log)]})

    layers = []
    while True:
        blocks = leaves.withColumn("block", F.shiftright("idx", span)).groupBy("tree", "block")
        layer = materialise(blocks.applyInPandas(builder, "tree long, block long, n long, top string, log string"), "log")
        layers.append(layer)
        over = layer.where(F.col("n") > 2**span)
        if over.isEmpty():
            return Forest(layers, span)
        leaves = over.select("tree", F.col("block").alias("idx"), F.col("top").alias("hash"), F.shiftright(F.col("n") + (2**span - 1), span).alias("n"))


def field(value: str | Column) -> Column:
    """A value as it enters a leaf: "-" for null, else its UTF-8 bytes, ":" and itself."""
    v = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf(values: list[str | Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


@dataclass
class Manifest:
    """Trees of all groups, the tree over them, and the documents with their places: (key, leaf, claimed, tree, idx, n); claimed is another leaf to verify, or null."""

    documents: DataFrame
    groups: DataFrame
    trees: Forest
    forest: Forest
    root: str | None

    def proofs(self) -> DataFrame:
        """(key, leaf, subroot, root, proof, folded): every document's siblings up to the root, and where its claimed leaf, or else its own, leads."""
        spark = self.documents.sparkSession
        key = dict(self.documents.dtypes)["key"]
        start = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.array().cast("array<string>").alias("up"))
        over = self.forest.paths(start)

        def to_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for block, n, log, up in b[["block", "n", "log", "up"]].itertuples(index=False, name=None):
                    m, top = _shape(block, n, self_span)
                    own = log_position(0, np.arange(m), m).tolist()
                    yield pd.DataFrame({"tree": (block << self_span) + np.arange(m), "up": siblings(log, m, top, list(up)), "subroot": [log[64 * p : 64 * p + 64] for p in own]})

        self_span = self.forest.span
        above = over.mapInPandas(to_groups, "tree long, up array<string>, subroot string")
        logs, span = self.trees.paths(above), self.trees.span

        def prove(rows: pd.DataFrame, logs: pd.DataFrame) -> pd.DataFrame:
            block, n, log, up, subroot = logs[["block", "n", "log", "up", "subroot"]].iloc[0]
            m, top = _shape(int(block), int(n), span)
            paths = siblings(log, m, top, list(up))
            out = []
            for k, own, claimed, idx in rows[["key", "leaf", "claimed", "idx"]].itertuples(index=False, name=None):
                path = paths[idx & ((1 << span) - 1)]
                out.append((k, own, subroot, digest(*(s[1:] for s in path)), folded(claimed if isinstance(claimed, str) else own, path)))
            return pd.DataFrame(out, columns=["key", "leaf", "subroot", "proof", "folded"])

        docs = self.documents.select(F.col("key").cast("string"), "leaf", "claimed", "tree", "idx", F.shiftright("idx", span).alias("block"))
        got = docs.groupBy("tree", "block").cogroup(logs.groupBy("tree", "block")).applyInPandas(prove, "key string, leaf string, subroot string, proof string, folded string")
        return got.select(F.col("key").cast(key), "leaf", "subroot", F.lit(self.root).cast("string").alias("root"), "proof", "folded")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", claimed: Column | None = None, span: int = SPAN) -> Manifest:
    """The manifest of docs, their leaves over `fields`. claimed: per row a leaf to be verified in place of its own, null for its own."""
    slim = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("group"), leaf(list(fields)).alias("leaf"), (F.lit(None) if claimed is None else claimed).cast("string").alias("claimed"))
    rows, runs = placed(slim, "group", [F.col("key").asc_nulls_first(), F.col("leaf").asc()])
    found, among = placed(runs.select(F.lit(0).alias("all"), "group").distinct(), "all", [F.col("group").asc_nulls_first()])
    groups = materialise(numbered(found, among, "all").select("group", F.col("idx").alias("tree"), F.col("n").alias("trees")), "groups")
    r, g = runs.alias("r"), groups.alias("g")
    runs = r.join(g, F.col("r.group").eqNullSafe(F.col("g.group"))).select("r.*", "g.tree")
    documents = materialise(numbered(rows, runs, "group").select("key", "leaf", "claimed", "tree", "idx", "n"), "leaves")
    trees = build(documents.select("tree", "idx", F.col("leaf").alias("hash"), "n"), span)
    tops = trees.roots().join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("root").alias("hash"), F.col("trees").alias("n"))
    forest = build(tops, span)
    root = forest.roots().first()
    return Manifest(documents, groups, trees, forest, root["root"] if root else None)


def tampered_leaf(number: str = "n_chars", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, every: int = 7) -> Column:
    """The leaf with 1 added to a number, where `every` divides the CRC-32 of the key as text; null elsewhere and where the number is null."""
    more = (F.col(number).cast("decimal(20,0)") + 1).cast("string")
    changed = leaf([more if c == number else c for c in fields])
    return F.when((F.crc32(F.col(key).cast("string")) % every == 0) & F.col(number).isNotNull(), changed)


def verified(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, some of them tampered with."""
    m = manifest(docs, claimed=tampered_leaf(), span=span)
    return m.proofs().select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 (polynomial 0xEDB88320) of an ASCII text, byte by byte through a table made by its rule."""
    bit = "lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384::ubigint), c >> 1)"
    table = f"(select list(list_reduce(list_prepend(n::ubigint, list_transform(range(8), lambda k: k::ubigint)), {bit}) order by n) from range(256) t(n))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::ubigint)"
    step = "lambda c, b: xor(c >> 8, entries[((xor(c, b) & 255) + 1)::int])"
    return f"(select xor(list_reduce(list_prepend(4294967295::ubigint, {codes}), {step}), 4294967295::ubigint) from (select {table} as entries) q)"


def verified_sql(every: int = 7) -> str:
    """DuckDB SQL of verified(documents): levels, siblings and folds by recursion over tables of nodes."""
    part = lambda c: f"case when {c} is null then '-' else strlen(({c})::varchar) || ':' || ({c})::varchar end"
    leaf_of = lambda number: "sha256(" + " || ".join(part(number if c == "n_chars" else c) for c in FIELDS) + ")"
    up = lambda name, first: f"{name} as (select {first} union all select tree, lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from {name} where n > 1 group by tree, lvl, i // 2, n)"
    steps = lambda nodes, at, tree, idx, after: f"select l.row, {after} + k.lvl as step, s.h, ({idx} >> k.lvl) & 1 as odd from {at} join (select tree, unnest(range(max(lvl))) as lvl from {nodes} group by tree) k on k.tree = {tree} left join {nodes} s on s.tree = k.tree and s.lvl = k.lvl and s.i = xor({idx} >> k.lvl, 1)"
    return f"""
with recursive d as (select *, {leaf_of("n_chars")} as leaf, case when n_chars is not null and {_crc32_sql("doc_id::varchar")} % {every} = 0 then {leaf_of("n_chars + 1")} end as changed from documents),
g as (select lang, row_number() over (order by lang nulls first) - 1 as tree, count(*) over () as trees from (select distinct lang from d)),
l as (select row_number() over () as row, doc_id, leaf, changed, tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n
      from d join g on d.lang is not distinct from g.lang),
{up("nodes", "tree, 0::bigint as lvl, idx as i, leaf as h, n from l")},
{up("tops", "0::bigint as tree, 0::bigint as lvl, nodes.tree as i, h, trees as n from nodes join g on g.tree = nodes.tree where nodes.n = 1")},
s as ({steps("nodes", "l", "l.tree", "l.idx", "0")} union all
      {steps("tops", "l join (select tree, max(lvl) as high from nodes group by tree) m on m.tree = l.tree", "0", "l.tree", "m.high")}),
f as (select row, 0::bigint as step, coalesce(changed, leaf) as h from l union all
      select f.row, f.step + 1, sha256(case when s.odd = 1 then coalesce(s.h, '') || f.h else f.h || coalesce(s.h, '') end) from f join s on s.row = f.row and s.step = f.step),
p as (select row, sha256(string_agg(coalesce(h, ''), '' order by step)) as proof from s group by row),
e as (select row, arg_max(h, step) as folded from f group by row)
select l.doc_id, l.leaf, nodes.h as subroot, tops.h as root, coalesce(p.proof, sha256('')) as proof_sha256, e.folded as folded_root, e.folded = tops.h as verified
from l join nodes on nodes.tree = l.tree and nodes.n = 1 join tops on tops.n = 1 join e on e.row = l.row left join p on p.row = l.row
"""
