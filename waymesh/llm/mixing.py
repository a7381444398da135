"""Mixing sources to target weights by systematic sampling.

The sources share the words of all documents by weight; a source gives at most
`limit` times its own words, and what it leaves goes to the others by weight.
A document of a source with target t and size s is expected t / s times. These
expectations are summed up along the source's documents, one random offset is
added, and a document is taken once for every integer that its step crosses, so
a source's documents are taken as often as expected, to less than one.

So that words come out near the target too, documents stand in order of size,
first every other one upwards and then the rest downwards: neighbours are about
as long, and what the offset adds on the way up it takes off on the way down.
The order and the offset depend on the rows alone, so reruns agree.

Edge rows: a null or blank text has size 0 and is taken as often as any other of
its source; null is a source of its own, the last in order; repeated rows are
rows like others; rows with the same size and id are interchangeable. An empty
table gives an empty one. Other columns ride along in one struct, so no name of
theirs can clash. Everything is DataFrame functions; a hot source spans many
partitions, and its totals meet in one row per partition and source.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.ranks import numbered, placed
from waymesh.session import materialise

#: What separates words: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """sources(source, size), one row each, with weight and target.

    Weights repeat along the sources in code point order, null last. Targets
    share the total size by weight; one above `limit` sizes stops there and the
    excess is shared again among the others, until none is above.
    """
    rows, runs = placed(sources.select(F.lit(0).alias("all"), "source", "size"), "all", [F.col("source").asc_nulls_last()])
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    s = materialise(numbered(rows, runs, "all").select("source", "size", w.cast("long").alias("weight")), "weights")
    wide = lambda x: (F.lit(Decimal(x)) if isinstance(x, int) else F.col(x)).cast("decimal(19,0)")
    total = s.agg(F.sum("size").alias("t"), F.sum("weight").alias("w")).first()
    left, among, stopped = int(total["t"] or 0), int(total["w"] or 0), 0
    over = F.lit(False)
    while among:
        # a share is weight * left / among
        over = wide("size") * wide(limit * among) <= wide("weight") * wide(left)
        got = s.where(over).agg(F.count("*").alias("c"), F.sum("size").alias("s"), F.sum("weight").alias("w")).first()
        if got["c"] == stopped:
            break
        stopped, left, among = got["c"], int(total["t"]) - limit * int(got["s"]), int(total["w"]) - int(got["w"])
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(among or 1))
    return s.withColumn("target", F.when(over if among else F.lit(True), (F.col("size") * limit).cast("double")).otherwise(share))


def offset(source: str, seed: int) -> Column:
    """A number from 0 to 1 by source and seed."""
    name = F.when(F.col(source).isNull(), F.lit(f"{seed}-")).otherwise(F.concat(F.lit(f"{seed}+"), F.col(source)))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 12, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(kept, source, size, source_size, target, copies): every document with how often the mix takes it.

    kept is a struct of the columns `keep`, which are all that is shuffled beside source and size.
    """
    slim = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), F.col(key).alias("tie"))
    rows, runs = placed(slim, "source", [F.col("size").asc(), F.col("tie").asc()])
    by = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, limit)
    by = by.select("source", F.col("size").alias("source_size"), "target")
    r, b = runs.alias("r"), by.alias("b")
    runs = r.join(b, F.col("r.source").eqNullSafe(F.col("b.source"))).select("r.*", "b.source_size", "b.target")
    out = numbered(rows, runs, "source")
    k = F.col("idx") + 1
    place = F.when(k % 2 == 1, F.shiftright(k + 1, 1)).otherwise(F.col("n") - F.shiftright(k, 1) + 1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda p: F.floor(rate * p + offset("source", seed))
    copies = F.least(crossed(place) - crossed(place - 1), F.lit(limit).cast("long"))
    return out.select("kept", "source", "size", "source_size", "target", copies.alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: the kept columns, once per copy, with its number from 1 in `copy`."""
    every = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array().cast("array<bigint>")))
    return mixed.select("kept", every.alias("copy")).select("kept.*", "copy")


def mix_sql(weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 12) -> str:
    """DuckDB SQL of the mix's rows for documents; the level that shares settle at is found among the sources' own ratios."""
    return f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size from documents),
r as (select *, row_number() over (partition by source order by size, doc_id nulls first) as k, count(*) over (partition by source) as n from d),
s as (select source, sum(size)::bigint as size from d group by source),
w as (select source, size, ({list(weights)})[((row_number() over (order by source nulls last) - 1) % {len(weights)} + 1)::int]::bigint as weight from s),
o as (select *, row_number() over (order by size::double / weight, source nulls last) as i, (select sum(size) from w)::bigint as total from w),
c as (select *, (total - coalesce(sum({limit} * size) over (order by i rows between unbounded preceding and 1 preceding), 0))::bigint as rest,
        sum(weight) over (order by i rows between current row and unbounded following)::bigint as among from o),
l as (select rest, among from c where {limit} * size * among > weight * rest order by i limit 1),
t as (select source, size as source_size, case when l.among is null or {limit} * size * l.among <= weight * rest then ({limit} * size)::double else (weight * rest)::double / l.among::double end as target from w left join l on true),
p as (select doc_id, r.size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
        case when k % 2 = 1 then (k + 1) // 2 else n - k // 2 + 1 end as place,
        ('0x' || substr(md5(case when r.source is null then '{seed}-' else '{seed}+' || r.source end), 1, 13))::bigint::double / {2**52}::double as u
      from r join t on r.source is not distinct from t.source)
select doc_id, size, source_size, target, size * least({limit}, (floor(rate * place + u) - floor(rate * (place - 1) + u))::bigint) as taken from p
"""
