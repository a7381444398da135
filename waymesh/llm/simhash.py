"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into a ring of m segments. If two fingerprints differ in
at most t bits, some start on the ring has every chain of l consecutive
segments from it differ in at most floor(l * t / m) bits. The chains whose
budget is zero give an equality key of several segments; fingerprints that
share a key are candidates, pass the whole sequence of chain budgets, and only
then the full Hamming check.

Equal fingerprints are one node from the start, so copies never meet in a
bucket. A bucket of more than `cap` different fingerprints is not paired:
its members are linked through their one-bit variants instead (two
fingerprints within two bits share a variant), which is exact and linear.

Null texts count as empty; texts without words get fingerprint zero, which
links like any other; rows are never dropped, and each row repeated under one
doc_id gets the component of its own text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.components import connected_components
from waymesh.session import materialise

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest as h64

    words = _WORD.findall((text or "").translate(_LOWER) if text and not text.islower() else text or "")
    if not words:
        return 0
    grams = map(" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [" ".join(words)]
    h = np.fromiter((h64(g, seed) for g in grams), np.uint64)
    octets = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """Column of fingerprints, as signed longs of the same 64 bits."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([simhash(t, size) for t in s], np.uint64).view(np.int64))

    return run(text)


def _ring_keys(fp: Column, m: int, t: int) -> Column:
    """Array of (start, key): the segments whose chains have no budget, from each start."""
    width, run = 64 // m, (m - 1) // t if t else m
    mask = (1 << (width * run)) - 1
    keys = []
    for i in range(m):
        s = i * width
        turned = fp if s == 0 else F.shiftrightunsigned(fp, s).bitwiseOR(F.shiftleft(fp, 64 - s))
        keys.append(F.struct(F.lit(i).alias("start"), turned.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*keys)


def _links_of(fps: np.ndarray, start: int, m: int, t: int) -> list[tuple[int, int]]:
    """Links within one bucket: chain budgets first, then the full Hamming check."""
    u = fps.view(np.uint64)
    x = u[:, None] ^ u[None, :]
    width = 64 // m
    s = np.uint64(start * width)
    x = (x >> s) | (x << np.uint64((64 - start * width) % 64)) if start else x
    ok = np.triu(np.ones(x.shape, bool), 1)
    total = np.zeros(x.shape, np.int64)
    for l in range(m):
        seg = (x >> np.uint64(l * width)) & np.uint64((1 << width) - 1)
        total += np.bitwise_count(seg)
        ok &= total <= (l + 1) * t // m
    ok &= np.bitwise_count(x) <= t
    a, b = np.nonzero(ok)
    return list(zip(fps[a].tolist(), fps[b].tolist(), strict=True))


def fingerprint_links(fps: DataFrame, t: int = 2, m: int = 16, cap: int = 48) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints `fp` differing in at most t bits.

    Every two fingerprints within t bits are joined by a path of these links,
    and every link is within t bits of a shared variant at most.
    """
    if t != 2 or 64 % m:
        raise ValueError("t is 2 and m divides 64")
    keyed = fps.select("fp", F.explode(_ring_keys(F.col("fp"), m, t)).alias("k")).select("fp", "k.start", "k.key").repartition("start", "key")
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = keyed.join(sizes, ["start", "key"])

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            links = [p for s, f in zip(b["start"], b["fps"], strict=True) for p in _links_of(np.asarray(f, np.int64), int(s), m, t)]
            yield pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["u", "v"])

    few = crowded.where(F.col("n") <= cap).groupBy("start", "key").agg(F.collect_list("fp").alias("fps"))
    near = few.mapInPandas(pair, "u long, v long")
    many = crowded.where(F.col("n") > cap).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("1L").cast("long") * 0 + F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    variants = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    heads = variants.groupBy("variant").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("variant", "low")
    far = variants.join(heads, "variant").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    return near.union(far).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, t: int = 2, m: int = 16, cap: int = 48) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) per row of docs."""
    prints = materialise(docs.select("doc_id", fingerprint(F.col("text"), size).alias("fp")), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comps = connected_components(fingerprint_links(nodes.select("fp"), t, m, cap))
    joined = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = joined.join(lows, "component").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = 3, t: int = 2, m: int = 16, cap: int = 48) -> DataFrame:
    """docs with one row of each component left: that of the smallest doc_id.

    Rows without a doc_id and rows repeated under one are judged like any other:
    of equal ones one stays, and a component without any doc_id keeps one row.
    """
    prints = materialise(docs.select("doc_id", fingerprint(F.col("text"), size).alias("_fp"), F.struct("*").alias("row")), "simhash")
    nodes = prints.groupBy("_fp").agg(F.min("doc_id").alias("rep"))
    comps = connected_components(fingerprint_links(nodes.select(F.col("_fp").alias("fp")), t, m, cap))
    joined = nodes.join(comps.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("_component", F.coalesce("component", "_fp"))
    lows = joined.groupBy("_component").agg(F.min("rep").alias("_low"))
    named = prints.join(joined.join(lows, "_component").select("_fp", "_component", "_low"), "_fp")
    return named.where(F.col("doc_id").eqNullSafe(F.col("_low"))).dropDuplicates(["_component"]).select("row.*")
