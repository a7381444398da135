"""Document fingerprints from a Merkle tree over sections, paragraphs and chunks.

A text is cut into sections at blank lines, a section into paragraphs at line
ends, and a paragraph into chunks of words that end where a hash of the last
bytes says so, so that an edit moves only the chunk ends near it. A node's hash
covers the hashes below it and the bytes between, so roots are equal exactly
for equal texts (up to a 128-bit collision).

A fingerprint is the root and a bottom-k sketch of the chunk hashes: at most
k of them, so its size has a bound. Likeness compares all chunks of two trees,
and differing branches are found from the root down.

Null texts count as empty; the empty text has a tree of one empty chunk. Rows
repeated under one doc_id are ordered by their text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest as _h

def _cuts(data: bytes, mean: int, most: int) -> np.ndarray:
    """Ends of the chunks of a text: behind every line end, behind spaces whose three bytes before hash to 0 modulo `mean`, and `most` words after the last end."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((b == 32) | (b == 10))
    if not len(at):
        return np.array([len(data)])
    p = np.concatenate([np.zeros(3, np.uint32), b])
    mixed = (p[at] << np.uint32(16) | p[at + 1] << np.uint32(8) | p[at + 2]) * np.uint32(2654435761)
    end = (b[at] == 10) | ((mixed >> np.uint32(12)) % np.uint32(mean) == 0)
    i = np.arange(len(at))
    last = np.r_[-1, np.maximum.accumulate(np.where(end, i, -1))[:-1]]
    end |= (i - last) % most == 0
    cuts = at[end] + 1
    return cuts if len(cuts) and cuts[-1] == len(data) else np.r_[cuts, len(data)]


def tree(text: str | None, mean: int = 5, most: int = 24) -> tuple[bytes, list[tuple[bytes, list[tuple[bytes, list[bytes]]]]]]:
    """(root, sections), a section being (hash, paragraphs) and a paragraph (hash, chunk hashes).

    A paragraph is a line with its end; a blank line ends a section.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    sections, run, leaves, start, head = [], [], [], 0, 0
    cuts = _cuts(data, mean, most).tolist()
    for end in cuts:
        leaves.append(_h(data[start:end]))
        start = end
        if end == len(data) or data[end - 1] == 10:
            run.append((_h(b"p" + b"".join(leaves)), leaves))
            if end == len(data) or data[head:end].isspace():
                sections.append((_h(b"s" + b"".join(x for x, _ in run)), run))
                run = []
            leaves, head = [], end
    return _h(b"r" + b"".join(x for x, _ in sections)), sections


def fingerprint(text: str | None, k: int = 96) -> str:
    """Root (32 hex digits) and, after a dash, the k smallest chunk hashes (8 hex digits each)."""
    return _sketch(tree(text), k)


def _sketch(made: tuple, k: int) -> str:
    """The fingerprint of a tree."""
    root, sections = made
    seen: dict[bytes, int] = {}
    marks = set()
    for x in _leaves(sections):
        if x in seen:  # a repeat counts by its number
            seen[x] += 1
            marks.add(_h(x + seen[x].to_bytes(4, "little"))[:4])
        else:
            seen[x] = 0
            marks.add(x[:4])
    return f"{root.hex()}-{b''.join(sorted(marks)[:k]).hex()}"


def _leaves(sections: list) -> list[bytes]:
    return [x for _, ps in sections for _, ls in ps for x in ls]


def _shared(x: list[bytes], y: list[bytes]) -> int:
    """How many hashes two lists share, repeats counted."""
    a, b = set(x), set(y)
    if len(a) == len(x) or len(b) == len(y):
        return len(a & b)
    return (Counter(x) & Counter(y)).total()


def likeness(a: tuple, b: tuple) -> float:
    """Share of chunks in common (twice the shared ones by both counts) of two trees; 1 for equal roots only.

    Where unequal texts have all chunks in common, the nodes above them count too.
    """
    if a[0] == b[0]:
        return 1.0
    x, y = _leaves(a[1]), _leaves(b[1])
    both = _shared(x, y)
    if 2 * both == len(x) + len(y):
        for t, z in ((a, x), (b, y)):
            z += [t[0], *(h for h, _ in t[1]), *(p for _, ps in t[1] for p, _ in ps)]
        both = _shared(x, y)
    return 2 * both / (len(x) + len(y))


def branches(a: tuple, b: tuple) -> list[str]:
    """Sections ("3") and paragraphs ("3/0") by place that differ between two trees; equal branches are not entered."""
    out: list[str] = []
    if a[0] == b[0]:
        return out
    for i, (x, y) in enumerate(zip_longest(a[1], b[1], fillvalue=(b"", []))):
        if x[0] != y[0]:
            out.append(str(i))
            out += [f"{i}/{j}" for j, (p, q) in enumerate(zip_longest(x[1], y[1], fillvalue=(b"", []))) if p[0] != q[0]]
    return out


def fingerprints(text: Column, k: int = 96) -> Column:
    """Column of fingerprints."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t, k) for t in s])

    return run(text)


def merkle_nodes(docs: DataFrame) -> DataFrame:
    """All nodes of all trees: doc_id, level (0 root, 1 section, 2 paragraph), section, paragraph, hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                root, sections = tree(t)
                rows.append((d, 0, None, None, root.hex()))
                for i, (h, ps) in enumerate(sections):
                    rows.append((d, 1, i, None, h.hex()))
                    rows += [(d, 2, i, j, p.hex()) for j, (p, _) in enumerate(ps)]
            yield pd.DataFrame(rows, columns=["doc_id", "level", "section", "paragraph", "hash"]).astype({"section": "Int32", "paragraph": "Int32"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, level int, section int, paragraph int, hash string")
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))


def differing_branches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Branches of merkle_nodes tables a and b that differ, per doc_id: where an edit lies."""
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "level", "section", "paragraph")]
    both = a.alias("a").join(b.alias("b"), on[0] & on[1] & on[2] & on[3], "full_outer")
    pick = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("doc_id", "level", "section", "paragraph")]
    return both.where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select(*pick, F.col("a.hash").alias("before"), F.col("b.hash").alias("after"))


def _heads(docs: DataFrame, parts: int) -> list[int]:
    """Upper ends of about `parts` ranges of doc_id, from the highest down, each an id that exists."""
    marks = docs.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts + 1)], 10_000).alias("q")).first()["q"]
    return sorted(set(marks or []), reverse=True)


def _even(sizes: list[int], parts: int) -> list[int]:
    """Which of about `parts` runs each of some sizes in a row belongs to, all runs about as large."""
    out, run, full, share = [], 0, 0, sum(sizes) / max(parts, 1)
    for n in sizes:
        if full and full + n / 2 > share:
            run, full = run + 1, 0
        out.append(run)
        full += n
    return out


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the next row by descending doc_id, the first one's after the last.

    Ranges of doc_id, eight times as many as partitions, are put together to
    partitions of about as many bytes each; the row that heads a partition is
    also sent to the one before it, so no row waits for another partition. Rows
    without a doc_id come last.
    """
    spark = docs.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    heads = _heads(docs, 8 * parts)
    n = len(heads)
    bounds = F.array(*(F.lit(h) for h in heads)) if heads else F.array().cast("array<bigint>")
    # range r holds heads[r] >= doc_id > heads[r + 1]; ids above heads[0] (a rounded maximum) join range 0, nulls the last
    r = F.when(F.col("doc_id").isNull(), max(n - 1, 0)).otherwise(F.greatest(F.size(F.filter(bounds, lambda h: h >= F.col("doc_id"))) - 1, F.lit(0)))
    placed = docs.withColumn("range", r.cast("int"))
    first = placed.groupBy("range").agg(F.max("doc_id").alias("top"), F.sum(F.octet_length("text") + 64).alias("bytes")).collect()  # one row per range
    first.sort(key=lambda x: x["range"])
    part_of = dict(zip([x["range"] for x in first], _even([x["bytes"] for x in first], parts), strict=True))
    tops: dict[int, int | None] = {}
    for x in first:
        tops.setdefault(part_of[x["range"]], x["top"])
    order = sorted(tops)
    table = lambda pairs, kind: F.create_map(*(F.lit(v) for kv in pairs for v in kv)).cast(f"map<int,{kind}>") if order else F.create_map().cast(f"map<int,{kind}>")
    part = F.element_at(table(part_of.items(), "int"), F.col("range"))
    placed = placed.withColumn("part", part)
    # (part, top id) -> part that also needs it; one small map entry per part
    is_top = F.col("doc_id").eqNullSafe(F.element_at(table(tops.items(), "bigint"), F.col("part")))
    send = F.element_at(table([(p, order[i - 1]) for i, p in enumerate(order)], "int"), F.col("part"))
    own, ahead = F.struct("part", F.lit(False).alias("ahead")), F.struct(send.alias("part"), F.lit(True).alias("ahead"))
    dealt = placed.select("doc_id", "text", F.explode(F.when(is_top, F.array(own, ahead)).otherwise(F.array(own))).alias("p")).select("doc_id", "text", "p.part", "p.ahead")
    ordered = dealt.repartitionById(max(len(order), 1), "part").sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), "text")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, closed = None, None
        for b in batches:
            rows = []
            for row in b.itertuples(index=False, name=None):
                if held is not None and held[2] == row[2] and closed != row[2]:
                    rows.append((held[0], held[1], row[1]))
                if row[3]:
                    closed = row[2]  # the first row sent ahead ends its part; more are its repeats
                held = row
            yield pd.DataFrame(rows, columns=["doc_id", "text", "next_text"])

    # an id travels as text: pandas would make floats of integers next to a null
    return ordered.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(pair, "doc_id string, text string, next_text string")


def edited_likeness(docs: DataFrame, k: int = 96, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text (its last third replaced from the next document) and their likeness; `branches` of the two trees that differ."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for b in batches:
            rows, last = [], ("", tree(""))
            for d, t, nxt in b.itertuples(index=False, name=None):
                m = len(t) // 3
                e = t[: len(t) - m] + nxt[:m]
                own = last[1] if last[0] == t else tree(t)
                last = (nxt, tree(nxt))
                edited = tree(e)
                rows.append((d, len(t), sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), _sketch(own, k), _sketch(edited, k), likeness(own, edited), likeness(own, last[1]), branches(own, edited)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "branches"])

    got = with_next(docs, parts).mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, branches array<string>")
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))
