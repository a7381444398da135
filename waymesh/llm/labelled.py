"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, target: str, mod: int, remainder: int, most: int, longest: int = 50_000) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows that are not held out, by a hash of doc_id, for texts of at most `longest` characters.

    Both bounds limit what a fit gathers. Contradictory labels of one doc_id
    count as their maximum, of several texts of one doc_id the smallest is
    taken; rows without a label are left out, null texts count as empty.
    """
    y = labels.where(F.col(target).isNotNull() & ~held_out(F.col("doc_id"), mod, remainder)).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def by_size(texts: list[str | None], most: int = 1 << 19, rows: int = 500) -> list[slice]:
    """Runs of texts of at most `most` characters and `rows` rows; a longer text is alone."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and (size + n > most or i - lo >= rows):
            out.append(slice(lo, i))
            lo, size = i, 0
        size += n
    return [*out, slice(lo, len(texts))] if lo < len(texts) else out
