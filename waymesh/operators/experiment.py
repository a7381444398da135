"""Batches, epoch means, checkpoint selection and model scoring of tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_batches(items: DataFrame, key: str, epochs: list[int], size: int, seed: int | None = 0, drop_last: bool = True, shards: int = 64) -> DataFrame:
    """items with epoch, batch and slot: shuffled by a seeded hash (None: in key order), batches of `size`.

    Numbers run within hash shards whose sizes are counted first, so no task
    orders all items.
    """
    e = items.withColumn("epoch", F.explode(F.array(*(F.lit(x) for x in epochs))))
    if seed is None:
        ends = items.agg(F.percentile_approx(key, [i / shards for i in range(1, shards)], 10_000).alias("q")).first()["q"] or []
        e = e.withColumn("_o", F.col(key).cast("long")).withColumn("_s", sum((F.when(F.col(key) > x, 1).otherwise(0) for x in sorted(set(ends))), F.lit(0)))
    else:
        e = e.withColumn("_o", F.xxhash64(F.lit(seed), "epoch", key)).withColumn("_s", F.shiftrightunsigned("_o", 64 - (shards - 1).bit_length()) if shards > 1 else F.lit(0))
        e = e.withColumn("_o", F.expr("_o ^ -9223372036854775808"))  # unsigned order
    sizes = e.groupBy("epoch", "_s").agg(F.count("*").alias("c"))  # at most epochs x shards rows
    before = sizes.select("epoch", "_s", "c", F.coalesce(F.sum("c").over(Window.partitionBy("epoch").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("c").over(Window.partitionBy("epoch")).alias("all"))
    n = F.row_number().over(Window.partitionBy("epoch", "_s").orderBy("_o", key)) - 1
    got = e.withColumn("_n", n).join(F.broadcast(before), ["epoch", "_s"]).withColumn("_n", F.col("_n") + F.col("b"))
    if drop_last:
        got = got.where(F.col("_n") < F.floor(F.col("all") / size) * size)
    return got.withColumns({"batch": F.floor(F.col("_n") / size), "slot": (F.col("_n") % size).cast("int")}).drop("_o", "_s", "_n", "b", "c", "all")


def epoch_means(log: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means of loss parts per group."""
    return log.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))


def best_checkpoints(log: DataFrame, run: str, epoch: str, score: str, every: int, start: int) -> DataFrame:
    """Epochs at which the score, looked at every `every` epochs from `start`, beats all before (and -999)."""
    seen = log.where((F.col(epoch) >= start) & (F.col(epoch) % every == 0))
    before = F.coalesce(F.max(score).over(Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(-999.0))
    return seen.withColumn("_b", before).where(F.col(score) > F.col("_b")).drop("_b")


def score_tiles(tiles: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of any pandas model over batches of tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model(b)

    return tiles.mapInPandas(run, schema)
