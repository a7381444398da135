"""Places of rows within their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.session import materialise


def placed(rows: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with part and at, and runs(group, part, first, before, n): a row is number `before + at - first` (from 0) of its group's n.

    Rows are dealt to even ranges of (group, order), so no task holds a group
    and a hot one spans many parts. A number given to every row when it is first
    written splits rows that are alike in all of that. A run is what one part
    holds of one group: there are at most as many as parts and groups together.
    Column names number, part, at, first, before and n are taken.
    """
    tagged = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
    keys = [F.col(group).asc_nulls_first(), *order, F.col("number").asc()]
    dealt = tagged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("number")
    # the id of a row holds its partition in the upper bits and its place there in the lower 33
    out = materialise(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ranged")
    runs = out.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    runs = runs.select(group, "part", "first", (F.sum("rows").over(whole.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(whole).alias("n"))
    return out, materialise(runs, "runs")


def numbered(rows: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """Rows of placed() with idx and the other columns of their run."""
    r, w = rows.alias("r"), runs.alias("w")
    both = r.join(w, F.col(f"r.{group}").eqNullSafe(F.col(f"w.{group}")) & (F.col("r.part") == F.col("w.part")))
    own = [F.col(f"r.{c}") for c in rows.columns if c not in ("part", "at")]
    more = [F.col(f"w.{c}") for c in runs.columns if c not in (group, "part", "first", "before")]
    return both.select(*own, (F.col("w.before") + F.col("r.at") - F.col("w.first")).alias("idx"), *more)
