"""Run scores kept current as new predictions arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

G = "image_id"


def running_scores(scores: DataFrame, by: tuple[str, ...] = ("run_id",), value: str = "apls") -> DataFrame:
    """Sum, count and mean per group without NaN; for a batch or a stream (complete or update output).

    With an epoch in `by` a run starts anew from nothing in every epoch.
    """
    ok = F.when(~F.isnan(value), F.col(value))
    return scores.groupBy(*by).agg(F.sum(ok).alias("total"), F.count(ok).alias("n"), F.avg(ok).alias("mean"))


def keep_running(scores: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("run_id",), value: str = "apls"):
    """Start a stream that keeps running_scores of arriving scores at path, a folder for each micro-batch; current_scores reads the last."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return running_scores(scores, by, value).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_scores(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last micro-batch that keep_running finished at path; what is being written now doesn't show."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("batch").alias("n")).first()["n"]
    return every.where(F.col("batch") == last).drop("batch")


def whole_graphs(arriving: DataFrame) -> DataFrame:
    """A stream of arriving edges (image_id, ...) as whole graphs: all edges so far of every image that a micro-batch adds to.

    Each image's edges are its state, so an edge is read once; one that comes
    again adds nothing, and an image with nothing new is silent. Columns hold no
    nulls. For update output.
    """
    kinds = {f.name: f.dataType.simpleString() for f in arriving.schema}
    cols = [c for c in arriving.columns if c != G]

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = dict.fromkeys(zip(*(list(c) for c in state.get), strict=True)) if state.exists else {}
        before = len(have)
        for b in batches:
            have.update(dict.fromkeys(zip(*(b[c].tolist() for c in cols), strict=True)))
        if len(have) > before:
            columns = [list(c) for c in zip(*have, strict=True)]
            state.update(tuple(columns))
            yield pd.DataFrame({G: [key[0]] * len(have)} | dict(zip(cols, columns, strict=True)))

    schema = ", ".join(f"{c} {k}" for c, k in {G: kinds[G], **{c: kinds[c] for c in cols}}.items())
    return arriving.groupBy(G).applyInPandasWithState(add, schema, ", ".join(f"{c} array<{kinds[c]}>" for c in cols), "update", GroupStateTimeout.NoTimeout)


def score_on_arrival(arriving: DataFrame, metric: Callable[..., DataFrame], path: str, checkpoint: str, truth: DataFrame | None = None):
    """Start a stream that scores arriving prediction edges (image_id, ...) at path.

    metric takes the whole graphs of the images that a micro-batch adds to, and
    with `truth`, edges that stay, those of the same images; it gives rows
    (image_id, ...). An image with nothing new is skipped, one without a row of
    the metric gets a null row. A batch that is run again overwrites its own
    folders, and the checkpoint holds the images' edges, so a restart goes on
    where it stopped.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{path}/graphs/batch={n}")
        whole = spark.read.schema(df.schema).parquet(f"{path}/graphs/batch={n}")
        touched = whole.select(G).distinct()
        score = metric(whole) if truth is None else metric(whole, truth.join(touched, G, "left_semi"))
        touched.join(score, G, "left").write.mode("overwrite").parquet(f"{path}/scores/batch={n}")

    return whole_graphs(arriving).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scores(spark: SparkSession, path: str) -> DataFrame:
    """The last score of every image that score_on_arrival wrote at path."""
    w = Window.partitionBy(G).orderBy(F.desc("batch"))
    return spark.read.parquet(f"{path}/scores").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")
