"""Readers and writers of road GeoJSON, dataset JSON, score lines and forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.session import dealt

GEOJSON = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
DATASET = "dataset_info array<struct<image_name:string,height:int,width:int,keypoints:array<struct<location:array<double>,directions:array<double>>>>>"


def read_geojson(spark: SparkSession, path: str, types: tuple[str, ...] = ("LineString", "MultiLineString")) -> DataFrame:
    """(file, road_id, part, seq, lon, lat) of road files; another geometry type is an error."""
    raw = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), F.posexplode("features").alias("road_id", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.array(F.from_json(text, "array<array<double>>"))
    many = F.from_json(text, "array<array<array<double>>>")
    parts = F.when(~kind.isin(*types), F.raise_error(F.concat(F.lit("unexpected geometry type "), kind)).cast("array<array<array<double>>>")).when(kind == "LineString", one).otherwise(many)
    p = raw.select("file", "road_id", F.posexplode(parts).alias("part", "line")).select("file", "road_id", "part", F.posexplode("line").alias("seq", "c"))
    return p.select("file", "road_id", "part", "seq", F.get("c", F.lit(0)).alias("lon"), F.get("c", F.lit(1)).alias("lat"))


def read_dataset_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(image_name, height, width, kp_seq, x, y, flat) of dataset files: one document each, or with `lines` one on every line, as written below."""
    rec = spark.read.schema(DATASET).option("multiLine", not lines).json(path).select(F.explode("dataset_info").alias("r"))
    k = rec.select("r.image_name", "r.height", "r.width", F.posexplode("r.keypoints").alias("kp_seq", "k"))
    return k.select("image_name", "height", "width", "kp_seq", F.get("k.location", F.lit(0)).alias("x"), F.get("k.location", F.lit(1)).alias("y"), F.col("k.directions").alias("flat"))


def write_dataset_json(keypoints: DataFrame, path: str) -> None:
    """The same, one record per image and file line, keypoints in order."""
    kp = F.struct("kp_seq", F.array("x", "y").alias("location"), F.col("flat").alias("directions"))
    rec = keypoints.groupBy("image_name", "height", "width").agg(F.sort_array(F.collect_list(kp)).alias("k"))
    one = F.struct("image_name", "height", "width", F.transform("k", lambda x: F.struct(x["location"].alias("location"), x["directions"].alias("directions"))).alias("keypoints"))
    rec.select(F.array(one).alias("dataset_info")).write.option("ignoreNullFields", False).json(path)


def pair_inputs(pred: DataFrame, truth: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys on both sides, and those of one side only."""
    a, b = pred.select(key).distinct(), truth.select(key).distinct()
    lone = a.join(b, key, "left_anti").withColumn("side", F.lit("pred")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("truth")))
    return a.join(b, key, "left_semi"), lone


def unscored(items: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a score yet."""
    return items.join(scores.select(*keys).distinct(), keys, "left_anti")


def score_lines(scores: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """(image_id, line): three numbers in fixed notation."""
    return scores.select("image_id", F.format_string("%f %f %f", a, b, c).alias("line"))


def parse_path_line(line) -> F.Column:
    """The last number of a path-score line; null where it isn't one."""
    return F.element_at(F.split(F.trim(line), " +"), -1).try_cast("double")


def parse_topology_line(line) -> tuple[F.Column, F.Column]:
    """precision and recall of a line; zeros where absent."""
    get = lambda k: F.coalesce(F.regexp_extract(line, rf"{k}=([-+.0-9eE]+|[nN]a[nN])", 1).try_cast("double"), F.lit(0.0))
    return get("precision"), get("recall")


def write_scores(scores: DataFrame, path: str, batch: str) -> None:
    """Add scores(run_id, ...) as Parquet by run, under the name of their batch.

    Tasks write aside and files show when the job commits. A batch that is
    written again, after a failure or twice, takes the place of what its runs
    had under that name, so no row is there twice; other batches stay.
    """
    _committed(scores.withColumn("batch", F.lit(batch))).partitionBy("run_id", "batch").parquet(path)


def _committed(rows: DataFrame):
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")


def forest_edges(forest: DataFrame, region: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Directed edges (n1, n2, lat1, lon1, lat2, lon2) from parents to nodes within a region, and terminal nodes (node).

    forest: (tree_id, id, parent, lat, lon, sim_tree, sim_id, out_region). A
    node is (t, i). A node that is similar to another stands for it, as a child
    only: the parent of an edge is always the tree's own node. The region is
    asked of the child; the parent of a node that leaves it is a terminal.
    """
    lo_lat, lo_lon, hi_lat, hi_lon = region
    place = forest.select("tree_id", "id", "lat", "lon")
    kept = forest.where(F.col("lat").between(lo_lat, hi_lat) & F.col("lon").between(lo_lon, hi_lon))
    up = place.toDF("tree_id", "parent", "lat1", "lon1")
    like = place.toDF("sim_tree", "sim_id", "lats", "lons")
    # edges of a parent meet where they are made unique, in tasks of a bounded number of rows
    keys = ["tree_id", "parent"]
    e = dealt(kept.join(like, ["sim_tree", "sim_id"], "left"), 500_000, *keys, of=forest).join(dealt(up, 500_000, *keys, of=forest), keys)
    node = lambda t, i: F.struct(F.col(t).alias("t"), F.col(i).alias("i"))
    own = F.col("sim_tree").isNull()
    other = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    e = e.select(*keys, other("tree_id", "sim_tree").alias("t2"), other("id", "sim_id").alias("i2"), "lat1", "lon1", other("lat", "lats").alias("lat2"), other("lon", "lons").alias("lon2"))
    places = ["lat1", "lon1", "lat2", "lon2"]
    edges = e.groupBy(*keys, "t2", "i2").agg(*(F.min(c).alias(c) for c in places))
    ends = kept.where("out_region = 1").select(node("tree_id", "parent").alias("node")).distinct()
    return edges.select(node(*keys).alias("n1"), node("t2", "i2").alias("n2"), *places), ends


def append_summary(summary: DataFrame, path: str, batch: str) -> None:
    """Add summary rows as lines of `name: value` text, under the name of their batch; committed as write_scores."""
    _committed(summary.select(F.concat_ws(": ", "name", F.col("value").cast("string")).alias("value"), F.lit(batch).alias("batch"))).partitionBy("batch").text(path)


def read_tiles(spark: SparkSession, path: str, bands: int = 3) -> DataFrame:
    """(file, row_, col_, band0, ...) of raster tiles in .npy files of shape (rows, columns[, bands]); another shape or a pickled file is an error."""
    names = [f"band{k}" for k in range(bands)]

    def pixels(batches):
        import io as _bytes

        import numpy as np
        import pandas as pd

        for b in batches:
            for f, data in zip(b["path"], b["content"], strict=True):
                a = np.load(_bytes.BytesIO(data), allow_pickle=False)
                a = a[:, :, None] if a.ndim == 2 else a
                if a.ndim != 3 or a.shape[2] != bands:
                    raise ValueError(f"{f} has shape {a.shape}, not (rows, columns, {bands})")
                r, c = np.indices(a.shape[:2])
                yield pd.DataFrame({"file": f, "row_": r.ravel(), "col_": c.ravel(), **{n: a[:, :, k].ravel().astype(float) for k, n in enumerate(names)}})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(pixels, "file string, row_ int, col_ int, " + ", ".join(f"{n} double" for n in names))
