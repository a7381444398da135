"""Session helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that setting is absent a folder of this machine is made and set once,
    with a local master (tests, one machine) only; a cluster has to name one.
    """
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(conf or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Bytes of files up to which a table is broadcast on the strength of their size alone.
BROADCAST = 256 * 1024


def trust_no_file_sizes(spark: SparkSession) -> None:
    """Lower the session's broadcast threshold to BROADCAST, unless it is lower already.

    Spark takes the size of Parquet files for that of their rows. Pixels and
    edges are a byte or so a row on disk and over a hundred in a join's table,
    so by Spark's 10 MB a driver would have to build tables of a gigabyte.
    Tables that code asks to broadcast are not touched.
    """
    key = "spark.sql.autoBroadcastJoinThreshold"
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?).*", spark.conf.get(key).lower()).groups()
    if int(number) << 10 * "bkmgtp".index(unit or "b") > BROADCAST:
        spark.conf.set(key, str(BROADCAST))


def trust_no_unions(spark: SparkSession) -> None:
    """Let the session shuffle a union again before a step by key, even where both sides are dealt by that key.

    Spark 4.1 takes such a union for dealt by the key and drops the shuffle, but
    adaptive execution then closes up each side's parts by its own sizes. From
    some size on rows of one key lie in different tasks and never meet.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    trust_no_file_sizes(df.sparkSession)
    trust_no_unions(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage and size estimates.

    checkpoint() keeps the estimate of the plan that it ends, and joins multiply
    estimates, so in loops they grow to numbers of millions of digits that take
    longer than the data. A written table has the size of its files.
    """
    return materialise(df, "cut")


def dealt(df: DataFrame, rows: int, *keys: str, of: DataFrame | None = None, each: int = 1) -> DataFrame:
    """df dealt by keys over tasks of about `rows` rows, for steps that make many rows of one; at least one task a core.

    Spark cuts a shuffle by the bytes that come in, so such a step's tasks would
    grow with the table. of: a table with `each` times fewer rows, to count instead.
    """
    n = -(-(df if of is None else of).count() * each // rows)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)
