"""Session helpers: the shared folder, written intermediate tables, pairs within groups."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 512
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    In local mode, where all executors are this machine, a temporary folder is taken if the setting is
    empty. On a cluster an empty setting raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is deleted when the application ends."""
    path = os.path.join(shared_dir(spark), f"run-{spark.sparkContext.applicationId}")
    system, target = file_system(spark, path)
    if not system.exists(target):
        system.mkdirs(target)
        system.deleteOnExit(target)
    return path


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of ``path`` and the path in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def table_path(spark: SparkSession, name: str) -> str:
    return os.path.join(run_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the queries run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, executors may be lost.

    With ``release``, Spark deletes the shuffle files of the write as soon as it has ended, which bounds the disk
    that a chain of large writes needs.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    with settings(spark, {_CLEANUP: "true"} if release else {}):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, whatever is lost later."""
    for df in tables:
        if path := getattr(df, "_newsloom_path", None):
            system, target = file_system(df.sparkSession, path)
            system.delete(target, True)


def pairs_within(rows: DataFrame, keys: list[str], values: list[str], test: Column, block: int = BLOCK) -> DataFrame:
    """``a.*, b.*`` (``values`` as ``a_...`` and ``b_...``) of unordered pairs of rows that agree in ``keys``.

    A group of more than ``block`` rows is divided into blocks by a hash of its rows, and two blocks (or one
    with itself) are a join key, so that a task compares at most block * block rows a key however large
    the group is; a group's rows are copied once a block. Every pair of different rows meets once, in
    either order, and is kept if ``test`` holds. Rows must be distinct. Null keys pair nothing.
    """
    hot = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")), "hot-groups")
    spread = rows.join(hot, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    spread = spread.withColumn("_at", F.pmod(F.xxhash64(*values), F.col("_blocks")).cast("int"))
    left = spread.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.col("_at").alias("_i"), F.explode(F.sequence("_at", F.col("_blocks") - 1)).alias("_j"))
    right = spread.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.explode(F.sequence(F.lit(0), "_at")).alias("_i"), F.col("_at").alias("_j"))
    order = F.struct(*(F.col(f"a_{v}") for v in values)) < F.struct(*(F.col(f"b_{v}") for v in values))
    return left.join(right, [*keys, "_i", "_j"]).where(((F.col("_i") < F.col("_j")) | order) & test).drop("_i", "_j")


def expand_links(links: DataFrame, members: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``keys, x, y``: members of ``a`` and of ``b`` for each link (keys, a, b); members are (keys, group, id).

    A group of more than ``block`` members is met block by block, so that no task writes all pairs of
    two large groups.
    """
    hot = materialize(members.groupBy(*keys, "group").agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(*keys, "group", F.ceil(F.col("_n") / block).cast("int").alias("_blocks")), "hot-groups")
    blocks = F.coalesce("_blocks", F.lit(1))
    right = members.join(hot, [*keys, "group"], "left").select(*keys, F.col("group").alias("b"), F.col("id").alias("y"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("_at"))
    left = links.join(hot.withColumnRenamed("group", "b"), [*keys, "b"], "left").select(*keys, "a", "b", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_at"))
    left = left.join(members.select(*keys, F.col("group").alias("a"), F.col("id").alias("x")), [*keys, "a"])
    return left.join(right, [*keys, "b", "_at"]).select(*keys, "x", "y")
