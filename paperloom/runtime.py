"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast; it is counted first, and beyond that the same join is shuffled.
BROADCAST_ROWS = 200_000

#: Cluster-friendly defaults; a session that already exists keeps its own.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "paperloom", **conf: str) -> SparkSession:
    """A session with SESSION_CONF; keyword arguments use `__` for `.` in a key."""
    builder = SparkSession.builder.appName(app)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` by a reliable checkpoint in the cluster's shared folder.

    The folder is the session's `spark.checkpoint.dir`. Only a local session without it gets a folder of our
    own, which is removed at the end; on a cluster such a folder would be lost with its machine, so it is refused.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not is_local(sc):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="paperloom-")
            atexit.register(shutil.rmtree, shared, True)
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def small(df: DataFrame, at_most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, checkpointed, for a broadcast join if it is counted small, else as it is for a shuffled one."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= at_most else df


def is_local(sc: SparkContext) -> bool:
    return sc.master == "local" or sc.master.startswith("local[")


def once_each(df: DataFrame, key: str, at_most: int = BROADCAST_ROWS) -> DataFrame:
    """One row per `key`; rows of one key are repeated deliveries that differ only in arrival.

    Only the keys are grouped to find those that came more than once. Up to `at_most` of them are broadcast, and
    only their rows are shuffled; beyond that all rows are.
    """
    again = df.groupBy(key).count().where("count > 1").select(F.col(key).alias("__again")).cache()
    if again.count() > at_most:
        return df.dropDuplicates([key])
    same = F.col(key).eqNullSafe(F.col("__again"))
    return df.join(F.broadcast(again), same, "left_anti").unionByName(df.join(F.broadcast(again), same, "left_semi").dropDuplicates([key]))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for a session; a local session needs no copy.

    Executors that have it on their path already lose nothing by it.
    """
    sc = spark.sparkContext
    if is_local(sc) or getattr(sc, "_paperloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="paperloom-"), "paperloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("paperloom", os.path.relpath(full, root)))
    sc.addPyFile(path)  # served by the driver
    sc._paperloom_shipped = True
