"""The session: settings that the operators count on, and checkpoints in the shared folder."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table up to which it is broadcast.
BROADCAST_ROWS = 100_000

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(name: str = "sheaf", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, where it isn't installed on them."""
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:  # the driver's own: Spark serves its copy of the archive from there on
        archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder in spark.checkpoint.dir; one on this machine only where none is set and there is no other."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="sheaf-checkpoint-")
        context.setCheckpointDir(shared)
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage into the folder of spark.checkpoint.dir; one of its own only on one machine where none is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Nodes of a plan under which the number of partitions is known without running anything.
_NARROW = frozenset(["Project", "Filter", "Generate", "MapInArrow", "MapInPandas", "Union", "SubqueryAlias", "LogicalRelation", "LogicalRDD", "LocalRelation", "ExternalRDD", "Range", "ResolvedHint"])


def _narrow(plan) -> bool:
    children = plan.children()
    return plan.nodeName().split(" ")[0] in _NARROW and all(_narrow(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work that is far dearer than a shuffle of its rows; as it is where it has partitions enough.

    Only plans without a shuffle or broadcast are looked at, as counting the partitions of others would run them.
    """
    if df.isStreaming:
        return df
    execution = df._jdf.queryExecution()
    if not _narrow(execution.optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows, which is counted; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
