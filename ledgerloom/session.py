"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# What results and hot keys depend on, also in a session this package did not build: every day boundary is a
# UTC day, and a join with a hot key is split even when a grouping on the same key follows it.
NEEDED = ("spark.sql.session.timeZone", "spark.sql.adaptive.forceOptimizeSkewedJoin")


def prepare(spark: SparkSession) -> None:
    for key in NEEDED:
        if spark.conf.get(key, None) != SETTINGS[key]:
            spark.conf.set(key, SETTINGS[key])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`.

    Unset, a local master gets a fresh folder of its one machine; on a cluster that is an error, since files
    written to each executor's own disk would be missing from later reads.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


RUN = uuid.uuid4().hex
#: Called with every frame that is settled, before it is written; tests look at plans this way.
WATCHERS: list = []


def run_folder(spark: SparkSession) -> str:
    """This process's own prefix in the shared folder; `clear_run` removes it."""
    return f"{shared_folder(spark).rstrip('/')}/ledgerloom/{RUN}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_run(spark: SparkSession) -> None:
    """Remove what this process settled. Call it once its results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage of iterative work and lets several branches share one computation. The copy is
    columnar, so later branches still prune columns, and it outlives a lost executor. Files stay under
    this process's prefix of the shared folder until `clear_run` or the folder's owner removes them.
    """
    spark = df.sparkSession
    for watch in WATCHERS:
        watch(df)
    path = fresh_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
