"""Session settings the library is written for. A cluster normally sets these itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Broadcasts: an estimate from compressed files may be far below the size in memory, so it must be
# small; what a finished shuffle has measured may be larger.
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "2MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "boxoffice", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``), also set as checkpoint folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, with the size that it has."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/boxoffice/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Removes the files of a staged frame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {spark._jvm.org.apache.hadoop.fs.Path(file).getParent().toString() for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
