"""Tables written to the shared folder of the cluster, to be computed once and to survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; all executors can reach it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder.rstrip("/")


def packed(names: list[str]) -> Column:
    """The columns as one struct, with a field more, so that it is never empty, whose name none of them has."""
    spare = "_"
    while spare.lower() in {n.lower() for n in names}:
        spare += "_"
    return F.struct(F.lit(0).alias(spare), *[F.col(quoted(n)) for n in names])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/boxoffice-llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: later plans start from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles():
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return
