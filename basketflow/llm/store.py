"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset a temporary one, on a local master only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="basketflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df, written as Parquet to the shared folder and reread; cuts the lineage. narrow: rows of a few numbers, put together in files of Spark's advisory size first."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """df, kept on the executors' disks for an operator that reads it more than once and unpersists it; what a lost executor held is worked out again."""
    return df.persist(StorageLevel.DISK_ONLY)


def forget(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with as many _ before them as no column of df has."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
