"""Nightly tables by version: written aside, renamed into place, published by a pointer."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Versions:
    """A folder of versions on any Hadoop file system: versions/<v>/<table>, and a pointer file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at(self.path).getFileSystem(conf)
        self._context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), conf)

    def build(self, version: str, tables: dict[str, DataFrame], meta: dict) -> str:
        """Writes a version's tables and meta.json, then renames the whole into place; one that is there already stays.

        A version built again gets the next free number behind its name, and the name that it has is returned: what is
        being served is never taken away.
        """
        aside, there, again = f"{self.path}/staged/{uuid.uuid4().hex}", version, 1
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{aside}/{name}")
        self._put(f"{aside}/meta.json", json.dumps(meta))
        self._fs.mkdirs(self._at(f"{self.path}/versions"))
        while not self._renamed(aside, f"{self.path}/versions/{there}", over=False):
            there, again = f"{version}.{again}", again + 1
        return there

    def _renamed(self, aside: str, there: str, over: bool) -> bool:
        """One rename, atomic where the file system's is; false if something is there and over is."""
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if over else self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._context.rename(self._at(aside), self._at(there), options)
        except Py4JJavaError:
            if over or not self._fs.exists(self._at(there)):
                raise
            return False
        return True

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._at(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(self, version: str) -> str:
        """Points at a version, by one rename over the pointer; one without meta.json is incomplete and refused."""
        if not self._fs.exists(self._at(f"{self.path}/versions/{version}/meta.json")):
            raise ValueError(f"version {version} is incomplete")
        aside = f"{self.path}/pointer-{uuid.uuid4().hex}"
        self._put(aside, version)
        self._renamed(aside, f"{self.path}/current", over=True)
        return version

    def current(self) -> str | None:
        at = self._at(f"{self.path}/current")
        if not self._fs.exists(at):
            return None
        return self.spark.read.text(f"{self.path}/current").first()[0]

    def table(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions/{version or self.current()}/{name}")


def write_night(df: DataFrame, path: str) -> None:
    """Overwrites exactly the partitions (column version) that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def read_night(spark: SparkSession, path: str, version: str, casts: dict[str, str] | None = None) -> DataFrame:
    """One night, pruned to its partition, cast to the frame's types."""
    df = spark.read.parquet(path).where(f"version = '{version}'")
    return df.select(*(df[c].cast((casts or {}).get(c, t)).alias(c) for c, t in df.dtypes if c != "version"))
