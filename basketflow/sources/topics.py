"""Message topics: Kafka where its connector is on the class path, else a folder that is read as a stream.

Both have the columns key, value, partition and offset; messages of one key are in one partition, in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = "key string, value string, partition int, offset long"


def has_kafka(spark: SparkSession) -> bool:
    """Whether the package spark-sql-kafka-0-10 is there; it is not part of PySpark."""
    loader = spark._jvm.Thread.currentThread().getContextClassLoader()
    return loader.getResource("org/apache/spark/sql/kafka010/KafkaSourceProvider.class") is not None


def write_kafka(rows: DataFrame, servers: str, topic: str) -> None:
    """Publishes rows (key, value) to a broker."""
    if not has_kafka(rows.sparkSession):
        raise RuntimeError("Kafka needs the package spark-sql-kafka-0-10 on the class path")
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "1", "kafka.compression.type": "lz4"}
    rows.select("key", "value").write.format("kafka").options(**options).save()


def read_kafka(spark: SparkSession, servers: str, topic: str, most: int = 2000) -> DataFrame:
    """A broker's topic as a stream, at most so many messages a micro-batch; offsets are in the query's checkpoint."""
    if not has_kafka(spark):
        raise RuntimeError("Kafka needs the package spark-sql-kafka-0-10 on the class path")
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(most)}
    rows = spark.readStream.format("kafka").options(**options).load()
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset")


def write_folder(rows: DataFrame, path: str, partitions: int = 6, start: DataFrame | None = None) -> None:
    """Publishes rows (key, seq, value) to a folder: each partition's messages numbered by seq, after those of start (partition, high)."""
    part = (F.crc32(F.col("key").cast("binary")) % partitions).cast("int")
    place = F.row_number().over(Window.partitionBy("partition").orderBy("seq", "key")) - 1
    out = rows.withColumn("partition", part)
    before = F.lit(0)
    if start is not None:
        out, before = out.join(F.broadcast(start), "partition", "left"), F.coalesce(F.col("high"), F.lit(0))  # a row a partition
    out.withColumn("offset", (place + before).cast("long")).select("key", "value", "partition", "offset").write.mode("append").parquet(path)


def read_folder(spark: SparkSession, path: str, most: int = 1) -> DataFrame:
    """A folder's topic as a stream, at most so many files a micro-batch."""
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", most).parquet(path)
