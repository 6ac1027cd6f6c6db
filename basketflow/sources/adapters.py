"""The given tables as the canonical event model, and readers of recorded events.

Canonical columns: session, event_time (timestamp, UTC), seq (breaks ties within a second),
event_type (0 view, 1 cart, 2 purchase), product_id, user_id, category_id, brand, price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketflow import schemas as S


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def recode_strict(column, table: dict[str, int]):
    """Codes of known values; another value is an error, null stays."""
    out = F.when(column.isNull(), F.lit(None).cast("int"))
    for k, v in table.items():
        out = out.when(column == k, F.lit(v))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown value "), column)).cast("int"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    k = F.get_json_object("props", "$.k").cast("long")
    at = F.col("ts").cast("timestamp")
    return rows.select(
        at.alias("event_time"), F.col("event_id").alias("seq"), "user_id", recode_strict(F.col("event_type"), {"view": 0, "click": 1, "purchase": 2}).alias("event_type"),
        k.alias("product_id"), F.floor(k / 10).cast("long").alias("category_id"), F.when(k % 7 != 0, F.concat(F.lit("brand"), (k % 4).cast("string"))).alias("brand"), F.col("value").alias("price"),
    )


def e_day(spark: SparkSession, d: str) -> DataFrame:
    """One session for each user and day."""
    return _events(spark, d).withColumn("session", F.col("user_id") * 100_000 + F.unix_date(F.col("event_time").cast("date")))


def e_long(spark: SparkSession, d: str) -> DataFrame:
    """One session for each user: reaches the cut at 30 and the gap limits."""
    return _events(spark, d).withColumn("session", F.col("user_id"))


def o_cust(spark: SparkSession, d: str) -> DataFrame:
    """One session for each customer's order lines: many exact ties in time; seq is not unique."""
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("o_custkey").alias("session"), F.col("o_orderdate").cast("timestamp").alias("event_time"), F.lit(0).cast("long").alias("seq"), F.col("o_custkey").alias("user_id"),
        recode_strict(F.col("l_returnflag"), {"A": 0, "N": 1, "R": 2}).alias("event_type"), F.col("l_partkey").alias("product_id"), F.col("p_type").alias("category_id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"),
    )


def csv_typed(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Typed events of a raw CSV; a gzip is one task, so it is dealt out anew after reading."""
    rows = spark.read.schema(S.RAW_CSV).option("header", True).csv(path)
    rows = rows.repartition(partitions) if partitions else rows
    at = F.to_timestamp("event_time", "yyyy-MM-dd HH:mm:ss 'UTC'")
    return rows.withColumn("event_time", at).withColumn("event_type", recode_strict(F.col("event_type"), {"view": 0, "cart": 1, "purchase": 2}))


def with_sessions(events: DataFrame, key: str = "user_session") -> DataFrame:
    """Dense session numbers from 0 by first event, then key; rows without a key have none.

    Numbers come from ranges of the first event time: each range's rows are numbered in its own
    task and offset by the sizes of those before, so no task sees all sessions.
    """
    first = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("event_time").alias("first"))
    day = F.unix_date(F.col("first").cast("date"))
    sizes = first.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    before = sizes.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))
    own = first.withColumn("day", day).join(F.broadcast(before), "day")
    number = F.row_number().over(Window.partitionBy("day").orderBy("first", key)) - 1 + F.col("before")
    return events.join(own.select(key, number.cast("long").alias("session")), key, "left")


def recorded(events: DataFrame, start: str, end: str, sessions: DataFrame | None = None) -> DataFrame:
    """Events of a half-open time range, in time order, of some sessions or all."""
    rows = events.where((F.col("event_time") >= F.lit(start).cast("timestamp")) & (F.col("event_time") < F.lit(end).cast("timestamp")))
    rows = rows if sessions is None else rows.join(sessions, "session", "left_semi")
    return rows.orderBy("event_time", "seq")
