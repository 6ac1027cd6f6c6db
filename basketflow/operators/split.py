"""Time split, runs and leak-free next-item cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketflow import schemas as S


def order_hash(*parts) -> Column:
    """A seeded order that SQL engines share: the hex SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def between(events: DataFrame, start, end) -> DataFrame:
    return events.where((F.col("event_time") >= F.lit(start)) & (F.col("event_time") < F.lit(end)))


def stats_events(events: DataFrame, name: str) -> DataFrame:
    return events.where(F.col("event_time") < F.lit(S.window(name)[0]))


def runs(events: DataFrame) -> DataFrame:
    """Adds run and target, the product of the session's next run (null in the last)."""
    w = Window.partitionBy("session").orderBy("event_time", "seq")
    head = F.coalesce(F.col("product_id") != F.lag("product_id").over(w), F.lit(True))
    rows = events.withColumn("head", head.cast("int")).withColumn("run", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.first(F.when(F.col("head") == 1, F.col("product_id")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("target", later).drop("head")


def cases(events: DataFrame, name: str, n: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(history, cases): the sessions that start in a window and touch two products, each cut once; n draws so many of them."""
    start, end = S.window(name)
    per = events.groupBy("session").agg(F.min("event_time").alias("first"), F.count_distinct("product_id").alias("products"))
    chosen = per.where((F.col("first") >= F.lit(start)) & (F.col("first") < F.lit(end)) & (F.col("products") >= 2)).select("session")
    chosen = chosen if n is None else chosen.orderBy(order_hash(seed, F.col("session")), "session").limit(n)
    own = runs(events.join(chosen, "session", "left_semi"))
    w = Window.partitionBy("session").orderBy("event_time", "seq")
    own = own.withColumn("pos", F.row_number().over(w) - 1)
    u = Window.partitionBy("session").orderBy(order_hash(seed, F.col("session"), F.col("pos")), "pos")
    pick = own.where(F.col("target").isNotNull()).withColumn("u", F.row_number().over(u)).where("u = 1")
    pick = pick.select("session", F.col("pos").alias("cut_pos"), F.col("event_time").alias("cut_time"), F.col("product_id").alias("last_product"), "target")
    history = own.join(pick.select("session", "cut_pos"), "session").where("pos <= cut_pos").drop("cut_pos", "run", "target")
    return history, pick.drop("cut_pos")


def inactivity(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Sessions of a user that end after so many minutes without an event: (user_id, start, end, n)."""
    got = events.groupBy("user_id", F.session_window("event_time", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.max("event_time").alias("last_event"))
    return got.select("user_id", F.col("w.start").alias("start_time"), "last_event", "n")
