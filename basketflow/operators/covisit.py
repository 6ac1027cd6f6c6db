"""Co-visitation: which products meet in a session, by time, by type and among purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketflow import schemas as S


def prepare(events: DataFrame, most: int = S.PER_SESSION) -> DataFrame:
    """Distinct (session, product, type) at its latest event; the most recent of each session.

    Ties in time go to the larger seq, then the smaller product and type.
    """
    rows = events.where(F.col("session").isNotNull()).groupBy("session", "product_id", "event_type").agg(F.max(F.unix_seconds("event_time")).alias("ts"), F.max("seq").alias("seq"))
    w = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("seq"), "product_id", "event_type")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("session", "product_id", "event_type", "ts")


def per_session(prepared: DataFrame) -> DataFrame:
    """Each session's pairs a <> b with their strongest weight of each kind; one self-join.

    At most 30 x 29 pairs come from a session, whatever its length.
    """
    a = prepared.select("session", "product_id", F.col("event_type").alias("ta"), F.col("ts").alias("tsa"))
    b = prepared.select(F.col("session").alias("sb"), F.col("product_id").alias("neighbour"), F.col("event_type").alias("tb"), F.col("ts").alias("tsb"))
    gap = F.abs(F.col("tsa") - F.col("tsb"))
    pairs = a.join(b, (F.col("session") == F.col("sb")) & (F.col("product_id") != F.col("neighbour")) & (gap < S.BUY_GAP))
    weight = F.when(F.col("tb") == 0, 1).when(F.col("tb") == 1, 6).when(F.col("tb") == 2, 3)
    return pairs.groupBy("session", "product_id", "neighbour").agg(
        F.max(F.when(gap < S.GAP, F.col("tsa"))).alias("time_ts"), F.max(F.when(gap < S.GAP, weight)).alias("type_w"), F.max(F.when((F.col("ta") > 0) & (F.col("tb") > 0), 1)).alias("buy_w")
    )


def weights(prepared: DataFrame) -> DataFrame:
    """(kind, product_id, neighbour, weight) of all kinds. Sums are of integers, so their order does not matter."""
    bounds = prepared.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    sums = per_session(prepared).groupBy("product_id", "neighbour").agg(F.count("time_ts").alias("n"), F.sum("time_ts").alias("s"), F.sum("type_w").alias("type_w"), F.sum("buy_w").alias("buy_w"))
    sums = sums.crossJoin(F.broadcast(bounds))  # one row
    time = F.when(F.col("n") > 0, F.col("n") + F.lit(3.0) * (F.col("s") - F.col("n") * F.col("t0")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1)))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), w.cast("double").alias("weight")) for k, w in zip(S.KINDS, (time, F.col("type_w"), F.col("buy_w")), strict=True)))
    return sums.select("product_id", "neighbour", F.explode(kinds).alias("k")).select("k.kind", "product_id", "neighbour", "k.weight").where("weight is not null")


def top_neighbours(rows: DataFrame, top: int = S.TOP) -> DataFrame:
    """The strongest neighbours of each kind and product; ties to the lower neighbour; weights as float."""
    w = Window.partitionBy("kind", "product_id").orderBy(F.desc("weight"), "neighbour")
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return rows.withColumn("weight", F.col("weight").cast("float"))


def build(events: DataFrame, top: int = S.TOP) -> DataFrame:
    return top_neighbours(weights(prepare(events)), top)
