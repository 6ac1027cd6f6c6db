"""Nightly tables: counts, gates, validation and comparison reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow import schemas as S


def daily_counts(events: DataFrame, day: str) -> DataFrame:
    """(d, n, last) of a day and the seven before it."""
    at = F.lit(day).cast("timestamp")
    rows = events.where((F.col("event_time") >= at - F.expr("INTERVAL 7 DAYS")) & (F.col("event_time") < at + F.expr("INTERVAL 1 DAY")))
    return rows.groupBy(F.date_trunc("DAY", "event_time").alias("d")).agg(F.count("*").alias("n"), F.max("event_time").alias("last"))


def gate(counts: DataFrame, day: str, least: float = 0.5, most: float = 2.0) -> DataFrame:
    """One row: the day's events, their ratio to the median of the present days before, and a status."""
    at = F.lit(day).cast("timestamp")
    today, before = F.col("d") == at, F.col("d") < at
    row = counts.agg(F.coalesce(F.max(F.when(today, F.col("n"))), F.lit(0)).alias("events"), F.max(F.when(today, F.col("last"))).alias("last"), F.median(F.when(before, F.col("n"))).alias("trailing"))
    ratio = F.col("events") / F.col("trailing")
    status = (
        F.when(F.col("events") == 0, "no events").when(F.col("last") < at + F.expr("INTERVAL 23 HOURS"), "not complete").when(ratio.isNotNull() & ~ratio.between(least, most), "volume").otherwise("ok")
    )
    return row.select(F.lit(day).alias("day"), "events", F.round(ratio, 6).alias("ratio"), status.alias("status"))


def jaccard(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """(key, jaccard) of the item sets that both sides have for a key; joins and counts, no lists."""
    both = a.join(b, [key, item]).groupBy(key).agg(F.count("*").alias("both"))
    na, nb = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((a, "na"), (b, "nb")))
    rows = na.join(nb, key).join(both, key, "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return rows.select(key, (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def validate(new: DataFrame, old: DataFrame, popular: DataFrame, probes: DataFrame, overlap: float = 0.2, change: float = 0.25) -> DataFrame:
    """One row on a version's matrix against the serving one: size change, mean overlap of `time` neighbours of the most popular products, probes, status.

    probes: lists (items, scores) that the new version gives; each must have K items with finite scores.
    """
    most = popular.orderBy(F.desc("pop"), "product_id").limit(S.TOP_POPULAR).select("product_id")
    time = lambda m: m.where("kind = 'time'").join(most, "product_id", "left_semi").select("product_id", "neighbour")
    mean = jaccard(time(new), time(old), "product_id", "neighbour").agg(F.avg("jaccard").alias("overlap"))
    full = (F.size("items") == S.K) & (F.size("scores") == S.K) & F.forall("scores", lambda x: F.abs(x) < F.lit(float("inf")))
    tried = probes.agg(F.count("*").alias("n_probes"), F.count_if(full).alias("n_full"))
    sizes = new.agg(F.count_distinct("product_id").alias("n_new")).crossJoin(old.agg(F.count_distinct("product_id").alias("n_old"))).crossJoin(mean).crossJoin(tried)  # one row each
    moved = F.abs(F.col("n_new") - F.col("n_old")) / F.greatest("n_old", F.lit(1))
    status = F.when(moved > change, "size").when(F.coalesce("overlap", F.lit(0.0)) < overlap, "overlap").when(F.col("n_full") < F.col("n_probes"), "probes").otherwise("ok")
    return sizes.select("n_new", "n_old", F.round(moved, 4).alias("change"), F.round("overlap", 4).alias("overlap"), "n_probes", "n_full", status.alias("status"))


def compare_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    """By kind: rows on each side, only on one, shared, shared with the same weight, largest relative difference."""
    x = a.select("kind", "product_id", "neighbour", F.col("weight").alias("wa"))
    y = b.select("kind", "product_id", "neighbour", F.col("weight").alias("wb"))
    j = x.join(y, ["kind", "product_id", "neighbour"], "full")
    both = F.col("wa").isNotNull() & F.col("wb").isNotNull()
    return j.groupBy("kind").agg(
        F.count("wa").alias("n_first"), F.count("wb").alias("n_second"), F.count_if(F.col("wb").isNull()).alias("only_first"), F.count_if(F.col("wa").isNull()).alias("only_second"),
        F.count_if(both).alias("shared"), F.count_if(F.col("wa") == F.col("wb")).alias("same"), F.round(F.max(F.when(both, F.abs(F.col("wa").cast("double") - F.col("wb")) / F.abs("wb"))), 6).alias("max_diff"),
    )


def compare_frames(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(column, n_differ) for every column but the key, null equal to null; a row on one side only differs where it is not null."""
    cols = [c for c in a.columns if c != key]
    j = a.join(b.select(key, *(F.col(c).alias(f"{c}_b") for c in cols)), key, "full")
    one = j.agg(*(F.count_if(~F.col(c).eqNullSafe(F.col(f"{c}_b"))).alias(c) for c in cols))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_differ")) for c in cols))).alias("r")).select("r.*")


def fingerprint(df: DataFrame) -> DataFrame:
    """One number for a table, whatever the order of its rows."""
    return df.agg(F.bit_xor(F.xxhash64(F.to_json(F.struct("*")))).alias("fingerprint"), F.count("*").alias("n"))


def ingest_stats(events: DataFrame) -> DataFrame:
    """Twelve figures of a data set in one row; the 99th percentile is a value that occurs."""
    per = events.groupBy("session").agg(F.count("*").alias("n")).agg(F.median("n").alias("events_per_session_median"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY n)").cast("double").alias("events_per_session_p99"))
    kind = lambda k: F.count_if(F.col("event_type") == k)
    one = events.agg(
        F.count("*").alias("events"), kind(0).alias("views"), kind(1).alias("carts"), kind(2).alias("purchases"), F.count_distinct("user_id").alias("users"), F.count_distinct("session").alias("sessions"),
        F.count_distinct("product_id").alias("products"), F.count_if(F.col("session").isNull()).alias("events_without_session"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
    )
    return one.crossJoin(per)  # one row each
