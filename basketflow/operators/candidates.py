"""Candidates: history items, popularity, co-visitation scores and the ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketflow import schemas as S


def history_items(history: DataFrame) -> DataFrame:
    """One row per (session, product) of a history; h_rank 0 is the most recent by position."""
    rows = history.groupBy("session", "product_id").agg(F.count("*").alias("h_events"), F.max("event_time").alias("h_last"), F.max("pos").alias("h_pos"), F.max("event_type").alias("h_max_type"))
    return rows.withColumn("h_rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("h_pos"))) - 1)


def popular(stats: DataFrame, end, days: int = 7) -> DataFrame:
    """(product_id, pop) over the days before end."""
    return stats.where(F.col("event_time") >= F.lit(end) - F.expr(f"INTERVAL {days} DAYS")).groupBy("product_id").agg(F.count("*").alias("pop"))


def covis_scores(items: DataFrame, matrix: DataFrame, only_last: bool = False) -> DataFrame:
    """(session, kind, product_id, score): neighbours of a history's products, weighted by recency."""
    m = matrix.select("kind", "product_id", "neighbour", (F.col("weight") / F.max("weight").over(Window.partitionBy("kind", "product_id"))).cast("float").alias("w"))
    src = items.where("h_rank = 0") if only_last else items
    got = src.select("session", "product_id", (F.lit(1.0) / (1 + F.col("h_rank"))).alias("r")).join(m, "product_id")
    return got.groupBy("session", "kind", F.col("neighbour").alias("product_id")).agg(F.sum(F.col("r") * F.col("w")).alias("score"))


def combined(scores: DataFrame) -> DataFrame:
    """All kinds together, to nine digits: sums in another order give the same lists."""
    return scores.groupBy("session", "product_id").agg(F.round(F.sum("score"), 9).alias("score"))


def baseline_scores(name: str, history: DataFrame, matrix: DataFrame) -> DataFrame:
    items = history_items(history)
    if name == "popular":
        return items.where(F.lit(False)).select("session", "product_id", F.lit(0.0).alias("score"))
    if name == "history":
        return items.select("session", "product_id", (-F.col("h_rank")).cast("double").alias("score"))
    return combined(covis_scores(items, matrix, {"item2item": True, "covis": False}[name]))


def top_k(scores: DataFrame, cases: DataFrame, pop: DataFrame, k: int = S.K) -> DataFrame:
    """(session, run): k products, best score first, then popular ones that are missing, then -1.

    The last product never counts. The filler is the first k + 64 popular products, in one
    array that every session reads; no rows are made for what is not used.
    """
    last = cases.select("session", "last_product")
    w = Window.partitionBy("session").orderBy(F.desc("score"), "product_id")
    best = scores.join(last, "session").where("product_id <> last_product").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    own = best.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "product_id"))), lambda x: x["product_id"]).alias("own"))
    first = pop.orderBy(F.desc("pop"), "product_id").limit(k + S.FILLER)
    filler = first.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("pop")).alias("p"), "product_id"))), lambda x: x["product_id"]).alias("filler"))
    got = last.join(own, "session", "left").crossJoin(F.broadcast(filler))  # one row
    own = F.coalesce("own", F.expr("cast(array() as array<bigint>)"))
    more = F.filter("filler", lambda p: (p != F.col("last_product")) & ~F.array_contains(own, p))
    padded = F.concat(own, more, F.array_repeat(F.lit(-1).cast("long"), k))
    return got.select("session", F.slice(padded, 1, k).alias("run"))


def evaluate(runs: DataFrame, cases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """recall@20, recall@10, NDCG@10 and MRR@20 over all cases, to four digits."""
    rank = F.array_position("run", F.col("target"))
    rows = runs.join(cases.select("session", "target"), "session").withColumn("rank", rank)
    hit = lambda n: F.when((F.col("rank") > 0) & (F.col("rank") <= n), 1.0).otherwise(0.0)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_cases"), F.round(F.avg(hit(20)), 4).alias("recall_20"), F.round(F.avg(hit(10)), 4).alias("recall_10"),
        F.round(F.avg(F.when((F.col("rank") > 0) & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), 4).alias("ndcg_10"),
        F.round(F.avg(F.when((F.col("rank") > 0) & (F.col("rank") <= 20), 1 / F.col("rank")).otherwise(0.0)), 4).alias("mrr_20"),
    )
